"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Four kinds are fixed by their patterns (email, ip, card, phone): whatever matches and passes its
check is reported, whatever the score. Further kinds (bank account numbers, social security
numbers, shorter cards, telephone numbers without a plus) are reported where the score reaches a
threshold: a checksum or words such as "tel" nearby have to speak for them. It is a map over the
documents; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import table, trim
from .packing import slices

#: The kinds that the patterns alone decide, in the order of the digests, then the others.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "short_card", "local_phone")
THRESHOLD = 0.6
#: Characters on either side of a span in which words count.
NEAR = 48
_SLICE = 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match never starts inside a run of digits: what follows the run is the same from each of its places
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])[0-9]{3,4}(?:[ .-][0-9]{2,5}){1,3}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")
#: Words that speak for a kind (English, French, German, Spanish), and words that speak against any.
CONTEXT = {
    "email": frozenset("email mail contact courriel kontakt correo".split()),
    "ip": frozenset("ip address host server client login adresse servidor dirección".split()),
    "card": frozenset("card credit debit visa mastercard payment carte crédit karte kreditkarte tarjeta crédito".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax téléphone telefon handy teléfono móvil".split()),
    "iban": frozenset("iban account bank transfer konto compte cuenta banque banco".split()),
    "ssn": frozenset("ssn social security".split()),
}
CONTEXT |= {"short_card": CONTEXT["card"] | {"amex"}, "local_phone": CONTEXT["phone"]}
AGAINST = frozenset("version release isbn issn example sample order invoice serial part model page".split())
#: Score of a proposal, what its checksum adds; words nearby add and take as much.
START = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "ssn": 0.4, "short_card": 0.1, "local_phone": 0.3}
CHECKED = {"card": 0.4, "iban": 0.5, "short_card": 0.3}
FOR, BUT = 0.3, 0.2
#: Lengths of bank account numbers by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without spaces has its country's length and check digits."""
    return len(account) == IBAN_LENGTH.get(account[:2]) and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap, found from each @: time in proportion to the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            last = m.end()
            out.append((start, last))
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    return out


def cards(text: str) -> list[tuple[int, int, int]]:
    """(start, end, digits) of runs of 13 to 19 digits whose last one is their check digit."""
    found = ((m.start(), m.end(), _only_digits(m[0])) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 37)
    return [(a, b, len(d)) for a, b, d in found if 13 <= len(d) <= 19 and luhn(d)]


def base_spans(text: str, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four fixed kinds; a match that fails its check is dropped. ``runs``: :func:`cards`."""
    out = [("email", *x) for x in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    out += [("card", a, b) for a, b, n in runs if n >= 16]
    for m in _PHONE.finditer(text):
        if 8 <= len(_only_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def _proposed(text: str, runs: list[tuple[int, int, int]]):
    """(kind, start, end) of the added kinds whose checksum, if there is one, holds."""
    for m in _IBAN.finditer(text):
        # a word behind the number may look like a part of it: the country says how long it is
        want, at, n = IBAN_LENGTH.get(m[0][:2], 0), m.start(), 0
        while n < want and at < m.end():
            n += text[at] != " "
            at += 1
        if n == want and not text[at : at + 1].isalnum() and mod97(text[m.start() : at].replace(" ", "")):
            yield "iban", m.start(), at
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    yield from (("short_card", a, b) for a, b, n in runs if n < 16)
    for m in _LOCAL_PHONE.finditer(text):
        if 8 <= len(_only_digits(m[0])) <= 15:
            yield "local_phone", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The proposal's score, its checksum's (it held), and what the words nearby say."""
    near = {w.lower() for part in (text[max(0, start - NEAR) : start], text[end : end + NEAR]) for w in _WORD.findall(part)}
    out = START[kind] + CHECKED.get(kind, 0.0) + FOR * (not near.isdisjoint(CONTEXT[kind])) - BUT * (not near.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, out)), 6)


def find(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, whether the patterns alone decide) by kind, then start.

    Of added spans that overlap the one with the higher score stays, then the first; those that
    overlap a fixed one don't count.
    """
    runs = cards(text)
    base = base_spans(text, runs)
    out = [(*s, score(text, *s), True) for s in base]
    taken: list[tuple[int, int]] = []  # in order and apart
    for a, b in sorted(x[1:] for x in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    more = sorted(((score(text, *s), s) for s in _proposed(text, runs)), key=lambda x: (-x[0], x[1][1], ADDED.index(x[1][0])))
    for points, (kind, start, end) in more:
        if points < threshold:
            break
        i = bisect_left(taken, (end,))
        if i == 0 or taken[i - 1][1] <= start:
            insort(taken, (start, end))
            out.append((kind, start, end, points, False))
    order = BASE + ADDED
    return sorted(out, key=lambda x: (order.index(x[0]), x[1]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``id`` and ``spans``, an array of (kind, start, end, score, base) by kind, then start.

    Places are code points, the end exclusive; ``base`` spans are those of the four fixed kinds.
    Null and empty texts have no spans; texts of any length are read whole; repeated rows give equal
    rows and null ids are kept; an empty table gives an empty result. Other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
    fields = [f.name for f in kind.value_type]

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(1), _SLICE):
                found = [[dict(zip(fields, s, strict=True)) for s in find(t, threshold)] if t else [] for t in b.column(1).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(found, kind)], ["id", "spans"])
            trim()

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long, score: double, base: boolean>>")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span's characters replaced by its kind in brackets; of overlapping spans the first counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(more.alias("out"), s["end"].alias("at")))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text) - acc["at"])))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    """The counts are those of the four fixed kinds, which the added spans don't change."""
    out = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return out.select(F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
