"""Token alignment, fill-in-the-middle and personal data against plain definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import fill_in_middle, personal_data, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
KINDS = "doc_id long, text string, n long, form string, spans int, groups string, pairs string"
#: With columns whose names clash with those of the operators.
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "one two  three   four\n five\t six\r\n seven ", "it's 'll don't x  y　 z", "été à la ﬁn, señor straße ",
    "<|endoftext|> <s> </s> <unk> ▁ ▁x x▁", "a\u0085 b  c", "日本語 の テキスト 😀😀 family", "\x00 nul \x7f", "é combining", "word " * 3000, "x" * 5000, "9" * 300 + " 12 345", "ends  here", "é éà Â  b",
]


def table(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, 9, "f", 1, "g", "p") for i, t in enumerate(texts)] + [(1, "twice", 0, "", 0, "", "")] * 2, KINDS)


def plainly(texts):
    """Groups of all texts by byte offsets, and what the corpus says about their links."""
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    made = []
    for text in texts:
        groups = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends, at = {}, 0
                for k, x in enumerate(a_bytes):
                    at += len(x)
                    ends[at] = k + 1
                at = i = j = 0
                for k, x in enumerate(b_bytes):
                    at += len(x)
                    if at in ends:
                        groups.append((a[i : ends[at]], b[j : k + 1]))
                        i, j = ends[at], k + 1
        made.append(groups)
    count = Counter((x[-1], y[-1]) for g in made for x, y in g)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for g in made:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        links = [(x[-1], y[-1]) for x, y in g]
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if g else "", text))
    return out


def rows(df, *names):
    return sorted((str(r["id"]), *[r[n] for n in names]) for r in df.collect())


def test_alignment(spark, monkeypatch):
    docs = table(spark, ODD)
    want = plainly([*ODD, "twice", "twice"])
    ids = [str(i if i != 3 else None) for i in range(len(ODD))] + ["1", "1"]
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = rows(token_alignment.scored_alignments(docs, A, B), *names)
    assert got == sorted((i, *w[:7]) for i, w in zip(ids, want, strict=True))
    assert rows(token_alignment.alignments(docs, A, B), "groups") == sorted((i, w[7]) for i, w in zip(ids, want, strict=True))
    # by shuffles, with hot pairs
    monkeypatch.setattr(token_alignment, "_HOT", 1 / 50)
    assert rows(token_alignment.scored_alignments(docs, A, B, broadcast_bytes=0), *names) == got
    assert token_alignment.scored_alignments(docs.limit(0), A, B).count() == 0


def test_alignment_of_random_texts():
    """Words encoded by themselves and whole texts give the same groups."""
    import pyarrow as pa

    pick = random.Random(5)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "à", " ", " ", "😀", "'s", "12", ".", "ß", "　", "▁", "\u0085"]
    texts = ["".join(pick.choices(alphabet, k=pick.randint(1, 40))) for _ in range(600)]
    aligner = token_alignment.Aligner(A, B)
    assert aligner.by_words
    assert token_alignment._aligned(aligner, pa.array(texts))[3].to_pylist() == [w[7] for w in plainly(texts)]


def test_transducer():
    left, right = [b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"", b"x"]
    t = token_alignment.Transducer(left, right)
    assert t.groups([0, 1, 3], [0, 1]) is None  # d is left over
    assert t.groups([0, 1], [0, 1]) == [([0, 1], [0, 1])] and t.groups([2, 3, 2], [2, 0, 1]) == [([2, 3], [2]), ([2], [0, 1])]
    assert t.groups([], []) == [] and t.groups([0], [4]) is None and t.groups([0], [3]) is None and t.groups([], [0]) is None
    before = len(t.steps)
    t.groups([2, 3, 2], [2, 0, 1])
    assert len(t.steps) == before  # all transitions are remembered


def test_fill_in_middle(spark):
    texts = [None, "", "a", "\n", "\n\n", "one\ntwo\r\nthree", "holds <P> a mark\nx", "<\nS><S\n>", "😀\né\n" * 50, "long " * 20_000, "<S>"] + [f"l{i}\n" * (i % 7) + "t<" * (i % 2) for i in range(60)]
    got = fill_in_middle.transformed(table(spark, texts)).withColumn("back", fill_in_middle.restored(F.col("form"), F.col("output"))).collect()
    want, forms = [], set()
    for i, t in [*enumerate(texts), (1, "twice"), (1, "twice")]:
        t, i = t or "", None if i == 3 and t == "\n" else i
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
        forms.add(form)
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        lengths = (None, None) if form == "plain" else (len(p), len(m))
        want.append((str(i), len(units), form, *map(str, lengths), out, t))
    assert forms == {"plain", "spm", "psm"}
    assert sorted((str(r["id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["back"]) for r in got) == sorted(want)
    assert fill_in_middle.transformed(table(spark, texts).limit(0)).count() == 0
    assert {r["form"] for r in fill_in_middle.transformed(table(spark, texts), rate=0).collect()} == {"plain"}


def base_plainly(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(s))]
        return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_fixed_kinds_against_their_patterns():
    pick = random.Random(3)
    parts = ["a", "b.c", "@", ".", "x@y.z", "@b.c", "1", "22", "255", "256", "1.2.3.4", ".0010", " ", "-", "+", "(555)", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "é", "😀", "_", "%", "\n", "٣"]
    hits = Counter()
    for _ in range(6000):
        t = "".join(pick.choices(parts, k=pick.randint(1, 14)))
        got = [(k, a, b) for k, a, b, _, base in personal_data.find(t) if base]
        assert got == base_plainly(t), t
        hits.update(x[0] for x in got)
    assert min(hits[k] for k in personal_data.BASE) > 100


def test_long_texts_take_time_in_proportion():
    for t in ("a" * 400_000, "a@" * 200_000, "1" * 400_000, "1 " * 200_000, "1." * 200_000, "+1" + " " * 400_000, "AB12" * 100_000, "+1(" * 100_000, "555-" * 100_000, "tel 555-010-9999 " * 20_000):
        personal_data.find(t)


def test_personal_data(spark):
    texts = {
        "IBAN: DE89 3704 0044 0532 0130 00 bitte": ["iban"], "DE89370400440532013000": ["iban"], "DE88370400440532013000": [], "GB82WEST12345698765432 Bank": ["iban"],
        "my ssn is 219-09-9999.": ["ssn"], "part 219-09-9999": [], "ssn 000-09-9999": [], "amex 378282246310005": ["short_card"], "378282246310005": [],
        "call tel (555) 010-9999 now": ["local_phone"], "the sum (555) 010-9999": [], "tel +1 (555) 010-9999": ["phone"], "mail joe@example.com, ip 10.0.0.1": ["email", "ip"], "10.0.0.300": [], "4111 1111 1111 1112": [],
    }
    docs = table(spark, [*texts, None, "", "plain text " * 5000])
    got = {}
    for r in personal_data.personal_data(docs).collect():
        got.setdefault(r["id"], []).append([s["kind"] for s in r["spans"]])
    want = {i if i != 3 else None: [k] for i, k in enumerate([*texts.values(), [], [], []])}
    want[1] += [[], []]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    spans = personal_data.find("mail joe@example.com version 10.0.0.1")
    assert [(k, a, b, base) for k, a, b, _, base in spans] == [("email", 5, 20, True), ("ip", 29, 37, True)]
    assert personal_data.find("ip 10.0.0.1")[0][3] > spans[1][3]  # "version" speaks against
    assert personal_data.personal_data(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "😀 mail joe@example.com or 10.0.0.1!"), (2, "nothing"), (3, None), (4, "10.0.0.1")], "doc_id long, text string")
    out = personal_data.personal_data(docs).join(docs, F.col("id") == F.col("doc_id")).select("id", personal_data.redacted(F.col("text"), F.col("spans")).alias("text"))
    assert {r["id"]: r["text"] for r in out.collect()} == {1: "😀 mail [email] or [ip]!", 2: "nothing", 3: None, 4: "[ip]"}


def test_queries_on_their_table(spark):
    """The registered queries over all documents against the definitions."""
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    queries = __spark_entry__.queries()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in queries["op11_token_alignment"](spark, sf).collect()}
    assert got == {i: w[:7] for i, w in zip(docs, plainly(docs.values()), strict=True)}
    for r in queries["op13_personal_data"](spark, sf).collect():
        base = base_plainly(docs[r["doc_id"]] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest() and [r[f"n_{k}"] for k in personal_data.BASE] == [sum(x[0] == k for x in base) for k in personal_data.BASE]
        assert set(written.split(",")) - {""} <= set(r["spans"].split(","))
    assert all(hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest() == r["restored_sha256"] for r in queries["op12_fill_in_middle"](spark, sf).collect())
