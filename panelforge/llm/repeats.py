"""The exchange under the two operators that remove repeated windows (words or bytes).

Both ask the same question: which fixed-length windows of a document also start in a document
with a smaller id? Three passes over one shuffle of the documents answer it:

1. *Keys.* A key is a function of a window's content alone, and neighbouring windows share it
   (a few per cent as many keys as windows). Every shard sends the distinct keys it holds, cut to
   32 bits inside their bucket, and learns which of them other documents hold too. Clashes of keys
   only let more candidates through.
2. *Texts.* A run of neighbouring windows with one shared key travels as its text, each distinct
   one once per shard, with the smallest document id the shard knows for it. The bucket of the key
   compares the texts themselves and returns, for windows of a run, the smallest id over all
   shards where that is smaller still. No hash decides what is equal.
3. *Removal.* The shard lists its runs again and removes what is covered.

Rows travel as blobs per (shard, bucket) that holds anything, so there are never more of them than
distinct keys per shard, however many shards there are. A shard sends a distinct text once however
often it occurs, so a passage that a third of all documents repeat puts one text per shard into a
bucket. Keys with more than ``hot`` uses are refined: their runs are cut into single windows, whose
keys are hashes of the whole window, and these are compared in their own buckets in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from .common import expand, mix, pack, pieces, squeeze, trim, unpack

#: A row without an id ranks after all others: it never takes words from one.
NO_ID = np.iinfo(np.int64).max
SHARD_BYTES = 4 << 20
#: Windows of a run at most.
LONGEST_RUN = 64
FLAGS, TEXTS = 0, 1
_COLUMNS = ("kind", "bucket", "shard", "a", "b", "c", "d", "e")
EXCHANGE = "kind int, bucket long, shard long, a binary, b binary, c binary, d binary, e binary"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5)


def message(rows: list[tuple]) -> pa.Table:
    rows = [(*r, *[None] * (len(_COLUMNS) - len(r))) for r in rows]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(_COLUMNS, _TYPES, strict=True))})


def received(table: pa.Table) -> list[tuple]:
    return list(zip(*[table[n].to_pylist() for n in _COLUMNS], strict=True)) if table.num_rows else []


class Rows:
    """A shard's documents in an order that depends on nothing but their ids and texts."""

    def __init__(self, table: pa.Table):
        ids = table["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
        self.missing = table["text"].is_null().to_numpy()
        self.order = np.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), np.int64)
        self.ids, self.missing = ids[self.order], self.missing[self.order]
        self.texts = [texts[i] for i in self.order.tolist()]


def bucketed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket (high 32 bits) and 32 further bits of each key; in order of the bucket."""
    high = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return (high << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def bounds(sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def by_bucket(high: np.ndarray):
    """(bucket, first, last + 1) of each run of a sorted array of buckets."""
    at = bounds(high)
    if not len(at):
        return []
    return zip(high[at].tolist(), at.tolist(), [*at[1:].tolist(), len(high)], strict=True)


def sorted_pairs(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    bits = max(1, int(n_rows).bit_length())
    if len(keys) and int(keys.max()).bit_length() + bits <= 64:
        both = np.sort((keys << np.uint64(bits)) | rows.astype(np.uint64))
        return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.lexsort((rows, keys))
    return keys[order], rows[order]


def send_keys(shard: int, keys: np.ndarray, rows: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    """Distinct keys with how often they occur (to 254); 255: in two documents of this shard."""
    k, r = sorted_pairs(bucketed(keys, buckets), rows, len(ids))
    at = bounds(k)
    last = np.append(at[1:], len(k)) - 1
    many = np.minimum(last - at + 1, 254).astype(np.uint8)
    many[ids[r[at]] != ids[r[last]]] = 255
    k = k[at]
    return message([(FLAGS, b, shard, pack(k[i:j].astype(np.uint32)), pack(many[i:j])) for b, i, j in by_bucket(k >> np.uint64(32))])


def share_keys(table: pa.Table, hot: int) -> pa.Table:
    """For each shard: 1 for its keys that two documents hold, 2 for those with over ``hot`` uses."""
    got = received(table)
    keys = [unpack(r[3], np.uint32) for r in got]
    many = np.concatenate([unpack(r[4], np.uint8) for r in got])
    every = np.concatenate(keys).astype(np.uint64)
    k, order = sorted_pairs(every, np.arange(len(every)), len(every))
    at = bounds(k)
    n = np.diff(np.append(at, len(k)))
    uses = np.add.reduceat(many[order].astype(np.int64), at)
    shared = (n > 1) | (many[order][at] == 255)
    flag = np.empty(len(every), np.uint8)
    flag[order] = np.repeat(np.where(shared, np.where(uses > hot, 2, 1), 0).astype(np.uint8), n)
    ends = np.cumsum([len(x) for x in keys])
    return message([(FLAGS, r[1], r[2], pack(f)) for r, f in zip(got, np.split(flag, ends[:-1]), strict=True)])


def flags_of(keys: np.ndarray, flag_rows: list[tuple], buckets: int) -> np.ndarray:
    """The flag of each key, from what ``share_keys`` returned."""
    if not len(keys):
        return np.zeros(0, np.uint8)
    k = bucketed(keys, buckets)
    distinct = np.sort(k)
    distinct = distinct[bounds(distinct)]
    flag = np.concatenate([unpack(r[3], np.uint8) for r in sorted(flag_rows, key=lambda r: r[1])])
    return flag[np.searchsorted(distinct, k)]


class Runs:
    """Runs of windows with one key, in text order: ``start``, ``size``, ``key`` and ``row`` of each.

    ``text`` gives the text of the windows [start, start + size); equal texts hold equal windows
    and have equal keys.
    """

    start: np.ndarray
    size: np.ndarray
    key: np.ndarray
    row: np.ndarray

    def text(self, start: int, size: int) -> bytes:
        raise NotImplementedError

    def cut(self, start: np.ndarray, size: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        """Keep runs, cut to ``LONGEST_RUN`` windows."""
        parts = -(-size // LONGEST_RUN)
        of = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = start[of] + nth * LONGEST_RUN
        self.size = np.minimum(start[of] + size[of] - self.start, LONGEST_RUN)
        self.key, self.row = key[of], row[of]


class Shared:
    """A shard's runs with a shared key: the distinct texts in the order of their buckets."""

    def __init__(self, rows: Rows, runs: Runs, got: list[tuple], n: int):
        flag = flags_of(runs.key, [r for r in got if r[0] == FLAGS], n)
        use, hot = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        many = runs.size[hot]
        single = np.repeat(runs.start[hot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.start, self.size = np.append(runs.start[use], single), np.append(runs.size[use], np.ones(len(single), np.int64))
        self.ids = rows.ids[np.append(runs.row[use], np.repeat(runs.row[hot], many))]
        index: dict[bytes, int] = {}
        self.of = np.fromiter((index.setdefault(runs.text(a, k), len(index)) for a, k in zip(self.start.tolist(), self.size.tolist(), strict=True)), np.int64, len(self.start))
        first = np.zeros(len(index), np.int64)
        first[self.of[::-1]] = np.arange(len(self.of))[::-1]
        self.least = np.full(len(index), NO_ID)
        np.minimum.at(self.least, self.of, self.ids)
        texts = list(index)
        key = np.append(runs.key[use], np.zeros(len(single), np.uint64))[first]
        fine = np.flatnonzero(first >= len(use))
        key[fine] = mix(np.array([xxh64_intdigest(texts[i]) for i in fine.tolist()], np.uint64))
        key = bucketed(key, n)
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of, self.least, self.key, self.many = place[self.of], self.least[order], key[order], self.size[first][order]
        self.texts = [texts[i] for i in order.tolist()]

    def send(self, shard: int) -> list[tuple]:
        out = []
        for b, i, j in by_bucket(self.key >> np.uint64(32)):
            texts = self.texts[i:j]
            length = np.fromiter(map(len, texts), np.uint32, j - i)
            out.append((TEXTS, b, shard, pack(self.key[i:j].astype(np.uint32)), pack(self.many[i:j].astype(np.uint8)), pack(length), pack(self.least[i:j]), squeeze(b"".join(texts))))
        return out

    def repeated(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Window starts [from, to) that a smaller id has too."""
        first = {b: i for b, i, _ in by_bucket(self.key >> np.uint64(32))}
        told = [np.stack([first[r[1]] + unpack(r[3], np.uint32).astype(np.int64), unpack(r[4], np.uint8), unpack(r[5], np.uint8), unpack(r[6], np.int64)], axis=1) for r in rows if r[0] == TEXTS]
        told = np.concatenate(told) if told else np.zeros((0, 4), np.int64)
        told = told[np.argsort(told[:, 0], kind="stable")]
        # all windows of a run go if this shard holds its text under a smaller id
        local = np.flatnonzero(self.least[self.of] < self.ids)
        lo, hi = np.searchsorted(told[:, 0], self.of, "left"), np.searchsorted(told[:, 0], self.of, "right")
        many = hi - lo
        each = np.repeat(np.arange(len(many)), many)
        row = told[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        ok = row[:, 3] < self.ids[each]
        a = (self.start[each] + row[:, 1])[ok]
        return np.append(self.start[local], a), np.append((self.start + self.size)[local], a + row[ok, 2])


def settle_texts(table: pa.Table, least_ids: Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]) -> pa.Table:
    """For each shard: the windows of its runs that have a smaller id elsewhere.

    Equal texts are found by the texts themselves. A key with one text needs no more; the texts of
    the others are compared window by window by ``least_ids`` (distinct texts in order of their
    keys, smallest ids, keys), which returns each window's smallest id under the key.
    """
    got = received(table)
    index: dict[bytes, int] = {}
    of, sizes = [], []
    for r in got:
        end = np.cumsum(unpack(r[5], np.uint32).astype(np.int64))
        data = expand(r[7])
        of.append(np.fromiter((index.setdefault(data[a:b], len(index)) for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)), np.int64, len(end)))
        sizes.append(len(end))
    ids = [unpack(r[6], np.int64) for r in got]
    every, of_all = np.concatenate(ids), np.concatenate(of)
    least = np.full(len(index), NO_ID)
    np.minimum.at(least, of_all, every)
    key = np.zeros(len(index), np.uint32)
    key[of_all] = np.concatenate([unpack(r[3], np.uint32) for r in got])
    size = np.zeros(len(index), np.int64)
    size[of_all] = np.concatenate([unpack(r[4], np.uint8) for r in got])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    mixed = order[np.append(same, False) | np.append(False, same)]
    texts = list(index)
    del index
    parts = dict(zip(mixed.tolist(), least_ids([texts[i] for i in mixed.tolist()], least[mixed], key[mixed].astype(np.uint64)), strict=True)) if len(mixed) else {}
    del texts
    out = []
    for r, own, mine in zip(got, of, ids, strict=True):
        whole = ~np.isin(own, mixed) & (least[own] < mine)
        at = np.flatnonzero(whole)
        nth, start, many, told = [at], [np.zeros(len(at), np.int64)], [size[own[at]]], [least[own[at]]]
        for i in np.flatnonzero(np.isin(own, mixed)).tolist():
            x = parts[int(own[i])]
            edge = bounds(x)
            less = x[edge] < mine[i]
            if less.any():
                nth.append(np.full(int(less.sum()), i))
                start.append(edge[less])
                many.append(np.diff(np.append(edge, len(x)))[less])
                told.append(x[edge][less])
        if sum(map(len, nth)):
            nth, start, many, told = map(np.concatenate, (nth, start, many, told))
            out.append((TEXTS, r[1], r[2], pack(nth.astype(np.uint32)), pack(start.astype(np.uint8)), pack(many.astype(np.uint8)), pack(told)))
    return message(out)


def covered(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> list[list[list[int]]]:
    """The union of the ranges [a, b) as maximal ranges of each row, from the row's start.

    Rows are [first[i], first[i + 1]); no range leaves its row. Ranges that touch are one.
    """
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    row = np.searchsorted(first, a, "right") - 1
    end = np.maximum.accumulate(b) if len(b) else b
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] > end[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    stop = end[np.append(at[1:], len(a)) - 1] if len(at) else at
    out: list[list[list[int]]] = [[] for _ in range(len(first) - 1)]
    for r, x, y, base in zip(row[at].tolist(), a[at].tolist(), stop.tolist(), first[row[at]].tolist(), strict=True):
        out[r].append([x - base, y - base])
    return out


def outside(spans: list[list[int]], n: int):
    """(first, after last) of what the spans leave of n."""
    return [(a, b) for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], n], strict=True) if a < b]


def repeats(
    docs: DataFrame, id_col: str, text_col: str, carry: list[str], *,
    runs_of: Callable[[Rows], Runs], least_ids: Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]],
    remove: Callable[[Rows, Runs, np.ndarray, np.ndarray], dict[str, pa.Array]], result: str, hot: int, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Run the three passes. ``carry`` columns come back unchanged in the struct ``carried``.

    ``remove`` is given the window starts [from, to) that go.
    """
    n = pieces(docs, shard_bytes)  # of the whole table: a projection is guessed too small
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), carried.alias("carried"),
    )
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    sharded = rows.groupBy("shard")

    def first(key, table):
        r = Rows(table)
        runs = runs_of(r)
        out = send_keys(key[0].as_py(), runs.key, runs.row, r.ids, n)
        trim()
        return out

    def second(key, left, right):
        got = received(right)
        if not left.num_rows or not got:
            return message([])
        r = Rows(left)
        out = message([*got, *Shared(r, runs_of(r), got, n).send(key[0].as_py())])
        trim()
        return out

    def between(key, table):
        if key[0].as_py() == FLAGS:
            return table.select(list(_COLUMNS))
        out = settle_texts(table, least_ids)
        trim()
        return out

    def third(key, left, right):
        if not left.num_rows:
            return _empty(result_schema)
        r, got = Rows(left), received(right)
        runs = runs_of(r)
        a, b = Shared(r, runs, got, n).repeated(got) if got else (np.zeros(0, np.int64),) * 2
        out = {c: left[c].combine_chunks().take(pa.array(r.order)) for c in ("id", "carried")} | remove(r, runs, a, b)
        trim()
        return pa.table(out)

    # the type as it is, so that what can't be null stays so
    result_schema = StructType([*StructType().add("id", "long").add("carried", rows.schema["carried"].dataType).fields, *StructType.fromDDL(result).fields])
    flags = sharded.applyInArrow(first, EXCHANGE).groupBy("bucket").applyInArrow(lambda t: share_keys(t, hot), EXCHANGE)
    sent = sharded.cogroup(flags.groupBy("shard")).applyInArrow(second, EXCHANGE)
    back = sent.groupBy("kind", "bucket").applyInArrow(between, EXCHANGE)
    return sharded.cogroup(back.groupBy("shard")).applyInArrow(third, result_schema)


def _empty(schema: StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()
