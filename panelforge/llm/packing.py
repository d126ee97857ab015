"""Best-fit packing of tokenised documents by fitting packing patterns to the length histogram.

Tokenising and cutting is a map over the documents. All planning works on the histogram of piece
lengths (one count per length, however many documents): patterns of two or three lengths that fill
a sequence exactly are enumerated, non-negative least squares fits how often each is used, the
counts are rounded down to what the histogram holds, and best fit packs the rest. A piece finds its
place from its length and its rank among the pieces of that length; ranks are counted within
buckets of a length, so a length that many pieces share is no single task.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, table, trim

CAPACITY = 2048
#: Pieces whose ids a Python worker remembers, twice: those in use and those used before them.
_CACHED = 100_000
#: Bytes of text that are tokenised together.
_SLICE = 2 << 20
#: Pieces of one length that one task ranks, about.
_RANKED = 2_000
#: Words of letters that one call encodes.
_TOGETHER = 10_000
#: Letters that the tokenizer's normalizer leaves as they are (a-z and those of Latin-1).
_SMALL = "a-z\u00df-\u00f6\u00f8-\u00ff"
_LETTERS = re.compile(f"[{_SMALL}]+").fullmatch
#: ASCII punctuation (no apostrophe) that is a word of its own behind a letter or digit.
_TAIL = "".join(c for c in string.punctuation if c != "'")


def _laid(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[start : start + size]`` of every row, one after the other."""
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


class Ids:
    """Token ids of white-space-free words.

    The tokenizer drops white space and lower-cases, so words are independent and upper case ASCII
    letters don't matter; punctuation behind an ASCII letter or digit is matched by itself. Words
    that may hold a special token are left as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.known, self.before = Tokenizer.from_file(path), {}, {}
        self.letters = Tokenizer(self.tokenizer.model)  # for runs of small letters, which the rest of the pipeline leaves as they are
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        odd = [x for x in parts if not _LETTERS(x)]
        out = {x: np.array(e.ids, "<u4").tobytes() for x, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True)}
        parts = [x for x in parts if x not in out]
        for i in range(0, len(parts), _TOGETHER):
            some = parts[i : i + _TOGETHER]
            made = self.letters.encode(" ".join(some), add_special_tokens=False)
            ids, end = np.array(made.ids, "<u4").tobytes(), (np.cumsum(np.bincount(made.word_ids, minlength=len(some))) * 4).tolist()
            out |= {x: ids[a:b] for x, a, b in zip(some, [0, *end], end, strict=False)}
        return out

    def _of(self, parts: pa.Array) -> list[bytes]:
        parts = parts.to_pylist()
        known, before = self.known, self.before
        made = self._new([x for x in parts if x not in known and x not in before])
        out = [made[x] if x in made else known[x] if x in known else before[x] for x in parts]
        if len(known) + len(made) > _CACHED:
            self.known, self.before = {}, known
        self.known.update(zip(parts, out, strict=True))
        return out

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: all their ids, and each one's first id and number of ids."""
        special = pc.match_substring(words, "<|")
        low = pc.if_else(special, words, pc.ascii_lower(words))
        core = pc.ascii_rtrim(low, characters=_TAIL)
        plain = pc.and_(pc.match_substring_regex(core, f"[0-9{_SMALL}]$"), pc.invert(special))
        core = pc.if_else(plain, core, low)
        tail = pc.replace_substring_regex(pc.if_else(plain, low, ""), f"^.*[^{re.escape(_TAIL)}]", "")
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        ids = self._of(both.dictionary)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        start = np.cumsum(size) - size
        at = both.indices.to_numpy().reshape(2, -1).T.reshape(-1)  # a word's core and tail in turn
        many = size[at].reshape(-1, 2).sum(axis=1)
        return _laid(flat, start[at], size[at]), np.cumsum(many) - many, many

    def documents(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), each followed by ``end_id``, and where each text's ids end."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        last = lists.offsets.to_numpy()
        words = lists.values.slice(last[0], last[-1] - last[0]).dictionary_encode()
        flat, start, size = self.words(words.dictionary)
        flat, start, size = np.append(flat, np.uint32(end_id)), np.append(start, len(flat)), np.append(size, 1)
        code = np.insert(words.indices.to_numpy(), last[1:] - last[0], len(size) - 1)
        ends = np.cumsum(size[code])[last[1:] - last[0] + np.arange(len(texts))]
        return np.ascontiguousarray(_laid(flat, start[code], size[code]), "<u4"), ends


@cache
def _ids(path: str) -> Ids:
    """One per Python worker: a worker runs many tasks, and most of their words are the same."""
    return Ids(path)


def slices(texts: pa.Array, most: int):
    """(first, after last) of stretches of about ``most`` bytes, of one text at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    of = np.cumsum(size, dtype=np.int64) // most
    edge = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(size)] if len(size) else [0]
    return zip(edge, edge[1:], strict=False)


def pieces_of(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32. ``tokenizer`` is a file that every executor has."""

    def run(batches):
        ids = _ids(tokenizer)
        for b in batches:
            for i, j in slices(b.column(1), _SLICE):
                flat, ends = ids.documents(b.column(1).slice(i, j - i), end_id)
                first = np.append(0, ends[:-1])
                many = -(-(ends - first) // capacity)
                doc = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(ends[doc] - first[doc] - start, capacity)
                data, at = memoryview(flat.tobytes()), (first[doc] + start) * 4
                crc = [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"])
            trim()

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def patterns(count: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths a >= b >= c (c may be 0) that occur and fill a sequence exactly."""
    have = count > 0
    lengths = np.flatnonzero(have)
    a = lengths[:, None]
    two = np.array([(x, capacity - x, 0) for x in lengths.tolist() if 2 * x >= capacity and x < capacity and have[capacity - x]], np.int64).reshape(-1, 3)
    b = lengths[None, :]
    c = capacity - a - b
    ok = (a >= b) & (c <= b) & (c > 0)
    x, y = np.nonzero(ok)
    z = capacity - lengths[x] - lengths[y]
    keep = have[z]
    return np.concatenate([two, np.stack([lengths[x], lengths[y], z], axis=1)[keep]])


def fit(count: np.ndarray, rows: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |sum of patterns - histogram|^2: accelerated projected gradient."""
    if not len(rows):
        return np.zeros(0)
    n = len(count)
    used = (rows > 0).astype(float)

    def times(x):
        return np.bincount(rows.ravel(), (used * x[:, None]).ravel(), n)

    def back(r):
        return (r[rows] * used).sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(12):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(times(v))))
    target = count.astype(float)
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - target))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences); uses up the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(left, capacity)
    x = fit(left, rows)
    for i in np.argsort(-x, kind="stable").tolist():
        if x[i] < 0.5:
            break
        lengths, uses = np.unique(rows[i][rows[i] > 0], return_counts=True)
        n = min(int(x[i] + 0.5), int((left[lengths] // uses).min()))
        if n > 0:
            left[lengths] -= n * uses
            out.append((tuple(int(v) for v in rows[i] if v), n))
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence that has room; equal ones are moved together."""
    room: dict[int, list[list]] = defaultdict(list)  # free tokens -> [lengths, how many]
    free = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                # new sequences hold as many of this length as go in
                each = min(capacity // length, n)
                many = n // each
                kept = capacity - each * length
                room[kept].append([(length,) * each, many])
                free[kept] = True
                n -= each * many
                continue
            gap = length + int(fits[0])
            groups = room[gap]
            lengths, many = groups[-1]
            take = min(many, n)
            if take == many:
                groups.pop()
                free[gap] = bool(groups)
            else:
                groups[-1][1] -= take
            room[gap - length].append([(*lengths, length), take])
            free[gap - length] = True
            n -= take
    return [(lengths, many) for groups in room.values() for lengths, many in groups]


def slots(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, in order of rank: first rank, first sequence, offset of every stretch of slots."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, many in made:
        at = 0
        for length in lengths:
            out[length].append((int(used[length]), sequence, at))
            used[length] += many
            at += length
        sequence += many
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def packed(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0,
) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Longer ones
    than ``capacity`` are cut. Offsets of a sequence are gapless from 0. Rows with a null or a
    repeated id are packed like others; an empty table gives an empty result; texts of any length
    are tokenised whole. Other columns are ignored.
    """
    made = checkpointed(pieces_of(docs, id_col, text_col, tokenizer, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    place = slots(plan(histogram, capacity), capacity)
    buckets = 1 + max(histogram.values(), default=0) // _RANKED
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(inside) - 1).join(counts, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("nth")).alias("rank"))

    def seat(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                first, base, place_in = place[k]
                i = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = base[i] + rank[at] - first[i], place_in[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(seat, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
