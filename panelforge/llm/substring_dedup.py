"""Word-level removal of repeated passages by recompression.

Recompression replaces, round after round, runs of one symbol and then adjacent pairs (left
symbol from one half of the alphabet, right symbol from the other) by new symbols. A new symbol's
name is a function of what it replaces, so every executor gives equal runs and pairs the same
name without a dictionary, and whether a pair is replaced depends on the pair alone: the inside
of a passage is parsed alike wherever it stands. Each symbol keeps the range of words that its
parse depends on. A window's interior symbols are those whose range lies in the window; the
highest of them is the window's key. Spark gathers the symbols of all documents
(:mod:`panelforge.llm.repeats`): windows whose highest symbol another document shares are
candidates, and these are verified on their words. A clash of names makes a candidate, no match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import join_names, mix
from .repeats import Rows, Runs, covered, outside, repeats

#: Symbols of later rounds depend on more than a window's words, but for few.
ROUNDS = 2
#: Uses of a key from which its windows have keys of their own.
HOT_USES = 100_000
_RUN, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Words:
    """The words of a shard, one after the other and parted by one space, and their names."""

    def __init__(self, rows: Rows):
        lines, names, sizes, n = [], [], [], []
        for t in rows.texts:
            w = t.split()
            n.append(len(w))
            if w:
                lines.append(b" ".join(w))
                names.append(np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w)))
                sizes.append(np.fromiter(map(len, w), np.int32, len(w)))
        self.line = b" ".join(lines)
        self.names = np.concatenate(names) if names else np.zeros(0, np.uint64)
        self.n = np.array(n, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(sizes) + 1, dtype=np.int64)]) if sizes else np.zeros(1, np.int64)
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), self.n)

    def starts(self, length: int) -> np.ndarray:
        """Where a window of ``length`` words of one document starts."""
        size = np.maximum(self.n - length + 1, 0)
        return np.arange(size.sum()) + np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)

    def text(self, a: int, b: int) -> bytes:
        """Words [a, b), parted by one space."""
        return self.line[self.at[a] : max(self.at[a], self.at[b] - 1)]


def span_names(names: np.ndarray, length: int) -> np.ndarray:
    """The name of the ``length`` words from each position on."""
    n = len(names) - length + 1
    if n <= 0:
        return names[:0]
    out, at, power, size = None, 0, names, 1
    while at < length:
        if length & size:
            part = power[at : at + n]
            out = part if out is None else join_names(out, part)
            at += size
        if at < length:
            power = join_names(power[:-size], power[size:])
        size *= 2
    return out


_FAR = np.int32(1 << 30)


class Symbols:
    """A parse of all documents: names, word ranges [start, end), and ranges depended on [lo, hi).

    A range is without bound where the parse depends on an end of the document.
    """

    def __init__(self, names, start, end, lo, hi, doc):
        self.names, self.start, self.end, self.lo, self.hi, self.doc = names, start, end, lo, hi, doc

    @classmethod
    def words(cls, names: np.ndarray, doc: np.ndarray) -> Symbols:
        at = np.arange(len(names), dtype=np.int32)
        return cls(names, at, at + 1, at, at + 1, doc)

    def _reach(self) -> tuple[np.ndarray, np.ndarray]:
        """lo and hi with the left and the right neighbour's range."""
        same = self.doc[1:] == self.doc[:-1]
        lo, hi = np.full(len(self.lo), -_FAR, np.int32), np.full(len(self.hi), _FAR, np.int32)
        lo[1:] = np.where(same, np.minimum(self.lo[1:], self.lo[:-1]), -_FAR)
        hi[:-1] = np.where(same, np.maximum(self.hi[1:], self.hi[:-1]), _FAR)
        return lo, hi

    def _grouped(self, first: np.ndarray, names: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Symbols:
        """One symbol for each group that starts where ``first``."""
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(first)) - 1
        return Symbols(names, self.start[at], self.end[last], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), self.doc[at])

    def runs(self) -> Symbols:
        """Runs of a symbol; each symbol depends on its neighbours being others."""
        first = np.ones(len(self.names), bool)
        first[1:] = (self.names[1:] != self.names[:-1]) | (self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(first)))
        names = np.where(size > 1, join_names(self.names[at] ^ _RUN, size.astype(np.uint64)), self.names[at])
        lo, hi = self._reach()
        lo, hi = np.minimum(lo, self.lo), np.maximum(hi, self.hi)
        return self._grouped(first, names, lo, hi)

    def pairs(self, turn: int) -> Symbols:
        """A left and a right symbol join. Left ones depend on what follows, right ones on what precedes."""
        right = ((mix(self.names + np.uint64(turn)) >> np.uint64(17)) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(right), bool)  # with the symbol before
        joined[1:] = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        with_next = np.append(joined[1:], False)
        lo, hi = self._reach()
        lo, hi = np.where(right & ~joined, lo, self.lo), np.where(~right & ~with_next, hi, self.hi)
        at = np.flatnonzero(~joined)
        names = self.names[at]
        two = with_next[at]
        names[two] = join_names(self.names[at[two]] ^ _PAIR, self.names[at[two] + 1])
        return self._grouped(~joined, names, lo, hi)


def window_keys(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts and their keys: the highest symbol that depends on the window's words only."""
    starts = words.starts(length)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    names = words.names
    hashed = np.concatenate([[np.uint64(0)], np.cumsum(mix(names), dtype=np.uint64)])
    best = np.zeros(len(names) - length + 1, np.uint64)
    symbols = Symbols.words(names, words.row)
    for level in range(1, ROUNDS + 1):
        symbols = symbols.runs().pairs(level)
        at = np.flatnonzero(symbols.hi.astype(np.int64) - symbols.lo <= length)
        lo, hi, start = symbols.lo[at], symbols.hi[at], symbols.start[at]
        # the words depended on go into the key, which makes it rare
        key = join_names(symbols.names[at], hashed[hi] - hashed[lo])
        here = np.zeros(len(names), np.uint64)
        here[start] = (key >> np.uint64(2)) | np.uint64(level << 62)
        before, after = np.zeros(len(names), np.int16), np.full(len(names), length + 1, np.int16)
        before[start], after[start] = start - lo, hi - start
        for back in range(length):  # the window that starts so many words before the symbol
            part = np.where((before[back:] <= back) & (after[back:] <= length - back), here[back:], np.uint64(0))[: len(best)]
            np.maximum(best[: len(part)], part, out=best[: len(part)])
    best = best[starts]
    none = np.flatnonzero(best == 0)  # no interior symbol (runs of a word): the window itself
    if len(none):
        best[none] = span_names(names, length)[starts[none]] >> np.uint64(2)
    return starts, mix(best)


class WordRuns(Runs):
    def __init__(self, rows: Rows, length: int):
        self.length, self.words = length, Words(rows)
        starts, key = window_keys(self.words, length)
        row = self.words.row[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        self.cut(starts[at], np.diff(np.append(at, len(key))), key[at], row[at].astype(np.int64))

    def text(self, start: int, size: int) -> bytes:
        return self.words.text(start, start + size + self.length - 1)


def least_ids(texts: list[bytes], ids: np.ndarray, keys: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text the smallest id that each of its windows has among texts of its key, by the words."""
    out: list[np.ndarray] = []
    group: list[list[bytes]] = []
    least: dict[bytes, int] = {}

    def close() -> None:
        out.extend(np.array([least[w] for w in windows], np.int64) for windows in group)
        group.clear()
        least.clear()

    for i, (text, own) in enumerate(zip(texts, ids.tolist(), strict=True)):
        if i and keys[i] != keys[i - 1]:
            close()
        at = [0, *[k + 1 for k, c in enumerate(text) if c == 32], len(text) + 1]
        windows = [text[a : b - 1] for a, b in zip(at, at[length:], strict=False)]
        for w in windows:
            if least.get(w, own) >= own:
                least[w] = own
        group.append(windows)
    close()
    return out


def remove_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, carry: list[str] | None = None, hot_uses: int = HOT_USES,
) -> DataFrame:
    """Remove every word covered by a ``length``-word window that starts in a smaller id too.

    Words are runs of bytes other than ASCII white space. Returns one row per input row: ``id``,
    ``carried`` (a struct of the columns ``carry``), ``kept`` (the words left, joined by one space),
    ``n_words``, ``n_removed`` and ``spans`` (removed runs, in words, as [first, after last]).

    Null or empty text: no words, ``kept`` is empty. Texts of fewer words than ``length`` keep all.
    Rows with the same id never remove each other's words (repeated rows stay alike); a null id
    ranks after all ids. An empty table gives an empty result. Columns that are not named are
    ignored, whatever their names. One document is held whole by one task, at about thirty times
    its size.
    """

    def remove(rows: Rows, runs: WordRuns, a: np.ndarray, b: np.ndarray):
        words = runs.words
        spans = covered(a, b + length - 1, words.first)
        kept = [b" ".join([words.text(f + x, f + y) for x, y in outside(s, n)]) for s, f, n in zip(spans, words.first.tolist(), words.n.tolist(), strict=False)]
        return {
            "kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(words.n),
            "n_removed": pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
        }

    return repeats(
        docs, id_col, text_col, carry or [], runs_of=lambda rows: WordRuns(rows, length), least_ids=lambda t, i, k: least_ids(t, i, k, length), remove=remove,
        result="kept string, n_words long, n_removed long, spans array<array<long>>", hot=hot_uses,
    )


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, i, list_slice(words, i, i + 12) AS gram FROM s),
m AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
d AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN m ON g.gram = m.gram AND m.least < g.doc_id),
x AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM d GROUP BY doc_id),
k AS (SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
  CASE WHEN x.doc_id IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS kept
  FROM w LEFT JOIN x ON w.doc_id = x.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
