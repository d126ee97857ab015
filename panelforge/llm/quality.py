"""Document quality by gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

import re
from itertools import groupby
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import boosting
from .common import crc_mod, table

#: Rows that a model is fitted on at most, spread over the labelled rows by a hash of their id.
MAX_ROWS = 20_000
STATISTICS = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "longest_run", "repeats_in_a_row", "symbols", "symbol_words",
    "digits", "capitals", "capital_words", "exclamations", "stops", "commas", "line_length", "repeated_lines", "non_ascii", "entropy",
    "long_words", "short_words", "repeated_bigrams", "links",
)
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 above ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_SYMBOL_WORD = re.compile(rb"[#$%&*+/<=>@\[\\\]^_`{|}~!]{2,}")
_LINK = re.compile(rb"https?://|www\.")


def statistics(text: bytes | None) -> list[float]:
    """The :data:`STATISTICS` of a text; an empty one has zeros."""
    text = text or b""
    words = text.split()
    n, w = len(text), len(words)
    if not w:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, 6)
    p = counts[counts > 0] / n
    seen = Counter(words)
    runs = [len(list(g)) for _, g in groupby(words)]
    lengths = np.fromiter(map(len, words), np.int64, w)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = max(1.0, kinds[1] + kinds[2] + kinds[5])
    return [
        np.log1p(n), np.log1p(w), lengths.mean(), len(seen) / w, max(seen.values()) / w, max(runs) / w, 1 - len(runs) / w, kinds[4] / n,
        len(_SYMBOL_WORD.findall(text)) / w, kinds[3] / n, kinds[2] / letters, sum(map(bytes.isupper, words)) / w, counts[33] / w, counts[46] / w, counts[44] / w,
        n / len(lines), 1 - len(set(lines)) / len(lines), kinds[5] / n, float(-(p * np.log2(p)).sum()),
        float((lengths > 20).mean()), float((lengths < 3).mean()), 1 - pairs / max(1, w - 1), len(_LINK.findall(text)) / w,
    ]


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) for at most about ``max_rows`` labelled rows where ``learn`` holds, picked by a hash of the id.

    A document with several labels counts with the smallest. The picked ids are few, so they and
    not the documents are sent around.
    """
    y = labels.filter(F.col(target).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(id_col).agg((F.min(target) > 0).cast("int").alias("y"))
    many = y.count()
    if many > max_rows:
        y = y.filter(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / many)))
    return docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(y), id_col).select(F.col("text"), "y")


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", learn: Column | None = None, max_rows: int = MAX_ROWS) -> boosting.Trees:
    """Fit on a bounded sample of the labelled documents; the statistics are taken where the texts are."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column(0).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), b.column(1)], ["x", "y"])

    sample = labelled_sample(docs, labels, target, F.lit(True) if learn is None else learn, max_rows)
    got = sample.mapInArrow(run, "x binary, y int").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, len(STATISTICS)).astype(np.float64)
    y = got["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the model doesn't depend on the order of arrival
    return boosting.fit(x[order], y[order])


def score_quality(docs: DataFrame, model: boosting.Trees, text_col: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) as a further column; a column of that name is replaced.

    Null and empty texts are scored by their (zero) statistics like others, texts of any length
    whole; repeated rows have equal scores; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    at = kept.index(text_col)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(at).cast(pa.binary()).to_pylist()).astype(np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], [*b.schema.names, column])

    from pyspark.sql.types import DoubleType, StructType

    own = docs.select(*[F.col(f"`{c}`") for c in kept])
    return own.mapInArrow(run, StructType([*own.schema.fields]).add(column, DoubleType()))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, learn=crc_mod("doc_id", 5) != 0)
    scored = score_quality(docs.select("doc_id", "text"), model)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
