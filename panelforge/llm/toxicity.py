"""Toxicity by a counterfactually regularised classifier.

A logistic model over the presence of words and word beginnings. Labelled texts that mention a
group are also read with the mention swapped for another of its kind, and the fit penalises the
square of the score's change, so that the mention itself doesn't move the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_mod, table
from .quality import MAX_ROWS, labelled_sample

#: Features kept: those that the labels depend on most, if by more than chance among so many would.
MAX_FEATURES = 20_000
LEAST_DEPENDENCE = 24.0
#: Terms that name groups of people; those of a line are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("immigrant", "native"), ("immigrants", "natives"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
)
_SWAP = {t: line[(i + 1) % len(line)] for line in IDENTITY_TERMS for i, t in enumerate(line)}
_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 1 << 17


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> tuple[str, ...]:
    return (word, f"{word[:4]}-", f"{word[:5]}-")


def _all_features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def _swapped(words: set[str]) -> set[str] | None:
    return {_SWAP.get(w, w) for w in words} if not words.isdisjoint(_SWAP) else None


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        cache: dict[str, tuple[tuple[str, float], ...]] = {}

        def score(text: str | None) -> float:
            if len(cache) > _CACHED:
                cache.clear()
            hit: dict[str, float] = {}
            for w in words_of(text):
                found = cache.get(w)
                if found is None:
                    found = cache[w] = tuple((f, self.weights[f]) for f in features_of(w) if f in self.weights)
                if found:
                    hit.update(found)
            # summed in one order, whatever the order of the words
            margin = self.bias + sum(hit[f] for f in sorted(hit))
            return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

        return score


def fit_logistic(
    rows: list[np.ndarray], y: np.ndarray, swaps: list[np.ndarray | None], n: int, l2: float = 0.05, fairness: float = 1.0, rounds: int = 300,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + l2 |w|^2 + fairness * mean square change of the margin.

    ``rows``: indices of the features present; ``swaps``: those after swapping, or None.
    """
    size = np.array([len(r) for r in rows])
    of, col = np.repeat(np.arange(len(rows)), size), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    pair = [i for i, s in enumerate(swaps) if s is not None]
    d_of = np.concatenate([np.zeros(0, np.int64), *(np.full(len(rows[i]) + len(swaps[i]), k) for k, i in enumerate(pair))]).astype(np.int64)
    d_col = np.concatenate([np.zeros(0, np.int64), *(np.concatenate([rows[i], swaps[i]]) for i in pair)]).astype(np.int64)
    d_sign = np.concatenate([np.zeros(0), *(np.concatenate([np.ones(len(rows[i])), -np.ones(len(swaps[i]))]) for i in pair)])
    w, bias = np.zeros(n), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[col], len(rows)) + bias, -30, 30)))
        r = p - y
        g = np.bincount(col, r[of], n) + l2 * w
        if len(d_of):
            change = np.bincount(d_of, d_sign * w[d_col], len(pair))
            g += 2 * fairness * np.bincount(d_col, d_sign * change[d_of], n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * r.sum(), 0.999 * vb + 0.001 * r.sum() ** 2
        rate = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb) + 1e-8)
    return w, bias


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", learn: Column | None = None, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES,
) -> Model:
    """Fit on at most about ``max_rows`` labelled documents and the ``max_features`` most telling features.

    Without labels, or with one class only, the model is a constant.
    """
    sample = labelled_sample(docs, labels, target, F.lit(True) if learn is None else learn, max_rows)

    def explode(batches):
        for b in batches:
            f, y = [], []
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = _all_features(words_of(text))
                f += own
                y += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(y, pa.int32())], ["f", "y"])

    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = total["n"], total["p"]
    if not n or p in (0, n):
        share = 0.5 if not n else p / n * 0.998 + 0.001
        return Model({}, float(np.log(share / (1 - share))))
    counts = sample.mapInArrow(explode, "f string, y int").groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("p")).filter("n >= 4")
    expected = F.col("n") * F.lit(p / n)
    counts = counts.withColumn("depends", (F.col("p") - expected) ** 2 / expected).filter(F.col("depends") >= LEAST_DEPENDENCE)
    chosen = counts.orderBy(F.desc("depends"), "f").limit(max_features)
    names = sorted(r["f"] for r in chosen.select("f").collect())
    index = {f: i for i, f in enumerate(names)}

    def vectors(batches):
        for b in batches:
            own, other = [], []
            for text in b.column(0).to_pylist():
                words = words_of(text)
                own.append(sorted(index[f] for f in _all_features(words) if f in index))
                swap = _swapped(words)
                other.append(None if swap is None else sorted(index[f] for f in _all_features(swap) if f in index))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(other, kind), b.column(1)], ["own", "other", "y"])

    got = sorted(sample.mapInArrow(vectors, "own array<int>, other array<int>, y int").toArrow().to_pylist(), key=lambda r: (r["y"], r["own"], r["other"] or []))
    as_array = lambda x: np.array(x, np.int64)
    w, bias = fit_logistic([as_array(r["own"]) for r in got], np.array([r["y"] for r in got], float), [None if r["other"] is None else as_array(r["other"]) for r in got], len(names))
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, bias)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of every row; null and empty texts get the score of no features.

    Texts of any length are read whole, repeated rows have equal scores, an empty table gives an
    empty result. Other columns are ignored.
    """

    def run(batches):
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, learn=crc_mod("doc_id", 3) != 1)
    scored = score_toxicity(docs, model).withColumnRenamed("id", "doc_id")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
