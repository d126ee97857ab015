"""Statistics, weights, least squares and the pipeline's first stage against independent versions of them."""

import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from panelforge.llm import boosting, packing, quality, toxicity

TEXTS = [
    "", " \n ", "One two two. THREE, four!\nfive\n\nfive", "### $$$ a%%%b ***c", "http://a.b www.c.d https://e " * 3, "é" * 40 + " über Straße 12 345", "word " * 500, "a b a b a b a b c", "A" * 30 + " b!!! ?? x<>y", "line\nline\nline\nother, one.",
]


def plainly(text):
    """Each statistic from its meaning, byte by byte."""
    data = text.encode()
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", data) if w]
    if not words:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    n, w = len(data), len(words)
    is_in = lambda b, s: chr(b) in s
    low, up = sum(97 <= b <= 122 for b in data), sum(65 <= b <= 90 for b in data)
    high = sum(b >= 128 for b in data)
    symbols = "#$%&*+/<=>@[\\]^_`{|}~"
    runs = [1]
    for a, b in zip(words, words[1:], strict=False):
        runs[-1:] = [runs[-1] + 1] if a == b else [runs[-1], 1]
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = [data.count(bytes([b])) / n for b in set(data)]
    capital = lambda x: any(65 <= b <= 90 for b in x) and not any(97 <= b <= 122 for b in x)
    return {
        "log_bytes": math.log(n + 1), "log_words": math.log(w + 1), "word_length": sum(map(len, words)) / w, "distinct_words": len(set(words)) / w, "top_word": max(map(words.count, set(words))) / w, "longest_run": max(runs) / w,
        "repeats_in_a_row": sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, "symbols": sum(is_in(b, symbols) for b in data if b < 128) / n, "symbol_words": len(re.findall(rb"[#$%&*+/<=>@\[\\\]^_`{|}~!]{2,}", data)) / w,
        "digits": sum(48 <= b <= 57 for b in data) / n, "capitals": up / max(1, low + up + high), "capital_words": sum(map(capital, words)) / w, "exclamations": data.count(b"!") / w, "stops": data.count(b".") / w, "commas": data.count(b",") / w,
        "line_length": n / len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines), "non_ascii": high / n, "entropy": -sum(p * math.log2(p) for p in shares), "long_words": sum(len(x) > 20 for x in words) / w,
        "short_words": sum(len(x) < 3 for x in words) / w, "repeated_bigrams": 1 - len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / max(1, w - 1), "links": len(re.findall(rb"https?://|www\.", data)) / w}


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    got = dict(zip(quality.STATISTICS, quality.statistics(text.encode()), strict=True))
    assert got == pytest.approx(plainly(text), abs=1e-12)


def test_quality_query_against_its_definition(spark):
    """Every document's score: its statistics by definition, down each tree node by node, of a model that held-out rows can't change."""
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    learn = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    stats = lambda t: np.array([plainly(t or "")[k] for k in quality.STATISTICS]).astype(np.float32).astype(float)
    x, y = np.array([stats(docs[r["doc_id"]]) for r in learn]), np.array([r["quality"] for r in learn], float)
    order = np.lexsort((*x.T, y))
    model = boosting.fit(x[order], y[order])
    for r in __spark_entry__.queries()["op3_quality_classifier"](spark, sf).collect():
        total, row = model.start, stats(docs[r["doc_id"]])
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_scores_against_sums(spark):
    pick = random.Random(4)
    words = ["idiot", "idiots", "you", "women", "über", "trash", "a", "x1y"]
    weights = {f: pick.uniform(-2, 2) for w in words for f in (w, w[:4] + "-", w[:5] + "-") if pick.random() < 0.7}
    model = toxicity.Model(weights, -0.3)
    texts = [" ".join(pick.choices(words, k=pick.randint(0, 9))).title() for _ in range(200)] + [None, ""]
    got = {r["id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        own = {w for w in re.split(r"[\W\d_]+", (t or "").lower()) if w}
        margin = -0.3 + sum(weights.get(f, 0.0) for f in {f for w in own for f in (w, w[:4] + "-", w[:5] + "-")})
        assert got[i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)


def test_weights_against_plain_descent():
    """The objective of the fit is as low as many small plain steps get it, with swaps and without."""
    pick = np.random.default_rng(3)
    rows = [np.sort(pick.choice(6, pick.integers(1, 5), replace=False)) for _ in range(40)]
    y = np.array([float(0 in r or pick.random() < 0.2) for r in rows])
    swaps = [np.array(sorted(set((set(r.tolist()) - {4}) | {5}))) if 4 in r else None for r in rows]

    def loss(w, b, fairness):
        z = np.array([w[r].sum() + b for r in rows])
        change = [w[r].sum() - w[s].sum() for r, s in zip(rows, swaps, strict=True) if s is not None]
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.025 * (w @ w) + fairness * float(np.sum(np.square(change)))

    for fairness in (0.0, 1.0, 5.0):
        w, b = toxicity.fit_logistic(rows, y, swaps, 6, fairness=fairness, rounds=1500)
        best, bias = np.zeros(6), 0.0
        for _ in range(6000):
            z = np.array([best[r].sum() + bias for r in rows])
            d = 1 / (1 + np.exp(-z)) - y
            g = 0.05 * best
            for r, s, e in zip(rows, swaps, d, strict=True):
                np.add.at(g, r, e)
                if s is not None:
                    c = best[r].sum() - best[s].sum()
                    np.add.at(g, r, 2 * fairness * c)
                    np.add.at(g, s, -2 * fairness * c)
            best, bias = best - 0.005 * g, bias - 0.005 * d.sum()
        assert loss(w, b, fairness) <= loss(best, bias, fairness) + 0.02
    assert abs(w[4] - w[5]) < 0.05  # what is swapped has nearly the same weight


def test_pattern_counts_against_all_active_sets():
    """Non-negative least squares by trying every set of patterns that may be used."""
    pick = np.random.default_rng(5)
    for _ in range(25):
        capacity = int(pick.integers(6, 12))
        count = np.zeros(capacity + 1, np.int64)
        count[pick.choice(np.arange(1, capacity), int(pick.integers(2, 5)), replace=False)] = pick.integers(1, 9)
        rows = packing.patterns(count, capacity)
        if not 0 < len(rows) <= 9:
            continue
        a = np.zeros((capacity + 1, len(rows)))
        for j, r in enumerate(rows):
            for length in r[r > 0]:
                a[length, j] += 1
        best = float(count @ count)
        for n in range(1, len(rows) + 1):
            for some in combinations(range(len(rows)), n):
                x = np.linalg.lstsq(a[:, some], count.astype(float), rcond=None)[0]
                if (x >= -1e-9).all():
                    best = min(best, float(np.square(a[:, some] @ x - count).sum()))
        x = packing.fit(count, rows, rounds=4000)
        assert (x >= 0).all() and np.square(a @ x - count).sum() == pytest.approx(best, abs=1e-3)
