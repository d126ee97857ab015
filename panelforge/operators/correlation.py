"""Rank correlations of all pairs of many columns, in blocks.

A pair is ranked on the rows that both columns have, of which every k-th by date and code is taken,
so that at most ``most`` remain. Columns that are null on the same rows form a class, and all pairs
of two classes have the same sample: it is taken once, each column is ranked on it once, and the
correlations of a block of columns with another are one matrix product. Two scans of the panel
serve any number of columns: one for which rows have what, one that takes the samples.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.lineage import checkpointed
from panelforge.schema import finite

#: Columns of a block: a task holds the samples of two.
BLOCK = 64
#: Values of the days that one task holds, unless a single day has more.
CELLS = 4_000_000
PAIRS = "a string, b string, correlation double"


def _has(names: list[str]) -> Column:
    """Which columns a row has, as a text of zeros and ones."""
    return F.concat(*[F.when(F.col(f"`{n}`").isNull(), "0").otherwise("1") for n in names])


def null_classes(patterns: DataFrame, names: list[str]) -> list[list[int]]:
    """Columns that the same rows have, by their place in ``names``; ``patterns`` holds the distinct ``has`` texts.

    Two columns are of one class if the patterns in which they are present have the same hashes
    (128 bits), added up without carries; one row comes to the driver, two numbers a column.
    """
    mark = [F.xxhash64("has"), F.xxhash64("has", F.lit("again"))]
    there = lambda i: F.substring("has", i + 1, 1) == "1"
    row = patterns.agg(*[F.coalesce(F.bit_xor(F.when(there(i), m)), F.lit(0)).alias(f"c{i}_{k}") for i in range(len(names)) for k, m in enumerate(mark)]).first()
    classes: dict[tuple, list[int]] = {}
    for i in range(len(names)):
        classes.setdefault((row[f"c{i}_0"], row[f"c{i}_1"]), []).append(i)
    return list(classes.values())


def _present(texts: pd.Series, first: list[int]) -> np.ndarray:
    """[row x class] of whether a row has the class's columns."""
    if not len(texts):
        return np.zeros((0, len(first)), bool)
    return np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), -1)[:, first] == ord("1")


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 down each column, ties share their mean."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    sorted_ = np.take_along_axis(x, order, axis=0)
    new = np.ones(x.shape, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    at = np.arange(n)[:, None]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=0)
    ends = np.vstack([new[1:], np.ones((1, x.shape[1]), bool)])
    last = np.minimum.accumulate(np.where(ends, at, n)[::-1], axis=0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=0)
    return out


def rank_correlations(wide: DataFrame, names: list[str], at_least: int = 10, most: int = 20_000, least: float = 0.0, block: int = BLOCK, written: bool = False) -> DataFrame:
    """(a, b, correlation) of all pairs of columns, ``a`` before ``b`` in ``names``.

    Values that aren't finite count as missing. Pairs with fewer than ``at_least`` common rows or
    without variation have no row, nor have those below ``least`` in size. A task holds the
    cross-sections of some days, or the samples of two blocks: ``most`` rows of twice ``block`` columns.
    ``wide`` is written once, unless it is ``written`` already: cheap to read twice.
    """
    if not names:
        return wide.sparkSession.createDataFrame([], PAIRS)
    panel = wide.filter("trade_date is not null").select("trade_date", "ts_code", *[finite(F.col(f"`{n}`").cast("double")).alias(n) for n in names])
    # the columns may be long formulas: they are computed once and written, both scans read them
    panel = panel.select("trade_date", "ts_code", *[F.col(f"`{n}`").alias(f"v{i}") for i, n in enumerate(names)], _has(names).alias("has"))
    panel = panel if written else checkpointed(panel)
    days = checkpointed(panel.groupBy("trade_date", "has").agg(F.count("*").alias("n")))
    classes = null_classes(days.select("has").distinct(), names)
    first = [c[0] for c in classes]
    sides = [(p, q) for p in range(len(classes)) for q in range(p, len(classes))]
    blocks = [[c[i : i + block] for i in range(0, len(c), block)] for c in classes]
    #: for each pair of classes, its pairs of blocks
    jobs = [[(x, y) for i, x in enumerate(blocks[p]) for y in (blocks[q][i:] if p == q else blocks[q])] for p, q in sides]
    number = np.cumsum([0, *map(len, jobs)])
    # several days go together while their values are few
    rows = days.agg(F.sum("n").alias("n")).first()["n"] or 0
    groups = max(-(-rows * len(names) // CELLS), 2 * wide.sparkSession.sparkContext.defaultParallelism)
    together = F.pmod(F.xxhash64("trade_date"), F.lit(groups)).alias("some_days")

    def count(key, some: pd.DataFrame) -> pd.DataFrame:
        there, n = _present(some["has"], first), some["n"].to_numpy()
        day, dates = pd.factorize(some["trade_date"], use_na_sentinel=False)
        each = np.stack([np.bincount(day, n * (there[:, p] & there[:, q]), len(dates)) for p, q in sides], axis=1)
        return pd.DataFrame({"trade_date": dates, "counts": each.astype(np.int64).tolist()})

    counted = days.withColumn("some_days", together).groupBy("some_days").applyInPandas(count, "trade_date string, counts array<long>")
    each = counted.select("trade_date", F.posexplode("counts").alias("side", "n"))
    w = Window.partitionBy("side").orderBy("trade_date")
    each = each.select("trade_date", "side", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("side")).alias("total"))
    places = each.groupBy("trade_date").agg(F.sort_array(F.collect_list(F.struct("side", "before", "total"))).alias("s"))  # a row for each pair of classes
    places = places.select("trade_date", F.transform("s", lambda x: x["before"]).alias("before"), F.transform("s", lambda x: x["total"]).alias("total"))

    def take(key, some: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame([], columns=["job", "n", "sample"])
        some = some.sort_values(["trade_date", "ts_code"], kind="stable")
        there = _present(some["has"], first)
        values = some[[f"v{i}" for i in range(len(names))]].to_numpy(float)
        day, dates = pd.factorize(some["trade_date"], use_na_sentinel=False)
        start = np.searchsorted(day, np.arange(len(dates)))  # days stand together, in order
        place = place.set_index("trade_date").loc[dates]
        before = np.array(place["before"].tolist())
        out = []
        for s, (p, q) in enumerate(sides):
            both = there[:, p] & there[:, q]
            earlier = np.cumsum(both) - both
            at = before[day, s] + earlier - earlier[start][day]
            step = max(1, place["total"].iloc[0][s] // most)
            rows = np.flatnonzero(both & (at % step == 0) & (at // step < most))
            if len(rows):
                out += [(int(number[s]) + k, len(rows), np.ascontiguousarray(values[np.ix_(rows, x + y)]).tobytes()) for k, (x, y) in enumerate(jobs[s])]
        return pd.DataFrame(out, columns=["job", "n", "sample"])

    samples = panel.groupBy(together).cogroup(places.groupBy(together)).applyInPandas(take, "job int, n int, sample binary")

    def correlate(key, parts: pd.DataFrame) -> pd.DataFrame:
        s = int(np.searchsorted(number, key[0], "right")) - 1
        x, y = jobs[s][key[0] - number[s]]
        sample = np.frombuffer(b"".join(parts["sample"]), float).reshape(-1, len(x) + len(y))
        if len(sample) < at_least:
            return pd.DataFrame([], columns=["a", "b", "correlation"])
        r = average_ranks(sample)
        r -= r.mean(axis=0)
        size = np.sqrt((r * r).sum(axis=0))
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (r[:, : len(x)].T @ r[:, len(x) :]) / np.outer(size[: len(x)], size[len(x) :])
        out = []
        for i, j in zip(*np.nonzero(np.abs(c) >= least), strict=True):  # not where a size is zero
            a, b = x[i], y[j]
            if x != y or a < b:  # a block with itself has each pair twice
                out.append((names[min(a, b)], names[max(a, b)], float(np.clip(c[i, j], -1, 1))))
        return pd.DataFrame(out, columns=["a", "b", "correlation"])

    return samples.groupBy("job").applyInPandas(correlate, PAIRS)
