"""Cross-sections: ranks, percentiles, top-n, rank IC, quantile buckets, turnover, screening."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

DAYS = "formula string, trade_date string, rows long, n long, ic double, dispersion double, spread double, top_set array<string>, monotonicity double"


def average_rank(x: str, *by: str) -> Column:
    """Rank from 1, ties share their mean."""
    w = Window.partitionBy(*by).orderBy(x)  # a count up to here takes ties in
    return (F.rank().over(w) + F.count("*").over(w)) / 2


def percentile_of(x: str, *by: str) -> Column:
    """Share of values not above the row's, among rows with a value."""
    return F.when(F.col(x).isNotNull(), F.cume_dist().over(Window.partitionBy(*by, F.col(x).isNull()).orderBy(x)))


def top(df: DataFrame, x: str, n: int, by: str = "trade_date", tie: str = "ts_code") -> DataFrame:
    """The ``n`` largest of each group with their ``rank``; the row limit is applied before the shuffle too."""
    w = Window.partitionBy(by).orderBy(F.desc(x), tie)
    return df.filter(F.col(x).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def forward_return(bars: DataFrame, horizon: int) -> DataFrame:
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    return bars.withColumn("forward_return", F.try_divide(F.lead("raw_close", horizon).over(w), F.col("raw_close")) - 1)


def long_form(df: DataFrame, names: list[str], dealt: bool = True) -> DataFrame:
    """One row per key and formula: all formulas are screened in one plan.

    Rows are dealt out by date first, so the shuffle has a row a key, not one a key and formula.
    """
    df = df.select("trade_date", "ts_code", "forward_return", *names)
    df = df.repartition("trade_date") if dealt else df
    pairs = F.array(*[F.struct(F.lit(n).alias("formula"), F.col(n).alias("factor_value")) for n in names])
    return df.select("trade_date", "ts_code", "forward_return", F.explode(pairs).alias("p")).select("trade_date", "ts_code", "forward_return", "p.*")


def by_date(scored: DataFrame, buckets: int = 5) -> DataFrame:
    """Per formula and date: rows, valid rows (``n``), ic, spread, dispersion, top_set and monotonicity.

    No shuffle where a (formula, date) is in one partition, as :func:`long_form` leaves it, and two sorts. The measures but ``rows`` and ``n`` are null on
    dates with under five values or only equal ones; ``top_set`` is empty there. Monotonicity is the
    rank correlation of bucket number and mean return: buckets lie between exact quantiles, equal
    edges merged, the lowest value in the first one; null under ten values or three buckets.
    """
    s = scored.withColumn("ok", F.col("factor_value").isNotNull() & F.col("forward_return").isNotNull())
    day = Window.partitionBy("formula", "trade_date", "ok")
    high = day.orderBy(F.desc("factor_value"))
    n = F.count("*").over(day)
    s = s.withColumns({
        "up": F.row_number().over(day.orderBy(F.desc("factor_value"), "ts_code")), "fall": (F.rank().over(high) + F.count("*").over(high)) / 2, "n": n,
        "lo": F.min("factor_value").over(day), "hi": F.max("factor_value").over(day)})
    low = day.orderBy("forward_return")
    s = s.withColumns({"rf": F.col("n") + 1 - F.col("fall"), "rr": (F.rank().over(low) + F.count("*").over(low)) / 2, "down": F.col("n") + 1 - F.col("up")})
    s = s.withColumn("q", F.expr("least(5, greatest(1, cast(floor(n / 5) as int)))"))
    edges = []
    for k in range(1, buckets):  # linear between the values around each quantile
        at = (F.col("n") - 1) * (k / buckets)
        below, above = F.floor(at), F.ceil(at)
        value = lambda i: F.max(F.when(F.col("down") == i + 1, F.col("factor_value"))).over(day)
        a, b = value(below), value(above)
        edges.append(F.when(a == b, a).otherwise((above - at) * a + (at - below) * b))
    s = s.withColumn("edges", F.array_distinct(F.array("lo", *edges, "hi")))
    s = s.withColumn("bucket", F.when(F.size("edges") > 1, F.size(F.filter(F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))), lambda e: e < F.col("factor_value")))))
    valid, fits = F.col("ok"), F.col("ok") & (F.col("n") >= 5) & (F.col("lo") < F.col("hi"))
    when = lambda c, x: F.when(c, F.col(x))
    out = s.groupBy("formula", "trade_date").agg(
        F.count("*").alias("rows"), F.count_if(valid).alias("n"),
        F.when(F.stddev_pop(when(fits, "rr")) > 0, F.corr(when(fits, "rf"), when(fits, "rr"))).alias("ic"), F.stddev_pop(when(fits, "factor_value")).alias("dispersion"),
        (F.avg(when(fits & (F.col("up") <= F.col("q")), "forward_return")) - F.avg(when(fits & (F.col("down") <= F.col("q")), "forward_return"))).alias("spread"),
        F.collect_set(when(fits & (F.col("up") <= F.col("q")), "ts_code")).alias("top_set"),  # five at most
        F.array_compact(F.array(*[F.avg(when(valid & (F.col("n") >= 10) & (F.col("bucket") == k), "forward_return")) for k in range(buckets)])).alias("means"))
    return out.withColumn("monotonicity", _rank_correlation_with_place(F.col("means"))).drop("means")


def _mean_ranks(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks from 1 in the sorted ``order``, ties share their mean."""
    s = x[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    size = np.diff(np.append(first, len(x)))
    out = np.empty(len(x))
    out[order] = np.repeat(first + (size + 1) / 2, size)
    return out


def _day(x: np.ndarray, r: np.ndarray, codes: pa.ChunkedArray, buckets: int) -> dict:
    """The measures of one formula on one date: values ``x`` and returns ``r``, both finite, in order of their ``codes``."""
    n = len(x)
    out = {"ic": None, "dispersion": None, "spread": None, "top_set": [], "monotonicity": None}
    if n < 5 or x.min() == x.max():
        return out
    order = np.argsort(-x, kind="stable")
    q = min(5, max(1, n // 5))
    a, b = -_mean_ranks(x, order), _mean_ranks(r, np.argsort(r, kind="stable"))
    a, b = a - a.mean(), b - b.mean()
    if b.any():
        out["ic"] = float(a @ b / np.sqrt((a @ a) * (b @ b)))
    out |= {"dispersion": float(x.std()), "spread": float(r[order[:q]].mean() - r[order[n - q :]].mean()), "top_set": codes.take(pa.array(order[:q])).to_pylist()}
    if n < 10:
        return out
    edges, up = [float(x.min())], x[order[::-1]]
    for k in range(1, buckets):  # linear between the values around each quantile
        at = (n - 1) * (k / buckets)
        below, above = int(np.floor(at)), int(np.ceil(at))
        lo, hi = float(up[below]), float(up[above])
        edges.append(lo if lo == hi else (above - at) * lo + (at - below) * hi)
    inner = list(dict.fromkeys([*edges, float(x.max())]))[1:-1]
    bucket = np.zeros(n, int)
    for e in inner:
        bucket += e < x
    held = np.bincount(bucket, minlength=buckets)
    means = (np.bincount(bucket, r, buckets)[held > 0] / held[held > 0]).tolist()
    mid = (len(means) - 1) / 2
    ranks = np.array([sum(y < m for y in means) + (means.count(m) - 1) / 2 - mid for m in means])
    places = np.arange(len(means)) - mid
    size = float((ranks @ ranks) * (places @ places))
    if len(means) >= 3 and size > 0:
        out["monotonicity"] = float(ranks @ places / np.sqrt(size))
    return out


def by_date_wide(df: DataFrame, names: list[str], buckets: int = 5) -> DataFrame:
    """What :func:`by_date` says of a column for each formula; values that aren't finite count as missing.

    One shuffle of a row a key, and one sort, by date. A group is the cross-section of a date as
    arrays; there are never rows for each formula.
    """
    def day(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["ts_code"]))
        values = lambda c: rows[c].to_numpy().astype(float, copy=False)  # noqa: E731  null becomes NaN
        r, out = values("forward_return"), []
        known = np.isfinite(r)
        for name in names:
            x = values(name)
            ok = known & np.isfinite(x)
            codes = rows["ts_code"] if ok.all() else rows["ts_code"].filter(pa.array(ok))
            out.append({"formula": name, "trade_date": key[0].as_py(), "rows": len(x), "n": int(ok.sum()), **_day(x[ok], r[ok], codes, buckets)})
        return pa.Table.from_pylist(out, schema=_DAYS)

    return df.select("trade_date", "ts_code", "forward_return", *names).groupBy("trade_date").applyInArrow(day, DAYS)


_DAYS = pa.schema([("formula", pa.string()), ("trade_date", pa.string()), ("rows", pa.int64()), ("n", pa.int64()), ("ic", pa.float64()), ("dispersion", pa.float64()), ("spread", pa.float64()), ("top_set", pa.list_(pa.string())), ("monotonicity", pa.float64())])


def _rank_correlation_with_place(means: Column) -> Column:
    """Spearman's correlation of a few values with their places; null for under three or without variation."""
    mid = (F.size(means) - 1) / 2
    ranks = F.transform(means, lambda x: F.size(F.filter(means, lambda y: y < x)) + (F.size(F.filter(means, lambda y: y == x)) - 1) / 2 - mid)
    places = F.transform(F.sequence(F.lit(0), F.size(means) - 1), lambda i: i - mid)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    both = total(F.zip_with(ranks, places, lambda x, y: x * y))
    size = total(F.transform(ranks, lambda x: x * x)) * total(F.transform(places, lambda x: x * x))
    return F.when((F.size(means) >= 3) & (size > 0), both / F.sqrt(size))


def turnover(days: DataFrame) -> DataFrame:
    """Per formula the mean Jaccard distance of the top sets of consecutive dates that have one; null for one date."""
    w = Window.partitionBy("formula").orderBy("trade_date")
    d = days.filter(F.size("top_set") > 0).select("formula", "trade_date", "top_set", F.lag("top_set").over(w).alias("before"))
    distance = 1 - F.size(F.array_intersect("top_set", "before")) / F.greatest(F.lit(1), F.size(F.array_union("top_set", "before")))
    return d.groupBy("formula").agg(F.avg(F.when(F.col("before").isNotNull(), distance)).alias("turnover_proxy"))


def fast_screen(scored: DataFrame, min_coverage: float = 0.1, min_dispersion: float = 0.0, min_abs_ic: float = 0.0) -> DataFrame:
    """One row per formula: coverage, IC statistics, spread, turnover, monotonicity and the verdict.

    An IC within 1e-12 of zero counts as neither positive nor negative. The panel is read once: all
    measures come from one row a formula and date.
    """
    return screened(by_date(scored), min_coverage, min_dispersion, min_abs_ic)


def screened(days: DataFrame, min_coverage: float = 0.1, min_dispersion: float = 0.0, min_abs_ic: float = 0.0) -> DataFrame:
    """:func:`fast_screen` from its rows a formula and date."""
    w = Window.partitionBy("formula", F.size("top_set") > 0).orderBy("trade_date")
    days = days.withColumn("before", F.when(F.size("top_set") > 0, F.lag("top_set").over(w)))
    distance = 1 - F.size(F.array_intersect("top_set", "before")) / F.greatest(F.lit(1), F.size(F.array_union("top_set", "before")))
    out = days.groupBy("formula").agg(
        (F.sum("n") / F.greatest(F.lit(1), F.sum("rows"))).alias("coverage"),
        F.avg("ic").alias("rank_ic_mean"), F.stddev_pop("ic").alias("rank_ic_std"), F.avg(F.when(F.col("ic") > 1e-12, 1.0).when(F.col("ic").isNotNull(), 0.0)).alias("positive_period_ratio"),
        F.avg(F.when(F.col("ic") < -1e-12, 1.0).when(F.col("ic").isNotNull(), 0.0)).alias("negative_period_ratio"), F.avg("spread").alias("top_bottom_spread"), F.avg("dispersion").alias("dispersion"),
        F.avg(F.when(F.col("before").isNotNull(), distance)).alias("turnover_proxy"), F.avg("monotonicity").alias("monotonicity_score"))
    reason = (
        F.when(F.col("coverage") < min_coverage, "low_coverage").when(F.col("dispersion").isNull() | (F.col("dispersion") < min_dispersion), "low_dispersion")
        .when(F.col("rank_ic_mean").isNull() | (F.abs("rank_ic_mean") < min_abs_ic), "weak_rank_ic"))
    out = out.withColumns({"rank_ic_ir": F.when(F.col("rank_ic_std") > 0, F.col("rank_ic_mean") / F.col("rank_ic_std")), "signal_stability": 1 - F.col("turnover_proxy"), "rejection_reason": reason})
    return out.withColumn("fast_screen_status", F.when(F.col("rejection_reason").isNull(), "passed").otherwise("rejected")).drop("dispersion")
