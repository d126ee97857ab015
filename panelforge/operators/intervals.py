"""Joins of intervals with intervals, and the timeline of overlapping intervals.

Intervals are closed and hold days as yyyyMMdd. Both sides are cut into bins of so many days, so a
code with very many intervals is spread over its bins; of a pair that meets in several bins the one
in which the later of them starts counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Days of a bin.
BIN = 128


def day_number(day: str | Column) -> Column:
    """Days since 1970; null for what isn't a date."""
    return F.unix_date(F.try_to_date(F.col(day) if isinstance(day, str) else day, "yyyyMMdd"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str], bin_days: int = BIN) -> DataFrame:
    """All pairs of rows with equal ``keys`` whose intervals share a day.

    The columns of both sides, ``keys`` once; others must differ in name. Intervals with a null end
    or that end before they start overlap nothing.
    """
    def binned(df: DataFrame, ends: tuple[str, str], side: str) -> DataFrame:
        df = df.withColumns({f"_{side}0": day_number(ends[0]), f"_{side}1": day_number(ends[1])}).filter(F.col(f"_{side}0") <= F.col(f"_{side}1"))
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"_{side}0") / bin_days), F.floor(F.col(f"_{side}1") / bin_days))))

    j = binned(a, a_ends, "a").join(binned(b, b_ends, "b"), [*keys, "_bin"])
    start = F.greatest("_a0", "_b0")
    j = j.filter((start <= F.least("_a1", "_b1")) & (F.col("_bin") == F.floor(start / bin_days)))
    return j.drop("_bin", "_a0", "_a1", "_b0", "_b1")


def timeline(periods: DataFrame, keys: list[str], value: str, bin_days: int = BIN) -> DataFrame:
    """``keys``, ``start_date``, ``end_date``, ``value``: disjoint stretches of days, in each the value of the interval that starts last.

    ``periods``: keys, start_date, end_date, value; of intervals that start on one day the one that
    ends last holds, then the larger value. Days without an interval have no stretch; stretches
    that follow one another with one value are one.
    """
    p = periods.select(*keys, day_number("start_date").alias("s"), day_number("end_date").alias("e"), F.col(value).alias("value")).filter("s <= e")
    cuts = p.select(*keys, F.explode(F.array("s", F.col("e") + 1)).alias("at")).distinct()
    w = Window.partitionBy(*keys).orderBy("at")
    parts = cuts.withColumn("until", F.lead("at").over(w) - 1).filter("until is not null")
    text = lambda c: F.date_format(F.date_from_unix_date(c), "yyyyMMdd")
    left = parts.select(*keys, text("at").alias("part_start"), text("until").alias("part_end"))
    right = p.select(*keys, text("s").alias("s"), text("e").alias("e"), "value")
    held = overlaps(left, right, keys, ("part_start", "part_end"), ("s", "e"), bin_days)
    best = held.groupBy(*keys, "part_start", "part_end").agg(F.max(F.struct("s", "e", "value")).alias("m")).select(*keys, "part_start", "part_end", "m.value")
    o = Window.partitionBy(*keys).orderBy("part_start")
    follows = (day_number("part_start") == day_number(F.lag("part_end").over(o)) + 1) & F.col("value").eqNullSafe(F.lag("value").over(o))
    runs = best.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("new").over(o))
    return runs.groupBy(*keys, "run").agg(F.min("part_start").alias("start_date"), F.max("part_end").alias("end_date"), F.first("value").alias(value)).drop("run")
