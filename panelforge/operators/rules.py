"""Ordered decisions as CASE expressions: tradability, validity, rewards, grades, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def trade_block(side: Column, price: Column, up: Column, down: Column, status: Column, unavailable: Column, policy: str = "reject_trade", tick: float = 0.01) -> Column:
    """Why an order can't trade, or null; the first rule that fits holds. An unknown policy fails only where it is needed."""
    unknown = status if policy == "reject_trade" else F.raise_error(F.lit(f"unknown policy: {policy}")).cast("string")
    out = F.when(unavailable, F.lit("missing_bar_on_open_day")).when(price.isNull() | (price <= 0), "missing_or_invalid_raw_open")
    if policy != "exclude_date":
        out = out.when(status.isin("special_case_unknown", "missing_input"), unknown)
    known = status == "verified_rule"
    return out.when(known & (side == "buy") & (price >= up - tick / 2), "limit_up_open").when(known & (side == "sell") & (price <= down + tick / 2), "limit_down_open")


def validity(df: DataFrame, column: str, infinite: Column, least: int = 20) -> DataFrame:
    """Counts of a formula's values and why it is not valid, or null."""
    c = F.col(column)
    out = df.agg(F.count("*").alias("total_rows"), F.count(c).alias("valid_rows"), F.count_if(infinite).alias("inf_rows"), F.count_distinct(c).alias("unique_values"), F.stddev_pop(c).alias("std"))
    why = F.when(F.col("inf_rows") > 0, "inf_values").when(F.col("valid_rows") < least, "insufficient_valid_rows").when((F.col("unique_values") <= 1) | F.col("std").isNull() | (F.col("std") < 1e-12), "constant_or_all_missing")
    return out.withColumn("failure_reason", why)


def rebalance_dates(calendar: DataFrame, every: int) -> DataFrame:
    """Every k-th trading day from the first, and the day after it."""
    w = Window.orderBy("trade_date")  # a calendar has a few thousand rows
    return calendar.select("trade_date", (F.row_number().over(w) - 1).alias("i"), F.lead("trade_date").over(w).alias("next_date")).filter(F.col("i") % every == 0).select("trade_date", "next_date")


def weekly_schedule(calendar: DataFrame) -> DataFrame:
    """Signal on the last day of a run of equal (year, ISO week), entry on the next run's first day, exit on the first day after that run.

    Runs are of adjacent days, so a week that spans New Year makes two.
    """
    w = Window.orderBy("trade_date")
    day = F.to_date("trade_date", "yyyyMMdd")
    key = F.year(day) * 100 + F.weekofyear(day)
    days = calendar.select("trade_date", key.alias("k")).withColumn("new", F.coalesce((F.col("k") != F.lag("k").over(w)).cast("int"), F.lit(1)))
    runs = days.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("run").agg(F.max("trade_date").alias("signal_date"), F.min("trade_date").alias("first"))
    r = Window.orderBy("run")
    return runs.select("signal_date", F.lead("first", 1).over(r).alias("entry_date"), F.lead("first", 2).over(r).alias("exit_date")).filter("exit_date is not null")


def due(planned: Column, done: Column, today: Column, available: Column) -> Column:
    """Whether the event planned for a day is to happen today, given the last day with data; the first rule that fits."""
    return (
        F.when(planned.isNull(), "no_eligible_signal_date").when(done, "signal_already_generated").when(today < planned, "not_due_yet")
        .when(available.isNull() | (available < planned), "daily_bar_not_ready").when(today > planned, "missed_signal_cycle").otherwise("signal_due"))
