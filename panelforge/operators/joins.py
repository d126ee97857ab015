"""As-of, interval, semi and anti joins as plan shapes."""

from pyspark.sql import DataFrame, Window, functions as F


def as_of(left: DataFrame, right: DataFrame, left_date: str, right_date: str) -> DataFrame:
    """``left``'s distinct dates with the last date of ``right`` on or before each.

    The union of both date columns is ordered once and the last right-hand date carried forward, so
    no pairs are made. Dates are few whatever the panel's size.
    """
    dates = left.select(F.col(left_date).alias("d")).distinct().withColumn("r", F.lit(None).cast("string"))
    marks = right.select(F.col(right_date).alias("d"), F.col(right_date).alias("r")).distinct()
    w = Window.orderBy("d", F.col("r").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    both = dates.unionByName(marks).withColumn("found", F.last("r", ignorenulls=True).over(w))
    return both.filter("r is null and found is not null").select(F.col("d").alias(left_date), F.col("found").alias(right_date))


def members_on(dates: DataFrame, snapshots: DataFrame, date: str = "trade_date", snapshot: str = "snapshot_date") -> DataFrame:
    """Each date's members under the latest snapshot on or before it."""
    return as_of(dates, snapshots, date, snapshot).join(snapshots, snapshot)


def state_on(panel: DataFrame, periods: DataFrame, value: str, key: str = "ts_code", date: str = "trade_date", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """``panel`` with ``value`` of the period that holds the date (closed); of several the one that starts last, else null."""
    p = periods.select(F.col(key), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"))
    hit = panel.select(key, date).distinct().join(p, key).filter(F.col(date).between(F.col("_s"), F.col("_e")))
    state = hit.groupBy(key, date).agg(F.max_by("_v", F.struct("_s", "_e")).alias(value))
    return panel.join(state, [key, date], "left")


def keep_members(panel: DataFrame, members: DataFrame, on) -> DataFrame:
    return panel.join(members, on, "left_semi")


def without(panel: DataFrame, gone: DataFrame, on) -> DataFrame:
    return panel.join(gone, on, "left_anti")


def active(panel: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Rows of codes that are listed on the row's date (delisting day included)."""
    j = panel.join(lifecycle.select("ts_code", "list_date", "delist_date"), "ts_code")
    return j.filter((F.col("list_date") <= F.col("trade_date")) & (F.coalesce("delist_date", F.lit("")).isin("") | (F.col("delist_date") >= F.col("trade_date")))).drop("list_date", "delist_date")


def as_of_rows(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tolerance: float | None = None, bin_width: float = 86_400.0) -> DataFrame:
    """``left`` with the columns of the last ``right`` row of its keys at or before its time, at most ``tolerance`` earlier; null if there is none.

    Times are timestamps, dates or numbers (seconds); of right rows at one time the largest one
    counts. Rows whose time is null match nothing. The other columns of both sides must differ in
    name. A key's rows are cut into bins of ``bin_width`` seconds: inside a bin the last match is
    carried along, before its first one the last of the earlier bins holds. So the largest task has
    a key's rows of one bin, and one row a bin.
    """
    def seconds(c: str, df: DataFrame):
        kind = dict(df.dtypes)[c]
        return F.col(c).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(c).cast("double")

    carried = [c for c in right.columns if c not in keys]
    a = left.select(*keys, F.struct(*[F.col(c) for c in left.columns]).alias("_l"), seconds(left_time, left).alias("_t"), F.lit(None).cast(right.select(F.struct(*carried)).schema[0].dataType).alias("_r"))
    b = right.select(*keys, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), seconds(right_time, right).alias("_t"), F.struct(*carried).alias("_r")).filter("_t is not null")
    both = a.unionByName(b).withColumn("_bin", F.floor(F.col("_t") / bin_width))
    found = F.struct(F.col("_t").alias("t"), F.col("_r").alias("r"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_t", F.col("_l").isNotNull(), "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_in", F.last(F.when(F.col("_r").isNotNull(), found), ignorenulls=True).over(inside))
    ends = both.groupBy(*keys, "_bin").agg(F.max(F.when(F.col("_r").isNotNull(), found)).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(over)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bin") == F.col("_b")]
    j = both.filter("_l is not null").join(before, same, "left")
    hit = F.when(F.col("_t").isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), F.coalesce("_in", "_before"))
    j = j.withColumn("_hit", hit)
    if tolerance is not None:
        j = j.withColumn("_hit", F.when(F.col("_t") - F.col("_hit.t") <= tolerance, F.col("_hit")))
    return j.select("_l.*", *[F.col(f"_hit.r.{c}").alias(c) for c in carried])
