"""A daily bar panel and its companion tables, from the star-schema tables.

``supplier`` stands for the instrument and ship dates for trading days. Prices are a bounded walk:
each bar's return, within 2 % a day, follows from the cents traded that day, and returns add up as
whole basis points of the logarithm. Opens lie within the 10 % band, now and then at its edges. All
prices are whole hundredths of a cent, so the panel doesn't depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelforge.schema import KEY

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """A table that is read from Parquet files with each row's ``place``: files in order of their paths, rows as they are stored."""
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = df.select(file.alias("_file")).distinct().withColumn("_n", F.row_number().over(Window.orderBy("_file")) - 1)  # one row a file
    out = df.select("*", file.alias("_file"), row.alias("_row")).join(F.broadcast(files), "_file")
    return out.withColumn("place", F.shiftleft(F.col("_n").cast("long"), 40) + F.col("_row")).drop("_file", "_row", "_n")


def bars(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per (trade_date, ts_code): one shuffle of the lines by code, which the sums of a day, the walk and windows by ``ts_code`` keep.

    ``start`` and ``end`` (yyyyMMdd, closed) limit the lines that are read, and so where the walk starts.
    """
    line = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    for bound, op in ((start, ">="), (end, "<")):
        if bound:
            day = F.to_date(F.lit(bound), "yyyyMMdd").cast("timestamp_ntz")
            line = line.filter(F.col("l_shipdate") >= day if op == ">=" else F.col("l_shipdate") < day + F.expr("interval 1 day"))
    code = F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("ts_code")  # of longer numbers the beginning, so the number stays a key
    line = line.select(code, "l_suppkey", F.date_trunc("day", "l_shipdate").alias("day"), "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    out = line.repartition("ts_code").groupBy("day", "ts_code", "l_suppkey").agg(F.sum("l_quantity").alias("volume"), F.sum("cents").alias("cents"))
    w = Window.partitionBy("ts_code", "l_suppkey").orderBy("day")
    log = F.sum(F.col("cents") % 401 - 200).over(w)
    out = out.withColumn("c", F.floor(100000 * F.exp(log / 10000.0))).withColumn("pre", F.lag("c").over(w))
    step = F.when(F.col("cents") % 97 == 0, 1000).when(F.col("cents") % 97 == 1, -1000).otherwise(F.floor(F.col("cents") / 97) % 301 - 150)
    out = out.withColumn("o", F.coalesce(F.floor((F.col("pre") * (10000 + step) + 5000) / 10000), F.col("c")))
    price = {"open": F.col("o"), "high": F.greatest("o", "c"), "low": F.least("o", "c"), "close": F.col("c")}
    cols = [(v / 10000.0).alias(prefix + k) for prefix in ("", "raw_") for k, v in price.items()]
    return out.select(
        F.date_format("day", "yyyyMMdd").alias("trade_date"), "ts_code", *cols,
        "volume", (F.col("c") * F.col("volume") / 10000.0).alias("amount"), (F.col("pre") / 10000.0).alias("pre_close"))


def scan_bars(bars: DataFrame, start: str, end: str, symbols: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Closed range of dates, optionally some instruments and columns.

    On a panel stored as files both reach the scan; :func:`bars` takes dates itself.
    """
    out = bars.filter(F.col("trade_date").between(start, end))
    out = out.filter(F.col("ts_code").isin(symbols)) if symbols else out
    return out.select(*KEY, *[c for c in columns if c not in KEY]) if columns else out


def calendar(bars: DataFrame) -> DataFrame:
    return bars.select("trade_date").distinct()


def basic(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    """The daily basics: each code's turnover rate of a day, in per cent; days whose orders were all small have none.

    Dates limit the lines that are read.
    """
    day = lambda d: F.to_date(F.lit(d), "yyyyMMdd").cast("timestamp_ntz")
    line = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") > 0) & (F.col("l_shipdate") >= day(start)) & (F.col("l_shipdate") < day(end) + F.expr("interval 1 day")))
    out = line.groupBy(F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("ts_code")).agg(F.sum("l_quantity").alias("q"), F.max("l_quantity").alias("most"))
    return out.filter("most >= 10").select(*KEY, (F.col("q") / 1000).alias("turnover_rate"))


def snapshots(bars: DataFrame) -> DataFrame:
    """Members at the first trading day of each month: the codes with a bar on it."""
    first = bars.groupBy(F.substring("trade_date", 1, 6).alias("month")).agg(F.min("trade_date").alias("snapshot_date"))
    return bars.join(F.broadcast(first.select("snapshot_date")), F.col("trade_date") == F.col("snapshot_date")).select("snapshot_date", "ts_code")  # months: a bounded few hundred


def lifecycle(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ts_code").agg(F.min("trade_date").alias("list_date"), F.max("trade_date").alias("last_date")).select(
        "ts_code", "list_date", F.when(F.pmod(F.col("ts_code").cast("int"), F.lit(7)) == 0, F.col("last_date")).alias("delist_date"))


#: What features, account folds and limits need of a bar.
FOLDED = (*KEY, "close", "volume", "amount", "raw_open", "raw_close", "pre_close")


def with_limits(bars: DataFrame) -> DataFrame:
    """``bars`` with their limits: ten per cent around the close before, in whole hundredths of a cent."""
    status = F.when(F.col("pre_close").isNull(), "missing_input").when(F.pmod(F.col("ts_code").cast("int"), F.lit(11)) == 0, "special_case_unknown").otherwise("verified_rule")
    pre = F.round(F.col("pre_close") * 10000).cast("long")
    return bars.select("*", (F.floor((pre * 110 + 50) / 100) / 10000.0).alias("limit_up"), (F.floor((pre * 90 + 50) / 100) / 10000.0).alias("limit_down"), status.alias("limit_status"))


def limits(bars: DataFrame) -> DataFrame:
    """The limits alone, by date and code."""
    return with_limits(bars).select(*KEY, "limit_up", "limit_down", "limit_status")


def unavailable(bars: DataFrame) -> DataFrame:
    """Tradability rows: codes without a bar on an open day on which they are listed, between their first and last bar, of every fifth code."""
    life = bars.filter(F.pmod(F.col("ts_code").cast("int"), F.lit(5)) == 0).groupBy("ts_code").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    open_days = calendar(bars).join(F.broadcast(life), F.col("trade_date").between(F.col("a"), F.col("b")))  # one row an instrument
    return open_days.select(*KEY).join(bars.select(*KEY), KEY, "left_anti").withColumn("tradability_proxy", F.lit("unavailable"))


def st_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals of special treatment: suppliers with a negative balance."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").withColumn("y", F.pmod("s_suppkey", F.lit(5)))
    code, year = F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("ts_code"), lambda y, day: F.concat((y + F.col("y")).cast("string"), F.lit(day))
    first = s.select(code, year(1992, "0101").alias("start_date"), year(1994, "1231").alias("end_date"), F.lit(1).alias("historical_is_st"))
    # a later period inside the first ends the treatment for a while: of several the one that starts last holds
    return first.unionByName(s.filter("s_suppkey % 2 = 0").select(code, year(1993, "0401").alias("start_date"), year(1993, "0930").alias("end_date"), F.lit(0).alias("historical_is_st")))
