"""Whether two runs have the same results: table by table, rows in any order, numbers within tolerances."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.operators.multiset import unmatched

#: Tolerances of numbers, and parts of names of those that are money.
NUMBER, MONEY = 1e-9, 1e-8
MONEY_NAMES = ("cash", "price", "cost", "notional", "market_value", "equity")
SECTIONS = "section string, equal boolean, difference_count long, first_difference string"


def tolerance_of(name: str) -> float:
    return MONEY if any(m in name for m in MONEY_NAMES) else NUMBER


def compared(section: str, a: DataFrame | None, b: DataFrame | None) -> DataFrame:
    """One row (:data:`SECTIONS`): a table that is missing counts as one without rows or columns.

    Tables whose columns differ have one difference; else each row without a partner in the other
    table is one.
    """
    spark = (a or b).sparkSession
    names = [sorted(x.columns) if x is not None else [] for x in (a, b)]
    if names[0] != names[1] and a is not None and b is not None:
        return spark.createDataFrame([(section, False, 1, f"{section}:columns:{names[0]} != {names[1]}")], SECTIONS)
    a, b = (x if x is not None else y.limit(0) for x, y in ((a, b), (b, a)))
    loose = {c: tolerance_of(c) for c, t in a.dtypes if t in ("double", "float")}
    exact = [c for c in a.columns if c not in loose]
    alone = unmatched(a, b, exact, loose)
    told = F.to_json(F.struct(F.col("left"), F.col("right"), *[F.col(c) for c in a.columns]), {"ignoreNullFields": "false"})
    out = alone.agg(F.coalesce(F.sum(F.col("left") + F.col("right")), F.lit(0)).alias("difference_count"), F.min(told).alias("first"))
    return out.select(F.lit(section).alias("section"), (F.col("difference_count") == 0).alias("equal"), "difference_count", F.concat(F.lit(f"{section}:"), F.col("first")).alias("first_difference"))


def runs_compared(a: Mapping[str, DataFrame], b: Mapping[str, DataFrame]) -> DataFrame:
    """:func:`compared` for every table that either run has."""
    out = None
    for name in sorted(a.keys() | b.keys()):
        one = compared(name, a.get(name), b.get(name))
        out = one if out is None else out.unionByName(one)
    return out


def equivalent(sections: DataFrame) -> dict:
    """Over all sections: whether they are equal, how many differences there are, and the first."""
    r = sections.agg(F.min("equal").alias("equivalent"), F.sum("difference_count").alias("difference_count"), F.min("first_difference").alias("first_difference")).first()
    return r.asDict()


def folder(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a result folder, as Parquet or as CSV with a header; those that aren't there are left out."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for name in names:
        if fs.exists(fs_path(f"{path}/{name}")):
            parquet = any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(fs_path(f"{path}/{name}")))
            out[name] = spark.read.parquet(f"{path}/{name}") if parquet else spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{name}")
    return out
