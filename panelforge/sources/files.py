"""File sources: JSON lines (strict or lenient, with or without a byte order mark), CSV, plain YAML, a made-up market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One record per line; blank lines and a leading byte order mark are dropped. A malformed
    line fails the read if ``strict``, else it is left out."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")
    full = StructType.fromDDL(schema).add("_bad", "string")
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = text.select("value", row.alias("r"))
    if strict:
        ok = F.when(F.col("r._bad").isNull(), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))))
        return parsed.select(ok.alias("r")).select("r.*").drop("_bad")
    return parsed.filter("r._bad is null").select("r.*").drop("_bad")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Empty fields and NaN are null."""
    df = spark.read.csv(path, schema=schema, header=True, nullValue="")
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def plain_yaml(text: str) -> dict:
    """Nested maps, scalars and inline lists; no block lists."""
    def scalar(s: str):
        s = s.strip()
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if s and s[0] in "'\"" and s[-1] == s[0]:
            return s[1:-1]
        named = {"true": True, "false": False, "null": None, "~": None, "": None}
        if s.lower() in named:
            return named[s.lower()]
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    root: dict = {}
    levels = [(-1, root)]
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth = len(bare) - len(bare.lstrip())
        name, _, value = bare.strip().partition(":")
        while levels[-1][0] >= depth:
            levels.pop()
        if value.strip():
            levels[-1][1][name] = scalar(value)
        else:
            levels[-1][1][name] = child = {}
            levels.append((depth, child))
    return root


def made_market(spark: SparkSession, codes: int = 5, days: int = 90) -> DataFrame:
    """A deterministic market in which the leader rotates every ten days."""
    grid = spark.range(days).withColumnRenamed("id", "day").crossJoin(spark.range(codes).withColumnRenamed("id", "code"))  # fixed, small
    daily = F.when(F.pmod(F.floor(F.col("day") / 10), F.lit(codes)) == F.col("code"), 0.012).otherwise(-0.002)
    w = Window.partitionBy("code").orderBy("day")
    close = 10 * F.exp(F.sum(F.log1p(daily)).over(w))
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("day") + 2 * F.floor(F.col("day") / 5)).cast("int")), "yyyyMMdd")
    out = grid.select(date.alias("trade_date"), F.format_string("%06d.SZ", F.col("code") + 1).alias("ts_code"), close.alias("close"))
    return out.withColumns({"raw_close": F.col("close"), "raw_open": F.col("close"), "volume": F.lit(1000.0), "amount": F.col("close") * 1000})
