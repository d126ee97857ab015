"""Exact quantiles of groups of any size, with bounded memory in every task.

Equal values are counted first, so a value that very many rows have is one row. The distinct values
are dealt out by ranges of (group, value), whatever groups there are, and each one's ranks follow
from the counts in the ranges before its own. Nothing holds a group's values together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelforge.lineage import checkpointed


def exact_quantiles(df: DataFrame, x: str, probabilities: list[float], by: list[str] = ()) -> DataFrame:
    """``by``, ``n`` and ``q``: an array of the quantiles, linear between neighbouring values; nulls don't count.

    Without ``by`` one row, also for an empty table.
    """
    by = list(by)
    counted = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"))
    dealt = checkpointed(counted.repartitionByRange(*by, "x").withColumn("part", F.spark_partition_id()))
    group, inside = Window.partitionBy(*by), Window.partitionBy(*by, "part").orderBy("x")
    sums = dealt.groupBy(*by, "part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "part", before.alias("before"), F.sum("m").over(group).alias("total"))  # a row for each range and group in it
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "part")]
    ranked = dealt.withColumn("upto", F.sum("n").over(inside)).alias("v").join(sums.alias("s"), same).select(*[F.col(f"v.{c}").alias(c) for c in by], "x", (F.col("before") + F.col("upto")).alias("last"), "n", "total")
    ends = []
    for i, p in enumerate(probabilities):
        at = (F.col("total") - 1) * F.lit(float(p))
        for j, k in enumerate((F.floor(at), F.ceil(at))):
            ends.append(F.max(F.when((k < F.col("last")) & (k >= F.col("last") - F.col("n")), F.col("x"))).alias(f"e{i}_{j}"))
    one = ranked.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *ends)
    values = []
    for i, p in enumerate(probabilities):
        at, low, high = (F.col("n") - 1) * F.lit(float(p)), F.col(f"e{i}_0"), F.col(f"e{i}_1")
        values.append(F.when(low == high, low).otherwise(low * (F.ceil(at) - at) + high * (at - F.floor(at))))
    return one.select(*by, "n", F.array(*values).alias("q"))
