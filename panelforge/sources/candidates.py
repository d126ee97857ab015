"""Search results and judged formulas, from the star schema's ``part`` table.

Every part is a find: a formula that some generator met under some seed. Three neighbouring parts
find the same formula, so formulas have several sources. All measures are whole thousandths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.features import NAMES
from panelforge.sources.bars import table

SHAPES = ("{}", "NEG({})", "ABS({})", "ZSCORE20({})")


def finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """formula_hash, formula_text, generator, seed, discovery_order, train_reward and the cents ``c`` that all measures follow from."""
    number = F.floor(F.col("p_partkey") / 3)
    feature = F.element_at(F.array(*map(F.lit, NAMES)), (number % len(NAMES) + 1).cast("int"))
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (number % len(SHAPES) + 1).cast("int"))
    c = F.round(F.col("p_retailprice") * 100).cast("long") + 7 * F.col("p_partkey") * F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.sha2(F.concat(F.lit("F"), number.cast("string")), 256).alias("formula_hash"), F.replace(shape, F.lit("{}"), feature).alias("formula_text"),
        F.when(F.col("p_size") % 2 == 0, "policy").otherwise("uniform").alias("generator"), (F.col("p_partkey") % 5).cast("int").alias("seed"), F.col("p_partkey").alias("discovery_order"),
        F.when(c % 13 == 0, None).otherwise((F.floor(c / 3) % 4001 - 2000) / 1000.0).alias("train_reward"), c.alias("c"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a formula: what screening, the backtest, the split segments and validation said."""
    m = finds(spark, sf_dir).groupBy("formula_hash").agg(F.min("formula_text").alias("formula_text"), F.sum("c").alias("c"), F.max("train_reward").alias("train_sortino"))
    c = F.col("c")
    part = lambda by, size, low: (F.floor(c / by) % size + low) / 1000.0
    unless = lambda n, value: F.when(c % n != 0, value)
    return m.select(
        "formula_hash", "formula_text", "train_sortino", part(2, 121, -60).alias("rank_ic_mean"), part(5, 1001, 0).alias("coverage"), F.when(part(5, 1001, 0) < 0.3, "rejected").otherwise("passed").alias("fast_screen_status"),
        part(7, 1001, -300).alias("total_return"), part(11, 600, -600).alias("max_drawdown"), unless(13, part(3, 4001, -2000)).alias("sortino"), (c % 40).alias("trade_count"),
        F.when(c % 17 == 0, "insufficient_data").otherwise("ok").alias("status"), F.when(c % 17 == 0, "failed").otherwise("passed").alias("full_backtest_status"), (c % 9 * 30).alias("daily_count"), (c % 5).alias("negative_count"),
        unless(23, part(19, 4001, -2000)).alias("validation_sortino"), F.when(c % 29 == 0, "failed").otherwise("completed").alias("validation_status"), unless(31, part(4, 1001, 0)).alias("selection_trade_win_rate"),
        unless(37, part(6, 3001, 0)).alias("selection_profit_loss_ratio"), unless(41, part(8, 1001, 0)).alias("stability_trade_win_rate"), unless(43, part(9, 3001, 0)).alias("stability_profit_loss_ratio"),
        part(10, 801, -300).alias("stability_total_return"), part(12, 121, -60).alias("stability_rank_ic_mean"))
