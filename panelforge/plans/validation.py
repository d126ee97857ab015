"""Checks around a search: frozen formulas on new dates, rewards before a run, learning on a controlled signal, what the context costs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelforge.functions import features as feat
from panelforge.functions.formula import Formula, columns, parse
from panelforge.lineage import checkpointed
from panelforge.operators import crosssec, joins, research, stats
from panelforge.operators.checks import profiled
from panelforge.operators.equivalence import runs_compared
from panelforge.schema import finite
from panelforge.search import learned
from panelforge.sources import bars as src


def frozen_on(bars: DataFrame, frozen: dict[str, Formula], segments: dict[str, tuple[str, str]], horizon: int = 5) -> DataFrame:
    """Each frozen formula's mean rank IC in every segment (closed ranges of days), how it changed, and whether its sign held.

    One plan for all formulas and segments; the first segment is the one that they were chosen on.
    ``place`` orders the formulas by the size of the first segment's IC, ``place_after`` by the last
    one's; ``rank_agreement`` is their rank correlation, the same in every row.
    """
    df = feat.compute(crosssec.forward_return(bars, horizon), sorted({n for f in frozen.values() for n in f.features()}))
    df = columns(df, frozen)
    df = df.withColumns({k: F.round(finite(F.col(k)), 8) for k in frozen} | {"forward_return": F.round("forward_return", 8)})
    which = F.lit(None).cast("string")
    for name, (start, end) in segments.items():
        which = F.when(F.col("trade_date").between(start, end), name).otherwise(which)
    days = crosssec.by_date(crosssec.long_form(df, list(frozen))).withColumn("segment", which).filter("segment is not null")
    wide = days.groupBy("formula").pivot("segment", list(segments)).agg(F.round(F.avg("ic"), 6))
    first, *_, last = segments
    size = lambda c: F.abs(F.coalesce(F.col(c), F.lit(0.0)))
    by = lambda c: F.row_number().over(Window.orderBy(F.desc(size(c)), "formula"))  # noqa: E731  a row a formula
    wide = wide.withColumns({"place": by(first), "place_after": by(last), "decay": F.round(size(first) - size(last), 6), "sign_held": F.coalesce(F.signum(first) == F.signum(last), F.lit(False))})
    n = F.count("*").over(Window.partitionBy())
    apart = F.sum((F.col("place") - F.col("place_after")) ** 2).over(Window.partitionBy())
    return wide.withColumn("rank_agreement", F.when(n > 1, F.round(1 - 6 * apart / (n * (n * n - 1)), 6)))


def reward_preflight(metrics: DataFrame) -> tuple[DataFrame, dict]:
    """Whether formulas can be rewarded at all: each one's diagnosis, and how many have a Sortino ratio.

    ``metrics``: formula, sortino, trade_count, status, daily_count, negative_count.
    """
    rows = research.sortino_diagnosis(metrics)
    n = rows.agg(F.count("*").alias("formulas"), F.count_if(F.col("sortino_status") == "available").alias("available")).first()
    blockers = [] if n["available"] else ["preflight_sortino_unavailable"]
    return rows, {"formulas": n["formulas"], "available": n["available"], "ratio": n["available"] / n["formulas"] if n["formulas"] else None, "blockers": blockers}


def account_diagnosis(accounts: DataFrame, trades: DataFrame) -> DataFrame:
    """Metrics of account paths with the counts that the diagnosis looks at."""
    counts = accounts.groupBy("formula").agg(F.count("net_return").alias("daily_count"), F.count_if(F.col("net_return") < 0).alias("negative_count"))
    return stats.account_metrics(accounts, trades).join(counts, "formula")


def rewards_described(rewards: DataFrame, reward: str = "train_reward") -> DataFrame:
    """Counts, moments and deciles of the finite rewards; one row."""
    from panelforge.operators.quantiles import exact_quantiles

    x = finite(F.col(reward))
    one = rewards.agg(F.count("*").alias("count"), F.count(x).alias("finite_count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                      F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative"), F.count_if(x == 0).alias("zero"))
    q = exact_quantiles(rewards.select(x.alias("x")), "x", [0.1, 0.5, 0.9]).select(F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))
    return one.join(F.broadcast(q), how="cross")  # one row and one row


def controlled_signal(seeds: list[int], target: str = "RET1", distractor: str = "RET5", steps: int = 25, rate: float = 0.5) -> list[dict]:
    """Whether the generator learns a known signal: the chance of the rewarded formula before and after some batches.

    Each batch holds the target, the distractor and what the seed draws, all but the target unrewarded.
    """
    pair = np.stack([learned.as_indices(parse(t)) for t in (target, distractor)])
    chance = lambda w: float(np.exp(np.take_along_axis(learned.log_chances(w, pair[:1])[0], np.maximum(pair[:1], 0)[:, :, None], axis=2)[0, 0, 0]))
    out = []
    for seed in seeds:
        weights = learned.no_weights()
        before = chance(weights)
        for i in range(steps):
            batch = np.concatenate([pair, learned.drawn(weights, 6, seed, i)])
            weights = learned.improved(weights, batch, np.array([1.0] + [0.0] * 7), rate)
        out.append({"seed": seed, "before": before, "after": chance(weights)})
    return out


def context_profile(spark: SparkSession, data: str) -> list[dict]:
    """Rows and seconds of each part of what a run starts from."""
    b, first = profiled(src.bars(spark, data), checkpointed)
    parts = {
        "calendar": src.calendar(b), "members": joins.members_on(b.select("trade_date"), src.snapshots(b)), "lifecycle": src.lifecycle(b), "limits": src.limits(b), "unavailable": src.unavailable(b),
        "features": feat.compute(b, feat.NAMES)}
    return [{"part": "bars"} | first] + [{"part": n} | profiled(df, lambda x: x.write.format("noop").mode("overwrite").save())[1] for n, df in parts.items()]


def batch_probe(fold, formulas: dict[str, str]) -> DataFrame:
    """The fold of all formulas in one plan against each one's alone; ``fold`` takes formulas by name. Table by table."""
    kinds = {"accounts": "kind = 'account'", "trades": "kind = 'trade'", "failed": "kind = 'failed'"}
    cut = lambda out: {n: out.filter(c).drop("kind") for n, c in kinds.items()}
    together, alone = fold(formulas), None
    for name, text in formulas.items():
        one = fold({name: text})
        alone = one if alone is None else alone.unionByName(one)
    return runs_compared(cut(checkpointed(together)), cut(checkpointed(alone)))
