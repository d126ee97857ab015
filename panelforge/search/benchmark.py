"""Generators compared under one budget, and a search that stops at so many completed formulas and goes on when asked again."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.formula import Formula, parse
from panelforge.lineage import checkpointed
from panelforge.operators import crosssec, research
from panelforge.schema import finite
from panelforge.search.learned import Budget, Search, search
from panelforge.search.progress import COMPLETED, RUNNING, Progress
from panelforge.sources import bars as src
from panelforge.sources.factor_store import FactorStore

#: How fast the generators learn: one does, the other is its baseline.
RATES = {"policy": 0.5, "uniform": 0.0}
FINDS = "generator string, seed int, discovery_order int, formula_hash string, formula_text string, train_reward double"


def screen_rewards(spark: SparkSession, data: str, folder: str, horizon: int = 5) -> Callable[[list[Formula]], list]:
    """Rewards by the size of the mean rank IC: one plan a batch, formulas that any search has met are looked up."""
    panel = checkpointed(crosssec.forward_return(src.bars(spark, data), horizon))
    store = FactorStore(spark, folder)
    key = store.panel_hash(panel)

    def judge(values: DataFrame) -> DataFrame:
        return crosssec.fast_screen(values.repartition("formula", "trade_date").withColumn("factor_value", F.round(finite(F.col("factor_value")), 10)))

    def evaluate(formulas: list[Formula]) -> list:
        out = store.results(panel, {f.text(): f for f in formulas}, {"reward": "rank_ic", "horizon": horizon}, judge, key, ("forward_return",))
        got = {r["formula"]: r["rank_ic_mean"] for r in out.select("formula", "rank_ic_mean").collect()}  # a batch's worth
        return ["rank_ic_unavailable" if got.get(f.text()) is None else abs(got[f.text()]) for f in formulas]

    return evaluate


def compared(spark: SparkSession, evaluate, budget: Budget, seeds: list[int], batch: int = 8, rates: dict[str, float] = RATES) -> tuple[DataFrame, DataFrame]:
    """Every generator under every seed with the same budget: a summary of each search, and who found the better one by seed."""
    rows = []
    for generator, rate in rates.items():
        for seed in seeds:
            done = search(evaluate, budget, Search(seed, rate), batch)
            rows += [(generator, seed, i, parse(t).sha256(), t, done.rewards.get(t)) for i, t in enumerate(done.order)]
    finds = spark.createDataFrame(rows, FINDS)  # a budget's worth
    return research.search_summary(finds, "generator", "seed"), research.searchers_compared(finds, list(rates))


def completed_budget(path: str | Path, evaluate, config: dict, budget: Budget, batch: int = 8) -> dict:
    """Search until ``budget.completed`` formulas have a reward; opened again it goes on, with another configuration it refuses.

    A larger budget may follow a smaller one: the configuration is the seed and the rate.
    """
    kept = Progress(path, ["search"], config)
    before = kept.extra.get("search")
    found = Search(**before["found"]) if before else Search(config["seed"], config["rate"])
    start = len(found.rewards)
    done = search(evaluate, budget, found, batch, lambda s: kept.set("search", RUNNING, found=vars(s)))
    passed = len(done.rewards) >= budget.completed
    kept.set("search", COMPLETED if passed else RUNNING, found=vars(done))
    best = max(done.rewards.items(), key=lambda kv: (kv[1], kv[0]), default=(None, None))
    return {"passed": passed, "completed": len(done.rewards), "resumed_from": start, "failed": len(done.failed), "unique": len(done.order), "attempts": done.attempts, "best": best[0], "best_reward": best[1],
            "stopped_by": "completed" if passed else "unique" if len(done.order) >= budget.unique else "attempts"}
