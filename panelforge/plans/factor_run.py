"""A research run in stages that can be resumed: generate, screen, choose, correlate, test, grade, record.

Every stage is a table of the run's folder, named in its manifest when it is whole. A run that is
started again in its folder goes on behind its last whole stage; what the screen says about a
formula is kept apart, by the formula and the panel's content, so other runs find it too. The
registry gets one event a formula and run, however often the run is resumed.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions import formula_space
from panelforge.functions.formula import Formula, parse
from panelforge.lineage import checkpointed
from panelforge.operators import backtest, correlation, crosssec, graphs, joins, research, rules, stats
from panelforge.schema import KEY, finite
from panelforge.sources import bars as src, versions
from panelforge.sources.factor_store import FactorStore
from panelforge.sources.sinks import stable_hash

#: Which evaluation events belong to.
VERSION = "panel_v1"
EVENTS = "event_id string, run_id string, formula_hash string, formula_text string, grade string, payload string"
#: Formulas that one plan screens.
BATCH = 48


@dataclass(frozen=True)
class Config:
    """What a run depends on."""

    attempts: int = 60
    seed: int = 1
    most_tokens: int = 3
    screen_budget: int = 40
    correlation_budget: int = 20
    test_budget: int = 5
    least_coverage: float = 0.3
    least_dispersion: float = 1e-12
    least_ic: float = 0.005
    close: float = 0.95
    horizon: int = 5
    top_n: int = 20
    rebalance: int = 5
    bps: float = 20.0


class FactorRun(versions.Versions):
    """One run over the tables in ``data``; ``shared`` holds the factor store and the registry of all runs."""

    STAGES = ("generate", "screen", "choose", "correlate", "test", "grade")

    def __init__(self, spark: SparkSession, folder: str, data: str, config: Config | None = None, shared: str | None = None):
        super().__init__(spark, folder)
        shared = shared or f"{self.folder}/shared"
        self.data, self.store = data, FactorStore(spark, f"{shared}/factors")
        self.registry = versions.Table(spark, f"{shared}/registry", ["event_id"], EVENTS)
        kept = self.manifest().get("config")
        if kept is not None and config is not None and kept != asdict(config):
            raise ValueError(f"{folder} belongs to another configuration")
        self.config = Config(**kept) if kept is not None else config or Config()
        self.run_id = stable_hash({"config": asdict(self.config), "data": data})[:16]
        self._bars: DataFrame | None = None

    def bars(self) -> DataFrame:
        """The panel with its forward return: made once, whatever reads it."""
        if self._bars is None:
            self._bars = checkpointed(crosssec.forward_return(src.bars(self.spark, self.data), self.config.horizon))
        return self._bars

    def table(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.manifest()["stages"][stage]["path"])

    def status(self) -> list[dict]:
        """Each stage with its state, rows and bytes."""
        done = self.manifest().get("stages", {})
        return [{"stage": s, "state": "completed" if s in done else "pending", "rows": done.get(s, {}).get("rows"), "bytes": done.get(s, {}).get("bytes")} for s in self.STAGES]

    def run(self, until: str | None = None) -> dict:
        """Do the stages that aren't whole, up to ``until``, and record the grades; says what was done and what was there."""
        done, events = [], 0
        for name in self.STAGES:
            if name not in self.manifest().get("stages", {}):
                entry = self.stage(getattr(self, name)())

                def make(parent: int, name=name, entry=entry):
                    before = self.manifest(parent)
                    return {"config": asdict(self.config), "stages": before.get("stages", {}) | {name: entry}}, []

                self.change(make)
                done.append(name)
            if name == until:
                break
        else:
            before = self.registry.newest()
            after = self.registry.append_unique(self.events(), "payload")
            events = self.registry.history()[-1]["rows"] if after > before else 0
        return {"run_id": self.run_id, "computed": done, "resumed": [s["stage"] for s in self.status() if s["state"] == "completed" and s["stage"] not in done], "new_events": events}

    # the stages

    def generate(self) -> DataFrame:
        """The formulas that the attempts draw, once each, and every feature's own."""
        c = self.config
        attempts = self.spark.range(c.attempts).select("id", formula_space.drawn_number(F.col("id"), c.seed, c.most_tokens).alias("number"))
        drawn = formula_space.distinct_formulas(attempts, "id", "number", c.most_tokens)
        order = F.row_number().over(_window("first_attempt", "formula_hash"))
        return drawn.orderBy("first_attempt", "formula_hash").limit(c.screen_budget).withColumn("place", order)

    def _formulas(self, rows: DataFrame) -> dict[str, Formula]:
        """By hash; a budget's worth."""
        return {r["formula_hash"]: parse(r["formula_text"]) for r in rows.select("formula_hash", "formula_text").collect()}

    def screen(self) -> DataFrame:
        """The fast screen of all formulas, in plans of a bounded width; formulas known from any run are looked up."""
        c = self.config
        panel = self.store.panel_hash(self.bars())
        settings = {"horizon": c.horizon, "coverage": c.least_coverage, "dispersion": c.least_dispersion, "ic": c.least_ic}
        given = self._formulas(self.table("generate"))
        hashes, out = sorted(given), None

        def evaluate(values: DataFrame) -> DataFrame:
            return crosssec.fast_screen(values.repartition("formula", "trade_date").withColumn("factor_value", F.round(finite(F.col("factor_value")), 10)), c.least_coverage, c.least_dispersion, c.least_ic)

        for i in range(0, len(hashes), BATCH):
            some = self.store.results(self.bars(), {h: given[h] for h in hashes[i : i + BATCH]}, settings, evaluate, panel, ("forward_return",))
            out = some if out is None else out.unionByName(some)
        texts = self.table("generate").select("formula_hash", "formula_text")
        return out.withColumnRenamed("formula", "formula_hash").join(texts, "formula_hash")

    def choose(self) -> DataFrame:
        return research.within_budget(self.table("screen").filter("fast_screen_status = 'passed'"), self.config.correlation_budget)

    def correlate(self) -> DataFrame:
        """Clusters of the chosen formulas; their values are kept."""
        chosen = self._formulas(self.table("choose"))
        names = self.table("choose").select(F.col("formula_hash").alias("name"), "place")
        if not chosen:
            return self.spark.createDataFrame([], "representative string, member string, correlation double")
        long = self.store.values(self.bars(), chosen, self.store.panel_hash(self.bars()))
        wide = long.groupBy(*KEY).pivot("formula", sorted(chosen)).agg(F.first("factor_value"))
        order = [r["name"] for r in names.orderBy("place").collect()]  # a budget's worth
        return graphs.greedy_clusters(names, correlation.rank_correlations(wide, order, least=self.config.close), self.config.close)

    def kept(self) -> DataFrame:
        """The first formulas of their clusters within the budget of tests."""
        alone = self.table("correlate").filter("representative = member").select(F.col("member").alias("formula_hash"))
        return research.within_budget(self.table("choose").join(alone, "formula_hash", "left_semi").drop("place"), self.config.test_budget)

    def test(self) -> DataFrame:
        """Metrics of the account fold, one row a formula."""
        c, b = self.config, self.bars()
        chosen = self._formulas(self.kept())
        dates = rules.rebalance_dates(src.calendar(b), c.rebalance)
        scored = self.store.values(b, chosen, self.store.panel_hash(b))
        targets = backtest.targets(scored, dates, joins.members_on(b.select("trade_date"), src.snapshots(b)), src.lifecycle(b), c.top_n)
        block = lambda side: rules.trade_block(F.lit(side), F.col("raw_open"), F.col("limit_up"), F.col("limit_down"), F.col("limit_status"), F.lit(False))
        market = b.join(src.limits(b), KEY).withColumns({"buy_block": block("buy"), "sell_block": block("sell")})
        out = checkpointed(backtest.run(targets, market, src.calendar(b), dates, bps=c.bps, top_n=c.top_n))
        return stats.account_metrics(out.filter("kind = 'account'"), out.filter("kind = 'trade'")).withColumnRenamed("formula", "formula_hash")

    def grade(self) -> DataFrame:
        """Where each screened formula ended, and its grade."""
        screened, chosen, clusters = self.table("screen"), self.table("choose"), self.table("correlate")
        members = clusters.filter("representative <> member").select(F.col("member").alias("formula_hash"))
        tested = self.kept()
        alone = chosen.join(members, "formula_hash", "left_anti")
        state = research.pipeline_status(screened, chosen, members, tested, alone.join(tested.select("formula_hash"), "formula_hash", "left_anti"))
        metrics = self.table("test").withColumn("full_backtest_status", F.when(F.col("status") == "ok", "passed").otherwise("failed")).drop("status")
        judged = state.join(metrics.select("formula_hash", "full_backtest_status", "total_return", "max_drawdown", "sortino", "trade_count"), "formula_hash", "left")
        return research.grade(research.robustness(judged))

    def events(self) -> DataFrame:
        """One event for each formula of this run."""
        g = self.table("grade")
        payload = F.to_json(F.struct("pipeline_status", "grade", F.round("rank_ic_mean", 9).alias("rank_ic_mean"), F.round("total_return", 9).alias("total_return")), {"ignoreNullFields": "false"})
        return g.select(F.concat_ws(":", F.lit(self.run_id), "formula_hash", F.lit(VERSION)).alias("event_id"), F.lit(self.run_id).alias("run_id"), "formula_hash", "formula_text", "grade", payload.alias("payload"))


def _window(*by: str):
    from pyspark.sql import Window

    return Window.orderBy(*by)  # a budget's worth


def record(run: FactorRun) -> DataFrame:
    """Formula, status and grade, best first; the registry's view of the run."""
    return run.registry.read().filter(F.col("run_id") == run.run_id).select("formula_hash", "formula_text", "grade", F.get_json_object("payload", "$.pipeline_status").alias("pipeline_status"))
