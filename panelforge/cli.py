"""The command line: python -m panelforge.cli COMMAND --data DIR [--out DIR] ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession, functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("panelforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(rows) -> None:
    for r in rows:
        print(json.dumps(r.asDict() if hasattr(r, "asDict") else r, default=str, sort_keys=True))


def _query(name: str):
    def run(args) -> int:
        from panelforge.plans.registry import QUERIES

        out = QUERIES[name](_session(), args.data)
        if args.out:
            from panelforge.sources.sinks import write

            print(write(out, f"{args.out}/{name}"))
        else:
            _show(out.limit(args.rows).collect())
        return 0

    return run


def backtest(args) -> int:
    from panelforge.lineage import checkpointed
    from panelforge.operators import stats
    from panelforge.plans.queries import backtest_accounts
    from panelforge.sources.sinks import backtest_outputs

    out = checkpointed(backtest_accounts(_session(), args.data, {"formula": args.formula}, args.bps))  # read by every output
    metrics = stats.account_metrics(out.filter("kind = 'account'"), out.filter("kind = 'trade'"))
    if args.out:
        backtest_outputs(out, metrics, args.out)
    else:
        _show(metrics.collect())  # one row
    return 0


def _rewards(spark, data: str, bps: float):
    """Rewards of formulas: one plan a batch."""
    from panelforge.lineage import checkpointed
    from panelforge.operators import research, stats
    from panelforge.plans.queries import backtest_accounts

    def evaluate(formulas):
        out = checkpointed(backtest_accounts(spark, data, {f.text(): f.text() for f in formulas}, bps))
        m = stats.account_metrics(out.filter("kind = 'account'"), out.filter("kind = 'trade'"))
        got = {r["formula"]: r for r in research.reward_verdict(m, 1).collect()}  # one row a formula
        return [got[f.text()]["reward"] if f.text() in got else "no_targets" for f in formulas]

    return evaluate


def mine(args) -> int:
    """Search; with a checkpoint under ``--out`` that the same settings resume."""
    from panelforge.search.benchmark import RATES
    from panelforge.search.learned import Budget, Search, search
    from panelforge.search.progress import COMPLETED, RUNNING, Progress

    config = {"seed": args.seed, "generator": args.generator, "attempts": args.attempts, "bps": args.bps}
    kept = Progress(f"{args.out}/progress.json", ["search"], config)
    before = kept.extra.get("search")
    found = Search(**before["found"]) if before else Search(args.seed, RATES[args.generator])
    done = search(_rewards(_session(), args.data, args.bps), Budget(args.attempts, args.attempts, args.attempts), found, args.batch, lambda f: kept.set("search", RUNNING, found=vars(f)))
    kept.set("search", COMPLETED, found=vars(done))
    _show([{"formula": k, "reward": v} for k, v in sorted(done.rewards.items(), key=lambda kv: -kv[1])[: args.rows]])
    return 0


def status(args) -> int:
    kept = json.loads(Path(f"{args.out}/progress.json").read_text())
    _show([{"task": t, "state": s} for t, s in kept["states"].items()])
    return 0


def report(args) -> int:
    from panelforge.sources.sinks import atomic_text, markdown

    kept = json.loads(Path(f"{args.out}/progress.json").read_text())["extra"].get("search", {}).get("found", {"rewards": {}, "attempts": 0})
    rows = [{"formula": k, "reward": v} for k, v in sorted(kept["rewards"].items(), key=lambda kv: -kv[1])]
    atomic_text(f"{args.out}/report.md", markdown("Search", rows, [f"{kept['attempts']} attempts, {len(rows)} rewarded."]))
    return 0


def gate(args) -> int:
    """Whether the settings may run; with ``--out`` then a search until so many formulas have a reward."""
    from panelforge.operators.gates import research_run
    from panelforge.sources.files import plain_yaml

    bad = research_run(plain_yaml(Path(args.config).read_text())) if args.config else []
    _show([{"reason": b} for b in bad])
    if bad or not args.out:
        return 1 if bad else 0
    from panelforge.search import benchmark
    from panelforge.search.learned import Budget

    evaluate = benchmark.screen_rewards(_session(), args.data, f"{args.out}/factors")
    found = benchmark.completed_budget(f"{args.out}/progress.json", evaluate, {"seed": args.seed, "rate": benchmark.RATES[args.generator]}, Budget(args.completed, 10 * args.completed, args.attempts), args.batch)
    _show([found])
    return 0 if found["passed"] else 1


def search_benchmark(args) -> int:
    """Both generators under ``--seeds`` seeds with one budget of attempts."""
    from panelforge.search import benchmark
    from panelforge.search.learned import Budget
    from panelforge.sources.sinks import atomic_text, markdown

    spark = _session()
    folder = args.out or _scratch(spark)
    summary, winners = benchmark.compared(spark, benchmark.screen_rewards(spark, args.data, f"{folder}/factors"), Budget(args.attempts, args.attempts, args.attempts), list(range(args.seeds)), args.batch)
    rows = [[r.asDict() for r in x.collect()] for x in (summary, winners)]  # a row a search
    if args.out:
        atomic_text(f"{args.out}/report.md", markdown("Searches", rows[0]) + markdown("By seed", rows[1]))
    _show(rows[0] + rows[1])
    return 0


def _scratch(spark) -> str:
    import uuid

    from panelforge.lineage import shared_folder

    return f"{shared_folder(spark)}/cli-{uuid.uuid4().hex}"


def factor_research(args) -> int:
    """The staged run in ``--out``: one stage and those before it, all that is left, its state or its report."""
    from panelforge.plans.factor_run import Config, FactorRun, record
    from panelforge.sources.files import plain_yaml
    from panelforge.sources.sinks import atomic_text, markdown

    config = Config(**plain_yaml(Path(args.config).read_text())) if args.config else None
    run = FactorRun(_session(), args.out or _scratch(_session()), args.data, config)
    if args.action == "resume" and not run.newest():
        _show([{"reason": "nothing_to_resume"}])
        return 1
    if args.action == "status":
        _show(run.status())
    elif args.action == "report":
        rows = [r.asDict() for r in record(run).orderBy("grade", "formula_hash").collect()]  # a budget's worth
        atomic_text(f"{args.out}/report.md", markdown("Factor research", rows, [f"{len(rows)} formulas."]))
    elif args.action == "prepare":
        _show([vars(run.config) | {"run_id": run.run_id}])
    else:
        _show([run.run({"backtest": "test", "robustness": "grade"}.get(args.action, args.action) if args.action not in ("run", "resume") else None)])
    return 0


def forward(args) -> int:
    """Take what is new in the folder of events (protocol, event_id, kind, trade_date, ts) into the log under ``--out``."""
    from panelforge.sources.versions import Table
    from panelforge.streaming import forward_run

    spark = _session()
    log = Table(spark, f"{args.out}/log", ["event_id"], forward_run.LOG)
    before = log.newest()
    events = spark.readStream.schema("protocol string, event_id string, kind string, trade_date string, ts timestamp").parquet(args.data)
    forward_run.run(events, log, f"{args.out}/mark", args.late).awaitTermination()
    known = log.read(before).select("event_id")
    _show(log.read().join(known, "event_id", "left_anti").orderBy("protocol", "trade_date", "event_id").limit(args.rows).collect())
    return 0


def verify(args) -> int:
    from panelforge.sources.sinks import broken

    bad = broken(args.out)
    _show([{"reason": b} for b in bad])
    return 1 if bad else 0


def diagnose(args) -> int:
    """How complete the daily bars are."""
    from panelforge.sources.bars import bars
    from panelforge.sources.sinks import content_hash

    b = bars(_session(), args.data)
    one = b.agg(F.count("*").alias("rows"), F.count_distinct("ts_code").alias("codes"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count_if(F.col("raw_close").isNull() | (F.col("raw_close") <= 0)).alias("bad_prices")).first()
    _show([one.asDict() | {"content": content_hash(b.select("trade_date", "ts_code", "raw_close"))}])
    return 0


COMMANDS = {
    "smoke-test": _query("topn_by_date"), "backtest": backtest, "mine": mine, "resume": mine, "resume-training": mine, "status": status, "report": report, "search-benchmark": search_benchmark, "completed-budget-gate": gate,
    "diagnose-daily-bars": diagnose, "frozen-candidate-validation": verify, "forward-paper": forward, "factor-research-v2": factor_research, "watchlist": _query("observation_watchlist"), "regime": _query("regime_metrics"),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="panelforge")
    p.add_argument("command", choices=list(COMMANDS))
    p.add_argument("action", nargs="?", default="run", choices=["prepare", "generate", "screen", "choose", "correlate", "test", "backtest", "grade", "robustness", "report", "run", "resume", "status"])
    p.add_argument("--data", default=".")
    p.add_argument("--out")
    p.add_argument("--config")
    p.add_argument("--formula", default="NEG(RET_STD20)")
    p.add_argument("--generator", choices=["policy", "uniform"], default="policy")
    p.add_argument("--late", default="2 days")
    for name, kind, value in (("rows", int, 20), ("seed", int, 0), ("attempts", int, 16), ("batch", int, 8), ("bps", float, 20.0), ("seeds", int, 2), ("completed", int, 8)):
        p.add_argument(f"--{name}", type=kind, default=value)
    args = p.parse_args(argv)
    return COMMANDS[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
