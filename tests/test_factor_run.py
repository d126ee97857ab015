"""A research run in stages: resumed, shared with other runs, recorded once."""

import pytest

from panelforge import cli
from panelforge.operators import equivalence
from panelforge.plans.factor_run import Config, FactorRun, record

DATA = "/root/testdata/sf0.001"
SMALL = Config(attempts=10, screen_budget=6, correlation_budget=6, test_budget=2, least_ic=0.0, close=0.8, least_coverage=0.05)


def test_a_run_is_resumed_behind_its_last_stage(spark, tmp_path):
    part = FactorRun(spark, f"{tmp_path}/a", DATA, SMALL).run("screen")
    assert part["computed"] == ["generate", "screen"] and part["new_events"] == 0
    again = FactorRun(spark, f"{tmp_path}/a", DATA)
    assert again.config == SMALL and [s["state"] for s in again.status()] == ["completed"] * 2 + ["pending"] * 4
    rest = again.run()
    screened = again.table("screen").count()
    assert rest["resumed"] == ["generate", "screen"] and rest["computed"] == ["choose", "correlate", "test", "grade"] and rest["new_events"] == screened == 6
    more = FactorRun(spark, f"{tmp_path}/a", DATA, SMALL).run()
    assert more["computed"] == [] and more["new_events"] == 0 and again.registry.read().count() == screened
    with pytest.raises(ValueError, match="another configuration"):
        FactorRun(spark, f"{tmp_path}/a", DATA, Config())
    told = {r["formula_hash"]: r for r in record(again).collect()}
    assert {r["pipeline_status"] for r in told.values()} <= {"rejected", "selected_for_full_backtest", "deduplicated_by_correlation", "excluded_by_correlation_budget", "excluded_by_full_backtest_budget"}
    tested = {r["formula_hash"] for r in again.table("test").collect()}
    assert tested == {h for h, r in told.items() if r["pipeline_status"] == "selected_for_full_backtest"} and 0 < len(tested) <= 2
    # another run shares what the first one has screened
    other = FactorRun(spark, f"{tmp_path}/b", DATA, Config(**{**vars(SMALL), "attempts": 20, "screen_budget": 8}), shared=f"{tmp_path}/a/shared")
    other.run("screen")
    assert other.table("screen").filter("from_store").count() == 6 and other.table("screen").count() == 8
    plain = {r["formula_hash"]: r["rank_ic_mean"] for r in again.table("screen").collect()}
    assert {r["formula_hash"]: r["rank_ic_mean"] for r in other.table("screen").filter("from_store").collect()} == plain


def test_the_command_runs_resumes_and_tells(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("attempts: 6\nscreen_budget: 3\ncorrelation_budget: 2\ntest_budget: 1\nleast_ic: 0.0\nleast_coverage: 0.05\n")
    common = ["--data", DATA, "--out", f"{tmp_path}/run", "--config", f"{tmp_path}/c.yaml"]
    assert cli.main(["factor-research-v2", "generate", *common]) == 0 and cli.main(["factor-research-v2", "status", *common]) == 0
    assert '"stage": "generate", "state": "completed"' in capsys.readouterr().out
    assert cli.main(["factor-research-v2", "run", *common]) == 0 and '"new_events": 3' in capsys.readouterr().out
    assert cli.main(["factor-research-v2", "resume", *common]) == 0 and '"computed": []' in capsys.readouterr().out
    assert cli.main(["factor-research-v2", "report", *common]) == 0 and "| formula_text |" in (tmp_path / "run" / "report.md").read_text().replace("formula_hash | ", "")


def test_an_interrupted_run_is_the_same_as_a_whole_one(spark, tmp_path):
    """Table by table, after a stage that was written but not recorded."""
    first = FactorRun(spark, f"{tmp_path}/a", DATA, SMALL)
    first.run("generate")
    first.stage(first.table("generate"))  # lost before its commit
    FactorRun(spark, f"{tmp_path}/a", DATA).run("screen")
    whole = FactorRun(spark, f"{tmp_path}/whole", DATA, SMALL)
    whole.run("screen")
    sections = equivalence.runs_compared(*[{n: run.table(n) for n in ("generate", "screen")} for run in (first, whole)])
    assert equivalence.equivalent(sections) == {"equivalent": True, "difference_count": 0, "first_difference": None}
