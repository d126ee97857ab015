"""Gates, equivalence of runs, frozen formulas, pre-flights and profiles."""

import pytest
from pyspark.sql import functions as F

from panelforge.functions.features import NAMES
from panelforge.functions.formula import OPERATORS
from panelforge.operators import equivalence, second_round
from panelforge.plans import queries, validation
from panelforge.sources import sinks, versions

DATA = "/root/testdata/sf0.001"
DRAFT = {
    "status": "draft_not_approved", **{k: v for fixed in second_round.CONTROLS.values() for k, v in fixed.items()}, "locked_thresholds": second_round.LOCKED,
    "allowed_features": {"original": list(second_round.ORIGINAL), "second_batch_approved": [n for n in NAMES if n not in second_round.ORIGINAL]}, "allowed_operators": list(OPERATORS)}
GOOD = ("s1", "computable_with_current_data", "a title", None, True, False, False, True)


def seeds(spark, *rows):
    return spark.createDataFrame(list(rows), second_round.SEED)


def test_a_sound_draft_passes(spark):
    assert second_round.failures(DRAFT, seeds(spark, GOOD)) == []


@pytest.mark.parametrize(("change", "reason"), [
    ({"status": "approved"}, "status_is_approved"), ({"status": "other"}, "status_not_explicitly_draft"), ({"search_enabled": True}, "execution_control_blocked:search_enabled"), ({"run_enabled": None}, "missing_execution_control:run_enabled"),
    ({"external_data_allowed": True}, "boundary_blocked:external_data_allowed"), ({"threshold_change_allowed": True}, "threshold_change_blocked"), ({"rating_rule_change_allowed": None}, "missing_rating_rule_control"),
    ({"locked_thresholds": {"screening": {"min_coverage": 0.2}}}, "threshold_deviation:screening.min_coverage"), ({"locked_thresholds": {"rating": {"grade_a_min_abs_ic": 0.01}}}, "rating_rule_deviation:rating.grade_a"),
    ({"allowed_features": {"original": ["RET1"]}}, "allowed_features.original_mismatch"), ({"allowed_features": {"more": ["X1"]}}, "undefined_features:X1"), ({"allowed_operators": [*OPERATORS, "LOG"]}, "unapproved_operators:LOG"),
    ({"allowed_operators": ["ADD"]}, "missing_operators"), ({"generation": {"candidate_count": 11}}, "large_scale_search_detected"), ({"full_backtest": {"limit": 11}}, "large_backtest_limit"),
])
def test_each_setting_is_looked_at(change, reason):
    config = DRAFT | change
    assert any(b.startswith(reason) for b in second_round.settings(config) + second_round.scale(config, 1))
    assert second_round.scale({"generation": {"candidate_count": 99, "reference_only": True}, "full_backtest": {"limit": 10}}, 1) == []


def test_records_are_judged_together(spark):
    bad = [("s2", "requires_new_data", None, "", None, True, True, False), ("s3", "needs_source_verification", "", "u", True, None, None, True), (None, None, None, None, None, None, None, None)]
    found = second_round.failures(DRAFT, seeds(spark, GOOD, *bad), spark.createDataFrame([("x", "requires_new_engine"), ("y", "simple")], second_round.STRATEGY))
    assert {f for f in found if f.endswith(":s2")} == {f"seed_factor_{r}:s2" for r in ("requires_new_data", "source_not_verified", "not_suggested_for_second_batch", "requires_new_external_data", "no_source", "requires_external_data", "requires_new_operator")}
    assert {f for f in found if f.endswith(":s3")} == {"seed_factor_unverified_computability:s3"} and "operation_strategy_requires_new_engine:x" in found
    assert "seed_manifest_empty_or_unreadable" in second_round.failures(DRAFT, seeds(spark, bad[-1])) and "more_broken_records" in second_round.failures(DRAFT, seeds(spark, GOOD, *bad), most=2)


def test_runs_are_equivalent_in_any_order(spark, tmp_path):
    account = spark.createDataFrame([("d1", 100.0, 0.5), ("d2", 101.0, None), ("d2", 101.0, None)], "trade_date string, cash double, rate double")
    near = account.orderBy(F.desc("trade_date")).withColumn("cash", F.col("cash") + 9e-9)
    both = equivalence.runs_compared({"a": account, "b": account}, {"a": near, "b": account.withColumn("rate", F.col("rate") + 2e-9)})
    got = {r["section"]: r for r in both.collect()}
    assert got["a"]["equal"] and got["a"]["first_difference"] is None and got["b"]["difference_count"] == 2 and got["b"]["first_difference"].startswith("b:{")
    assert equivalence.equivalent(both)["equivalent"] is False and equivalence.equivalent(both)["difference_count"] == 2
    other = equivalence.runs_compared({"a": account, "c": account}, {"a": account.withColumnRenamed("rate", "r")})
    assert {r["section"]: r["difference_count"] for r in other.collect()} == {"a": 1, "c": 3}
    sinks.write(account, f"{tmp_path}/x/a", "csv")
    sinks.write(account, f"{tmp_path}/y/a")
    tables = [equivalence.folder(spark, f"{tmp_path}/{n}", ["a", "b"]) for n in "xy"]
    assert tables[0].keys() == {"a"} and equivalence.equivalent(equivalence.runs_compared(*tables))["equivalent"]
    run = versions.Run(spark, f"{tmp_path}/r")
    run.publish({"a": account})
    assert equivalence.equivalent(equivalence.runs_compared({"a": run.table("a")}, {"a": account}))["equivalent"]


def test_formulas_fold_together_as_alone(spark):
    fold = lambda formulas: queries.backtest_accounts(spark, DATA, formulas)
    out = {r["section"]: r for r in validation.batch_probe(fold, {"low": "NEG(RET_STD20)", "up": "RET5"}).collect()}
    assert out.keys() == {"accounts", "trades", "failed"} and all(r["equal"] for r in out.values())


def test_rewards_before_a_run(spark):
    accounts = spark.createDataFrame([("f", d, e, r, r, 0.0, 0.1, 10.0) for d, e, r in (("d1", 100.0, 0.0), ("d2", 99.0, -0.01), ("d3", 96.0, -0.03), ("d4", 99.0, 0.03))] + [("g", "d1", 100.0, 0.0, 0.0, 0.0, 0.1, 10.0)],
                                     "formula string, trade_date string, total_equity double, net_return double, gross_return double, cumulative_cost double, turnover double, cash double")
    trades = spark.createDataFrame([("f", "buy", "filled")], "formula string, side string, status string")
    rows, told = validation.reward_preflight(validation.account_diagnosis(accounts, trades))
    assert told == {"formulas": 2, "available": 1, "ratio": 0.5, "blockers": []} and {r["formula"]: r["sortino_reason"] for r in rows.collect()} == {"f": None, "g": "no_negative_return_observation"}
    assert validation.reward_preflight(validation.account_diagnosis(accounts.filter("formula = 'g'"), trades))[1]["blockers"] == ["preflight_sortino_unavailable"]
    one = validation.rewards_described(spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,), (float("nan"),), (float("inf"),)], "train_reward double")).first()
    assert (one["count"], one["finite_count"], one["positive"], one["negative"], one["zero"], one["p50"]) == (6, 3, 1, 1, 1, 0.0)


def test_a_controlled_signal_is_learned():
    rows = validation.controlled_signal([0, 1, 2])
    assert all(r["after"] > 5 * r["before"] > 0 for r in rows) and len({r["after"] for r in rows}) == 3


def test_what_the_context_costs(spark):
    rows = {r["part"]: r for r in validation.context_profile(spark, DATA)}
    assert rows.keys() == {"bars", "calendar", "members", "lifecycle", "limits", "unavailable", "features"} and rows["bars"]["rows"] == rows["features"]["rows"] == rows["limits"]["rows"] > 0 and all(r["seconds"] > 0 for r in rows.values())
