"""Hand-computed values of the formula language, features, rules and joins."""

import math

import pytest
from pyspark.sql import functions as F

from panelforge.functions import features, formula
from panelforge.operators import crosssec, joins, regime, rules, stats, tables
from panelforge.sources import files
from panelforge.streaming.forward import tick


def prices(spark, days=90):
    """Two codes: one gains 2 % a day, the other swings between 40 and 50 with twice the volume every third day."""
    rows = [(f"d{i:03d}", "up", 8 * 1.02**i, 60.0, 480.0) for i in range(days)] + [(f"d{i:03d}", "swing", 40.0 + 10 * (i % 2), 30.0 * (1 + (i % 3 == 0)), 7.0 * i) for i in range(days)]
    return spark.createDataFrame(rows, "trade_date string, ts_code string, close double, volume double, amount double")


def test_features_warm_up_and_values(spark):
    out = {(r["ts_code"], int(r["trade_date"][1:])): r for r in features.compute(prices(spark), features.NAMES).collect()}
    up, swing = (lambda i, n: out["up", i][n]), (lambda i, n: out["swing", i][n])
    assert up(59, "RET60") is None and up(60, "RET60") == pytest.approx(1.02**60 - 1) and up(70, "RET_STD60") == pytest.approx(0, abs=1e-9)
    assert up(89, "DOWNSIDE_RET_STD20") == 0.0 and up(40, "VOL_RATIO20") == pytest.approx(0)
    assert swing(18, "TREND20") is None and swing(19, "TREND20") == pytest.approx(50 / 45 - 1) and swing(19, "RET_STD20") is None
    assert swing(20, "RET_STD20") == pytest.approx((0.25 + 0.2) / 2) and swing(20, "DOWNSIDE_RET_STD20") == pytest.approx(0.1)
    assert swing(25, "AMOUNT_MA20") == pytest.approx(7 * 15.5) and swing(60, "AMOUNT_MA60") == pytest.approx(7 * 30.5)
    assert swing(30, "VOLUME_WEIGHTED_RET") == pytest.approx(-0.2 * 60 / (30 * (1 + 7 / 20)))


def test_features_do_not_look_ahead(spark):
    df = prices(spark)
    cut = features.compute(df.filter("trade_date <= 'd065'"), features.NAMES)
    assert features.compute(df, features.NAMES).filter("trade_date <= 'd065'").exceptAll(cut).count() == 0
    assert features.compute(df.repartition(7), features.NAMES).exceptAll(features.compute(df.repartition(1), features.NAMES)).count() == 0


def test_formula_language():
    f = formula.parse("ADD(RET5,NEG(RET1))")
    assert f.tokens == ("ADD", "RET5", "NEG", "RET1") and f.problem() is None and f.canonical().text() == "ADD(NEG(RET1),RET5)"
    for tokens, why in (((), "empty_formula"), (("ADD",) * 9, "formula_too_long"), (("ADD", "RET1"), "unexpected_end"), (("RET1", "RET5"), "trailing_tokens"), (("FOO",), "unknown_token:FOO")):
        assert formula.Formula(tokens).problem() == why
    for text in ("ADD(RET1)", "RET1)", "FOO", "", "NEG RET1"):
        with pytest.raises(ValueError):
            formula.parse(text)
    drawn = formula.draw(3, 40)
    assert drawn == formula.draw(3, 40) and all(x.problem() is None for x in drawn)
    assert all(formula.mutate(x, 1).problem() is None for x in drawn) and not any(x.trivial() for x in formula.shallow())


def test_shared_sub_formulas(spark):
    df = features.compute(prices(spark), ["RET1", "RET5"])
    named = {"a": formula.parse("NEG(DELTA5(RET5))"), "b": formula.parse("ABS(DELTA5(RET5))"), "c": formula.parse("DIV(RET1,SUB(RET5,RET5))")}
    out = formula.columns(df, named)
    assert out.columns == [*df.columns, "a", "b", "c"]
    assert out.filter("a is not null and b <> abs(a)").count() == 0 and out.filter("c is not null").count() == 0


def test_tradability(spark):
    rows = [("buy", 11.0, 11.0, 9.0, "verified_rule", False, "limit_up_open"), ("sell", 9.0, 11.0, 9.0, "verified_rule", False, "limit_down_open"), ("buy", 10.0, 11.0, 9.0, "verified_rule", True, "missing_bar_on_open_day"), ("buy", 10.0, None, None, "missing_input", False, "missing_input"), ("buy", None, 1.0, 1.0, "verified_rule", False, "missing_or_invalid_raw_open"), ("buy", 10.0, 11.0, 9.0, "verified_rule", False, None)]
    df = spark.createDataFrame(rows, "side string, price double, up double, down double, status string, gone boolean, want string")
    got = df.withColumn("why", rules.trade_block(*map(F.col, ("side", "price", "up", "down", "status", "gone"))))
    assert got.filter("not (why <=> want)").count() == 0


def test_weekly_schedule(spark):
    days = ["20240102", "20240103", "20240104", "20240105", "20240108", "20240112", "20240115", "20240119", "20240122"]
    out = rules.weekly_schedule(spark.createDataFrame([(d,) for d in days], "trade_date string")).orderBy("signal_date").collect()
    assert [tuple(r) for r in out] == [("20240105", "20240108", "20240115"), ("20240112", "20240115", "20240122")]


def test_joins(spark):
    panel = spark.createDataFrame([(d, "a") for d in ("20240101", "20240105", "20240110")], "trade_date string, ts_code string")
    snaps = spark.createDataFrame([("20240103", "a"), ("20240110", "b")], "snapshot_date string, ts_code string")
    assert sorted(map(tuple, joins.members_on(panel, snaps).select("trade_date", "ts_code").collect())) == [("20240105", "a"), ("20240110", "b")]
    st = spark.createDataFrame([("a", "20240101", "20240105", 1), ("a", "20240104", "20240109", 0)], "ts_code string, start_date string, end_date string, st int")
    assert {r["trade_date"]: r["st"] for r in joins.state_on(panel, st, "st").collect()} == {"20240101": 1, "20240105": 0, "20240110": None}


def test_percentile_and_ranks(spark):
    df = spark.createDataFrame([("d", 10.0), ("d", 10.0), ("d", 20.0), ("d", 30.0), ("d", None)], "trade_date string, x double")
    out = df.select("x", crosssec.percentile_of("x", "trade_date").alias("p")).collect()
    assert sorted(r["p"] for r in out if r["x"] is not None) == [0.5, 0.5, 0.75, 1.0] and [r["p"] for r in out if r["x"] is None] == [None]


def test_metrics(spark):
    a = spark.createDataFrame([("f", "d1", 100.0, 0.0, 0.0, 0.0, 0.0, 100.0), ("f", "d2", 101.0, 0.01, 0.01, 1.0, 0.2, 1.0), ("f", "d3", 99.0, -0.0198, -0.0198, 2.0, 0.1, 9.0)], "formula string, trade_date string, total_equity double, net_return double, gross_return double, cumulative_cost double, turnover double, cash double")
    t = spark.createDataFrame([("f", "buy", "filled"), ("f", "buy", "unfilled"), ("f", "sell", "unfilled")], "formula string, side string, status string")
    m = stats.account_metrics(a, t).first()
    assert m["total_return"] == pytest.approx(-0.01) and (m["trade_count"], m["unfilled_buy_count"], m["unfilled_sell_count"]) == (1, 1, 1)
    assert m["cash_ratio"] == pytest.approx((1 + 1 / 101 + 9 / 99) / 3)  # the mean over all days
    assert m["sortino"] is None and m["cumulative_cost"] == 2.0 and m["max_drawdown"] == pytest.approx(99 / 101 - 1)


def test_event_log_is_idempotent(spark):
    log = spark.createDataFrame([("e1", "20240101", "p")], "event_id string, trade_date string, payload string")
    new = spark.createDataFrame([("e1", "20240101", "p"), ("e2", "20240102", "q"), ("e3", "20240105", "r")], log.schema)
    once = tick(log, new, "20240103")
    assert sorted(r["event_id"] for r in once.collect()) == ["e1", "e2"] and tick(once, new, "20240103").count() == 2
    with pytest.raises(Exception, match="integrity conflict"):
        tables.append_unique(log, log.withColumn("payload", F.lit("other")), "event_id", "payload").collect()


def test_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('﻿{"a": 1}\n\n{"a": 2}\n{bad\n', encoding="utf-8")
    assert sorted(r["a"] for r in files.json_lines(spark, str(p), "a int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception, match="malformed"):
        files.json_lines(spark, str(p), "a int").collect()
    assert files.plain_yaml("a:\n  b: 1\n  c: [x, 2]\nd: true # note\ne: 0.5") == {"a": {"b": 1, "c": ["x", 2]}, "d": True, "e": 0.5}
    assert files.made_market(spark).count() == 450


def test_regime_gate_holds_cash_while_off(spark):
    on = [False, True, True, True, False, True, True]
    days = spark.createDataFrame([(f"2024010{i + 1}", x) for i, x in enumerate(on)], "trade_date string, regime_on boolean")
    picks = spark.createDataFrame([(d, c) for d in ("20240103", "20240105", "20240107") for c in ("a", "b")], "trade_date string, ts_code string")
    returns = spark.createDataFrame([(f"2024010{i}", "a", 0.01 * i) for i in range(1, 8)] + [("20240104", "b", None)], "trade_date string, ts_code string, ret double")
    path = regime.gated_path(days, picks, returns, top_n=4, freq=2, cost_bps=10)
    got = {r["trade_date"][-1]: (r["holdings_count"], round(r["portfolio_return"], 6)) for r in path.collect()}
    # rebalance days are 1, 3, 5 and 7; the regime is off on 1 and 5, so 6 holds nothing
    assert got == {"1": (0, 0.0), "2": (0, 0.0), "3": (2, 0.0055), "4": (2, 0.01), "5": (0, 0.0), "6": (0, 0.0), "7": (2, 0.0155)}
    m = regime.path_metrics(path).first()
    assert (m["days"], m["risk_on_days"], m["switch_count"]) == (7, 5, 4) and m["total_return"] == pytest.approx(1.0055 * 1.01 * 1.0155 - 1)
    assert m["win_rate"] == pytest.approx(3 / 7) and m["sortino"] == 0.0 and m["calmar"] == 0.0
    free = regime.path_metrics(regime.cost_grid(path, [0, 10], 10), "portfolio_return", "cost_bps").orderBy("cost_bps").collect()
    assert free[0]["total_return"] == pytest.approx(1.0075 * 1.01 * 1.0175 - 1) and free[1]["total_return"] == pytest.approx(m["total_return"])
    assert regime.gated_path(days.limit(0), picks, returns).count() == 0 and regime.gated_path(days, picks.limit(0), returns).filter("portfolio_return <> 0").count() == 0


def test_window_summary(spark):
    rows = [("completed", True, 0.1), ("completed", False, -0.3), ("completed", None, None), ("entry_unfilled", None, 9.0), ("missing_execution_status", False, None)]
    m = stats.window_summary(spark.createDataFrame(rows, "status string, delayed_exit boolean, net_return double")).first()
    assert (m["target_window_count"], m["completed_window_count"], m["entry_unfilled_count"], m["delayed_exit_count"], m["net_return_count"]) == (5, 3, 1, 1, 2)
    assert m["mean_net_return"] == pytest.approx(-0.1) and m["median_net_return"] == pytest.approx(-0.1)


def test_bars_do_not_depend_on_the_path(spark, tmp_path):
    from panelforge.plans import queries

    small = tmp_path / "sf0.001"
    small.mkdir()
    days = spark.sql("select 1L l_orderkey, id + 1 l_linenumber, 7L l_suppkey, date_add(date'2024-01-01', cast(id as int)) l_shipdate, 2.0D l_quantity, 10.0D + id l_extendedprice from range(5)")
    days.write.parquet(str(small / "lineitem.parquet"))
    got = queries.bars_daily(spark, str(small)).orderBy("trade_date").collect()
    log, want = 0, []
    for i in range(5):
        log += (1000 + 100 * i) % 401 - 200
        want.append(math.floor(100_000 * math.exp(log / 10_000)) / 10_000)
    assert [r["raw_close"] for r in got] == want and [r["pre_close"] for r in got] == [None, *want[:-1]] and all(r["raw_low"] <= r["raw_open"] <= r["raw_high"] for r in got)
