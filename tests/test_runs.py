"""Sinks, providers, progress, gates, the command line, the fold by hand, streams."""

import json

import numpy as np
import pandas as pd
import pytest

from panelforge import cli
from panelforge.operators import backtest, gates, research
from panelforge.search.progress import Progress
from panelforge.sources import bars as src, files, provider, sinks
from panelforge.streaming import forward

DATA = "/root/testdata/sf0.001"


def test_staged_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for kind in sinks.FORMATS:
        path = f"{tmp_path}/{kind}"
        assert sinks.write(df, path, kind) > 0 and sinks.write(df.limit(1), path, kind) > 0
        assert spark.read.format(kind).option("header", True).load(path).count() == 1
    with pytest.raises(ValueError, match="more than"):
        sinks.write(df, f"{tmp_path}/parquet", "parquet", 10)
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 1 and not list(tmp_path.glob("*.staging-*")) and not list(tmp_path.glob("*.old-*"))
    assert sinks.content_hash(df) == sinks.content_hash(df.orderBy("k", ascending=False)) != sinks.content_hash(df.limit(1))


@pytest.mark.parametrize("by_spark", [False, True])
def test_sealed_folders(spark, tmp_path, by_spark):
    s = spark if by_spark else None
    sinks.atomic_text(tmp_path / "a" / "x.txt", "one")
    sinks.atomic_text(tmp_path / "y.txt", "two")
    sinks.atomic_text(tmp_path / "a b %" / "é.txt", "three")
    assert sinks.seal(tmp_path, s) == sinks.stable_hash(sinks._hashes(tmp_path, None))
    assert sinks.broken(tmp_path, s) == []
    (tmp_path / "y.txt").unlink()
    (tmp_path / "a" / "x.txt").chmod(0o644)
    (tmp_path / "z.txt").write_text("new")
    assert sinks.broken(tmp_path, s) == ["missing: y.txt", "new: z.txt", "writable: a/x.txt"]
    assert "| 0.5 |" in sinks.markdown("t", [{"x": 0.5}]) and sinks.stable_hash({"b": 1, "a": 2}) == sinks.stable_hash({"a": 2, "b": 1})


def test_files_and_providers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("d,x\n20240101,1.5\n20240102,NaN\n20240103,\n")
    assert [r["x"] for r in files.csv(spark, f"{tmp_path}/x.csv", "d string, x double").orderBy("d").collect()] == [1.5, None, None]
    tables = provider.Tables(spark, DATA)
    cached = provider.Cached(tables, "19950101", "19951231")
    inner = cached.bars("19950301", "19950331")
    assert inner.count() == tables.bars("19950301", "19950331").count() > 0 and cached.limits("19950301", "19950331").count() == inner.count()
    with pytest.raises(ValueError):
        cached.bars("19940101", "19950331")
    cached.close()
    plan = src.bars(spark, DATA, "19950101", "19951231")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_" in plan and plan.count("PushedFilters") == 1


def market(rows: list[tuple], days: int, names: list[str]) -> backtest.Market:
    frame = pd.DataFrame(rows, columns=["trade_date", "ts_code", "raw_open", "raw_close", "buy_block", "sell_block"])
    return backtest.Market(frame, [f"d{i}" for i in range(days)], names)


def test_fold_by_hand():
    """Two names; b can't be bought on day 1, a can't be sold on day 2; a's bar is missing on day 3."""
    m = market([
        ("d0", "a", 10.0, 10.0, None, None), ("d0", "b", 20.0, 20.0, None, None), ("d1", "a", 10.0, 11.0, None, None), ("d1", "b", 22.0, 22.0, "limit_up_open", None),
        ("d2", "a", 9.9, 9.9, None, "limit_down_open"), ("d2", "b", 21.0, 21.0, None, None), ("d3", "b", 20.0, 20.0, None, None), ("d4", "a", 12.0, 12.0, None, None), ("d4", "b", 20.0, 21.0, None, None)], 5, ["a", "b"])
    out = backtest.fold(m, {"d0": ["a", "b"], "d1": ["b"], "d2": ["b"], "d3": ["b"]}, {"d0", "d1", "d2", "d3"}, 10_000.0, 10.0, 2)
    trades = [(r["trade_date"], r["side"], r["ts_code"], r["quantity"], r["reason"]) for r in out if r["kind"] == "trade"]
    assert trades == [
        ("d1", "buy", "a", 500, None), ("d1", "buy", "b", 0, "limit_up_open"), ("d2", "sell", "a", 0, "limit_down_open"), ("d2", "buy", "b", 200, None),
        ("d3", "sell", "a", 0, "missing_or_invalid_raw_open"), ("d4", "sell", "b", 100, None), ("d4", "sell", "a", 500, None)]  # on d3 only names with a bar count as equity
    accounts = {r["trade_date"]: r for r in out if r["kind"] == "account"}
    cash = 10_000 - 5000 * 1.001
    assert accounts["d1"]["cash"] == pytest.approx(cash) and accounts["d1"]["total_equity"] == pytest.approx(cash + 5500)
    cash -= 4200 * 1.001
    assert accounts["d3"]["market_value"] == pytest.approx(500 * 9.9 + 200 * 20)  # a keeps its last close
    assert accounts["d4"]["cash"] == pytest.approx(cash + 8000 * 0.999) and accounts["d4"]["cumulative_cost"] == pytest.approx(5 + 4.2 + 2 + 6)


def test_account_rules():
    book = backtest.Account(10_000.0, 2, 10.0)
    assert book.buy(0, 100, 10.0, 0) == pytest.approx(1.0) and book.buy(1, 1000, 10.0, 0) is None
    none = np.array([None], object)
    assert book.sell_all(np.array([0]), np.array([100]), np.array([11.0]), none)[1].tolist() == ["unavailable_quantity"]
    book.begin(1)
    book.buy(0, 100, 10.0, 1)  # a larger position is not for sale that day
    assert book.free[0] == 0
    book.begin(2)
    cost, why = book.sell_all(np.array([0]), np.array([200]), np.array([11.0]), none)
    assert why.tolist() == [None] and cost[0] == pytest.approx(2.2) and book.shares[0] == 0
    assert backtest.lots(10_000.0, 0.5, np.array([33.0, 60.0])).tolist() == [100, 0]


def test_target_windows():
    rows = [(f"d{i}", "a", 10.0 + i, 10.0 + i, None, "limit_down_open" if i == 2 else None) for i in range(6)]
    m = market(rows, 6, ["a"])
    wanted = pd.DataFrame([("w1", "d1", "d2", "a", 0.5), ("w2", "d3", "d9", "a", 0.2), ("w3", "d1", "d2", "zz", 0.5), ("w4", "d4", "d5", "a", 2.0)], columns=["window_id", "entry_date", "exit_date", "ts_code", "weight"])
    out = {r["window_id"]: r for r in backtest.windows(wanted, m, 10_000.0, 0.0).to_dict("records")}
    assert out["w1"]["status"] == "completed" and out["w1"]["actual_exit_date"] == "d3" and bool(out["w1"]["delayed_exit"]) and out["w1"]["net_return"] == pytest.approx(13 / 11 - 1)
    assert out["w2"]["status"] == "entry_filled_exit_incomplete" and out["w3"]["failure_reason"] == backtest.NO_BAR and out["w4"]["failure_reason"] == backtest.NO_CASH


def test_progress(tmp_path):
    path = tmp_path / "p.json"
    p = Progress(path, ["a", "b", "c"], {"x": 1})

    def work(task):
        if task == "b":
            raise ValueError("no")
        if task == "c":
            raise KeyboardInterrupt
        return {"n": 1}

    with pytest.raises(KeyboardInterrupt):
        p.run(work)
    p = Progress(path, ["a", "b", "c"], {"x": 1})
    assert p.states == {"a": "completed", "b": "failed", "c": "interrupted"} and p.left() == ["b", "c"] and p.extra["b"]["error"] == "ValueError: no"
    p.run(lambda t: None)
    assert p.left() == []
    with pytest.raises(ValueError, match="another configuration"):
        Progress(path, ["a"], {"x": 2})


def test_gates():
    config = {"rebalance_days": 5, "top_n": 20, "cost_bps": 20, "cash": 1e6, "unknown_limit_policy": "reject_trade", "formulas": ["NEG(RET5)"], "splits": {s: {"start": f"{y}0101", "end": f"{y}1231"} for s, y in (("train", 2020), ("validation", 2021), ("blind", 2022))}}
    assert gates.research_run(config) == []
    bad = gates.research_run(config | {"top_n": 0, "unknown_limit_policy": "block", "formulas": ["ADD(RET1,RET5)", "ADD(RET5,RET1)", "X"], "more": 1, "splits": config["splits"] | {"blind": {"start": "20210601", "end": "20221231"}}})
    assert {b.split(":")[0] for b in bad} == {"unknown_setting", "top_n_out_of_range", "unknown_limit_policy_must_be", "repeated_formula", "unreadable_formula", "blind_start_not_after_validation_end"}
    assert gates.differences("f", "ab", "bc") == ["f_missing:a", "f_extra:c"]
    assert gates.frozen([{"formula_hash": "a"}, {"formula_hash": "a"}], "x", 3, lambda s: "y") == ["shortlist_id_mismatch", "shortlist_count:2", "shortlist_repeats"]


def test_verdicts_on_nulls(spark):
    rows = spark.createDataFrame([("a", None, None, None), ("b", "ok", 10, None), ("c", "ok", None, 1.0), ("d", "ok", 10, 2.0)], "formula_hash string, status string, trade_count int, sortino double")
    got = {r["formula_hash"]: (r["reward"], r["failure_reason"]) for r in research.reward_verdict(rows, 5).collect()}
    assert got == {"a": (-1.0, "insufficient_trade_count"), "b": (-1.0, "sortino_unavailable"), "c": (-1.0, "insufficient_trade_count"), "d": (2.0, None)}


def test_items_of_any_shape(spark):
    texts = ['[{"url":"a","title":"t"}]', '{"data":[{"sourceURL":"b","content":"x"}]}', '{"data":1,"items":[{"url":"c","metadata":{"title":"m"}}]}', '{"url":"d"}', '{"other":1}', "no json", None]
    out = research.flatten_items(spark.createDataFrame([(t,) for t in texts], "response string")).collect()
    assert sorted((r["url"], r["title"], r["text"]) for r in out) == [("a", "t", ""), ("b", "", "x"), ("c", "m", ""), ("d", "", "")]


def test_stream_of_events(spark, tmp_path):
    """Each event is written once, though its file comes twice."""
    e = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:00:00", "x") for i in range(9)], "event_id long, ts string, event_type string").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type")
    e.write.parquet(f"{tmp_path}/in")
    for turn in range(2):
        stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
        forward.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination(120)
        e.write.mode("append").parquet(f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_command_line(spark, tmp_path, capsys):
    assert set(cli.COMMANDS) >= {"smoke-test", "backtest", "mine", "resume", "status", "report", "diagnose-daily-bars", "factor-research-v2"}
    assert cli.main(["backtest", "--data", DATA, "--formula", "NEG(RET5)", "--out", f"{tmp_path}/b"]) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/b/accounts").count() > 100 and "formula" in (tmp_path / "b" / "report.md").read_text()
    (tmp_path / "c.yaml").write_text("top_n: 0\n")
    assert cli.main(["completed-budget-gate", "--config", f"{tmp_path}/c.yaml"]) == 1
    assert "top_n_out_of_range" in capsys.readouterr().out
