"""Ties that keys leave open, and work that may not grow faster than its tables."""

import time

import duckdb
from pyspark.sql import functions as F

from panelforge.operators import multiset
from panelforge.plans.registry import ORACLES, QUERIES
from panelforge.sources import bars as src

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


def line(order, number, price, flag, day, part=7):
    from datetime import datetime

    return (order, part, 1, number, 1.0, price, 0.0, 0.05, flag, "O", datetime(1996, 1, day))


def test_lines_of_one_number_and_part_count_in_order_of_the_table(spark, tmp_path):
    """As in DuckDB the first of equal ones is taken, for the first entry as for the last exit, whatever its columns."""
    rows = []
    for order, days in ((1, (9, 3, 5)), (2, (3, 9, 5)), (3, (5, 3, 9))):
        rows += [line(order, 1, 100.0 + d, "N", d) for d in days] + [line(order, 2, 200.0 + d, "N", d) for d in days]
    rows += [line(4, 1, 100.0, "R", d) for d in (8, 2)] + [line(5, 1, 100.0, "N", 1)] + [line(5, 2, 100.0, "R", d) for d in (8, 2)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 1, "F", 1.0) for k in range(1, 7)], ORDERS).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["window_status"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("set threads = 1")
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    names = ["window_id", "status", "failure_reason", "delayed_exit", "net_return", "actual_entry_date", "actual_exit_date"]
    want = con.execute(f"select {', '.join(names)} from ({ORACLES['window_status']})").fetchall()
    rows = sorted(map(tuple, got.select(names).collect()))
    assert rows == sorted(want)
    assert [r[5:] for r in rows[:3]] == [("19960109", "19960109"), ("19960103", "19960103"), ("19960105", "19960105")] and [r[2] for r in rows[3:5]] == ["19960108", "19960108"]


def test_lines_with_missing_values_count_as_in_sql(spark, tmp_path):
    """Without a flag or a number a line is no trade; without a part it is counted, but never first or last; without a day it gives no reason."""
    rows = [line(1, 1, 100.0, None, 2), line(1, 2, 110.0, "N", 4), line(2, 1, 100.0, "N", 2), line(2, None, 110.0, "N", 4), line(3, 1, 100.0, "N", 2, None), line(3, 1, 105.0, "N", 3), line(3, 2, 110.0, "N", 4, None)]
    rows += [line(4, 1, 100.0, "R", 2, None), line(5, 2, 100.0, "R", 5), line(5, 2, 100.0, None, 6), line(5, 1, 100.0, "A", 6), line(7, 3, 100.0, "R", 9), line(None, 1, 100.0, "N", 2)]
    rows += [(6, 1, 1, 1, 1.0, 100.0, 0.0, 0.05, "R", "O", None), line(6, 1, 100.0, "R", 7), (8, 7, 1, 1, 1.0, None, 0.0, None, "N", "O", None), line(8, 2, 100.0, "N", 7)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 1, "F", 1.0) for k in (*range(1, 10), None)], ORDERS).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    names = ["window_id", "status", "failure_reason", "delayed_exit", "net_return", "actual_entry_date", "actual_exit_date"]
    want = con.execute(f"select {', '.join(names)} from ({ORACLES['window_status']})").fetchall()
    assert sorted(map(tuple, QUERIES["window_status"](spark, str(tmp_path)).select(names).collect()), key=str) == sorted(want, key=str)


def test_rows_are_placed_by_file_and_row(spark, tmp_path):
    for i in (1, 0, 2):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/t/part={i}")
    places = [r["id"] for r in src.placed(spark.read.parquet(f"{tmp_path}/t")).orderBy("place").collect()]
    assert places == list(range(30))


def test_many_runs_are_no_groups_of_their_own(spark):
    """400,000 runs of two rows in seconds (one grouped call each took minutes), with and without exact columns."""
    start = time.time()
    a = spark.range(400_000).select((F.col("id") % 7).alias("k"), (F.col("id") / 10).alias("x"))
    b = a.select("k", (F.col("x") + F.when(F.col("x") % 1000 == 0, 0.01).otherwise(1e-9)).alias("x"))
    assert multiset.unmatched(a, b, ["k"], {"x": 1e-8}).agg(F.sum("left"), F.sum("right")).first()[:] == (40, 40)
    assert multiset.unmatched(a.select("x"), b.select("x"), [], {"x": 1e-8}).agg(F.sum("left"), F.sum("right")).first()[:] == (40, 40)
    assert time.time() - start < 60


def test_runs_go_on_behind_a_batch(spark):
    """Runs longer than an Arrow batch, of one column and of two, keep their exact columns and have as few rows alone as in one batch."""
    rows = [(1 << 60 | g, f"t{g}", g * 100 + i * 0.4, float(i % 3)) for g in range(5) for i in range(3 + 9 * g)]
    a = spark.createDataFrame(rows, "k long, t string, x double, y double")
    b = a.filter("x % 2 < 1")
    got = {}
    for n in (10_000, 2):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        for most in ({"x": 0.5}, {"x": 0.5, "y": 1.0}):
            got[n, len(most)] = sorted(map(tuple, multiset.unmatched(a, b, ["k", "t"], most).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[2, 1] == got[10_000, 1] and got[2, 2] == got[10_000, 2]
    assert {r[0] for r in got[2, 1]} <= {r[0] for r in rows} and sum(r[-2] for r in got[2, 1]) == len(rows) - b.count()


def test_a_screen_shuffles_a_row_a_key_and_bars_their_lines_once(spark):
    """The panel isn't exploded before its shuffle, a date's rows aren't dealt again, bars don't join themselves for their limits."""
    from panelforge.operators import crosssec
    from panelforge.plans import queries as q

    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([("20240101", "a", 0.1, 1.0, 2.0)], "trade_date string, ts_code string, forward_return double, x double, y double")
        assert shuffles(crosssec.by_date(crosssec.long_form(df, ["x", "y"]))) == 1
        assert shuffles(src.bars(spark, "/root/testdata/sf0.001")) == 1
        assert shuffles(q.tradability_case(spark, "/root/testdata/sf0.001")) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_stored_screen_keeps_and_shuffles_a_row_a_key(spark, tmp_path):
    """Values are kept a row a key, dealt out once before they become a row a formula, and no shuffle files stay; bars and features share one shuffle."""
    from pathlib import Path

    from panelforge.functions import features
    from panelforge.functions.formula import parse
    from panelforge.operators import crosssec
    from panelforge.sources.factor_store import FactorStore

    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    bars = crosssec.forward_return(src.bars(spark, "/root/testdata/sf0.001"), 5)
    store, seen = FactorStore(spark, f"{tmp_path}/f"), []

    def evaluate(values):
        seen.append((shuffles(crosssec.by_date(values)), sorted(map(tuple, values.select("formula", *src.KEY, "factor_value", "forward_return").collect()), key=str)))
        return values.groupBy("formula").agg(F.count("*").alias("n"))

    texts = {"a": "RET5", "b": "NEG(RET_STD20)", "c": "MUL(RET1,RET5)", "again": "MUL(RET5,RET1)"}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert shuffles(features.compute(bars, ["RET5", "RET_STD20"])) == 1
        panel = store.panel_hash(bars)
        made = lambda settings: store.results(bars, {k: parse(t) for k, t in texts.items()}, settings, evaluate, panel, ("forward_return",), keep=True, deal="trade_date").collect()
        first = made({"v": 1})
        kept = {(e["path"], e["rows"]) for e in store.manifest()["columns"].values()}
        assert len(store.manifest()["columns"]) == 3 and [n for _, n in kept] == [bars.count()]  # one table, not a row a key and formula
        second = made({"v": 2})  # the values are known, and go along with what the bars say
        assert seen[0][0] == 1 and seen[0][1] == seen[1][1] and len(seen[0][1]) == 3 * bars.count() and sorted(r["formula"] for r in first) == sorted(texts) == sorted(r["formula"] for r in second)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    written = files()
    store.results(bars, {"d": parse("ABS(RET5)")}, {"v": 1}, lambda values: values.repartition("formula").groupBy("formula").agg(F.count("*").alias("n")), panel, ("forward_return",), keep=True, deal="trade_date")
    assert files() <= written and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_tasks_of_a_screen_get_so_many_rows_of_a_key_and_formula(spark):
    """Twenty times as many rows are dealt to twenty tasks, however few bytes their keys have."""
    from panelforge.sources import factor_store

    wide = spark.createDataFrame([("20240101", "a", 1.0, 2.0)], "trade_date string, ts_code string, f_x double, f_y double")
    long = factor_store._long(wide, {"x": "x", "y": "y"}, (), "trade_date", 10 * factor_store.TASK_ROWS)
    assert long.rdd.getNumPartitions() == 20 and sorted(r["factor_value"] for r in long.collect()) == [1.0, 2.0]


def test_a_day_as_arrays_is_what_windows_say(spark):
    """Ties, missing and infinite values, short and level days; no row a formula, one shuffle and one sort by date."""
    import random

    from panelforge.operators import crosssec
    from panelforge.schema import finite

    draw = random.Random(5)
    value = lambda k: draw.choice([None, float("inf"), *[draw.randrange(k) / 4 for _ in range(12)]])
    rows = [(f"d{d:02}", f"{draw.randrange(10**6):06}x{i}", value(9), value(6), value(1), None if d == 3 else draw.choice([None, draw.randrange(12) / 8, draw.random()])) for d in range(24) for i in range(d * 2)]
    rows += [("e1", f"{i:03}", float(i), float(-i), float(i % 2), 0.5 - i % 3) for i in range(30)] + [(None, f"{i}", float(i), 1.0, 2.0, float(i * i)) for i in range(12)]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, x double, y double, z double, forward_return double")
    df = df.withColumns({c: finite(F.col(c)) for c in "xyz"})
    names = ["x", "y", "z"]
    tidy = lambda days: sorted([(r["formula"], str(r["trade_date"]), r["rows"], r["n"], *[None if r[c] is None else round(r[c], 9) + 0 for c in ("ic", "dispersion", "spread", "monotonicity")], sorted(r["top_set"])) for r in days.collect()])
    got = crosssec.by_date_wide(df, names)
    assert tidy(got) == tidy(crosssec.by_date(crosssec.long_form(df, names)))
    assert sum(r[4] is not None for r in tidy(got)) > 20 and sum(r[7] is not None for r in tidy(got)) > 10
    level = crosssec.by_date_wide(df.filter("trade_date = 'e1'").withColumn("forward_return", F.lit(0.5)), ["x"]).first()
    assert (level["n"], level["ic"], level["spread"], level["monotonicity"]) == (30, None, 0.0, None)
    plan = QUERIES["screen_verdicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_set" not in plan
