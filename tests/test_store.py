"""Versions, tables of layers, runs, the factor store, numbered formulas, the learned generator, SQLite ranges."""

import json
import sqlite3
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import features, formula, formula_space
from panelforge.functions.formula import Formula, parse
from panelforge.search import learned
from panelforge.sources import sqlite, versions
from panelforge.sources.factor_store import FactorStore, looks_back

SCHEMA = "event_id string, payload string, day int"


def table(spark, tmp_path):
    return versions.Table(spark, f"{tmp_path}/t", ["event_id"], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_of_a_table(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.newest() == 0 and t.read().count() == 0
    one = spark.createDataFrame([("a", "p", 1), ("b", None, 2), ("b", None, 2)], SCHEMA)
    assert t.append_unique(one, "payload") == 1 and t.append_unique(one, "payload") == 1  # a replay adds nothing, null payloads neither
    assert rows(t.read()) == [("a", "p", 1), ("b", None, 2)]
    assert t.append_unique(spark.createDataFrame([("c", "q", 3), ("a", "p", 1)], SCHEMA), "payload") == 2
    for bad in ([("a", "other", 1)], [("b", "now known", 2)], [("d", "x", 1), ("d", "y", 1)], [("d", "x", 1), ("d", None, 1)]):
        with pytest.raises(Exception, match="integrity conflict"):
            t.append_unique(spark.createDataFrame(bad, SCHEMA), "payload")
    assert t.newest() == 2 and len(list((tmp_path / "t" / "data").iterdir())) == 2  # nothing is left of what failed
    assert t.upsert(spark.createDataFrame([("a", "new", 9), ("e", "r", 4)], SCHEMA)) == 3
    assert t.upsert(spark.createDataFrame([("a", "new", 9)], SCHEMA)) == 3
    assert t.insert_missing(spark.createDataFrame([("a", "no", 0), ("f", "s", 5)], SCHEMA)) == 4
    assert t.quarantine(spark.createDataFrame([("c",), ("nowhere",)], "event_id string")) == 5
    now = [("a", "new", 9), ("b", None, 2), ("e", "r", 4), ("f", "s", 5)]
    assert rows(t.read()) == now and rows(t.read(2)) == [("a", "p", 1), ("b", None, 2), ("c", "q", 3)] and t.read(0).count() == 0
    assert t.compact() == 6 and rows(t.read()) == now and len(t.manifest()["layers"]) == 1 and t.compact() == 6
    assert [(h["what"], h["rows"]) for h in t.history()] == [("append", 2), ("append", 1), ("upsert", 2), ("insert", 1), ("quarantine", 1), ("compact", 4)]
    t.stage(one)
    assert t.sweep() == 0 and t.sweep(0) == 1 and rows(t.read(3)) == [("a", "new", 9), ("b", None, 2), ("c", "q", 3), ("e", "r", 4)]


def test_two_writers_lose_nothing(spark, tmp_path):
    failed = []

    def write(k):
        try:
            for i in range(3):
                table(spark, tmp_path).append_unique(spark.createDataFrame([(f"{k}-{i}", "p", i), (f"both-{i}", "p", i)], SCHEMA), "payload")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = table(spark, tmp_path)
    assert not failed and Counter(r["event_id"] for r in t.read().collect()) == Counter([f"{k}-{i}" for k in (0, 1, "both") for i in range(3)])
    assert t.newest() == 6 and len(list((tmp_path / "t" / "data").iterdir())) == 6


def test_tasks_are_shared_by_drivers(spark, tmp_path):
    names = [f"t{i}" for i in range(3)]
    versions.Tasks(spark, f"{tmp_path}/q", "c1").add(spark.createDataFrame([(n,) for n in names], "task string"))
    done, failed = [], []

    def work(task):
        done.append(task)
        if task == "t2":
            raise ValueError("no")
        return f"did {task}"

    def drive(k):
        try:
            versions.Tasks(spark, f"{tmp_path}/q", "c1").run(f"driver{k}", work)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=drive, args=(k,)) for k in range(2)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    tasks = versions.Tasks(spark, f"{tmp_path}/q", "c1")
    assert not failed and sorted(done) == names
    assert {r["task"]: (r["state"], r["detail"]) for r in tasks.read().collect()} == {n: ("completed", f"did {n}") if n != "t2" else ("failed", "ValueError: no") for n in names}
    tasks.add(spark.createDataFrame([("t5",), ("t0",)], "task string"))
    assert tasks.claim("lost") == ["t5"] and tasks.claim("other") == [] and tasks.release("lost") > 0 and tasks.release("lost") == tasks.newest()
    assert tasks.claim("other", 3) == ["t5"] and tasks.finish("t0", "failed") == tasks.newest() and tasks.read().filter("task = 't0'").first()["state"] == "completed"
    with pytest.raises(ValueError, match="another configuration"):
        versions.Tasks(spark, f"{tmp_path}/q", "c2")


def test_a_run_appears_as_a_whole(spark, tmp_path):
    run = versions.Run(spark, f"{tmp_path}/r")
    a, b = spark.range(5), spark.range(7)
    assert run.publish({"a": a, "b": b}, notes={"x": 1}) == 1
    broken = b.withColumn("y", F.when(F.col("id") > 3, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        run.publish({"a": spark.range(1), "b": broken})
    with pytest.raises(ValueError, match="more than 10"):
        run.publish({"a": a, "b": b}, most_bytes=10)
    with pytest.raises(OSError, match="bytes left"):
        run.publish({"a": a}, most_bytes=1 << 60)
    assert run.newest() == 1 and run.table("a").count() == 5 and run.table("b").count() == 7 and len(list((tmp_path / "r" / "data").iterdir())) == 2
    run.stage(a)  # a writer that dies here
    assert versions.Run(spark, f"{tmp_path}/r").publish({"a": spark.range(2)}) == 2 and run.table("a").count() == 2 and run.table("b", 1).count() == 7


def panel(spark, days=60):
    return spark.sql(f"select concat('d', lpad(cast(d.id as string), 3, '0')) trade_date, concat('c', c.id) ts_code, 10 + d.id % 7 + c.id / 3.0D close, 5.0D + (d.id * c.id) % 5 volume, 1.0D * d.id amount from range({days}) d, range(4) c").selectExpr("trade_date", "ts_code", "cast(close as double) close", "cast(volume as double) volume", "cast(amount as double) amount")


def test_factor_store(spark, tmp_path):
    store = FactorStore(spark, f"{tmp_path}/f")
    bars = panel(spark)
    asked = []

    def evaluate(values):
        asked.append(sorted(r["formula"] for r in values.select("formula").distinct().collect()))
        return values.groupBy("formula").agg(F.round(F.avg("factor_value"), 9).alias("m"), F.count("factor_value").alias("n"))

    first = {"a": parse("ADD(RET1,RET5)"), "b": parse("NEG(DELTA5(RET1))")}
    out = store.results(bars, first, {"v": 1}, evaluate)
    assert {r["formula"]: r["from_store"] for r in out.collect()} == {"a": False, "b": False} and store.computed == ["ADD(RET1,RET5)", "DELTA5(RET1)", "NEG(DELTA5(RET1))"]
    again = {"x": parse("ADD(RET5,RET1)"), "c": parse("ABS(DELTA5(RET1))"), "b": first["b"]}
    out = {r["formula"]: r for r in FactorStore(spark, f"{tmp_path}/f").results(bars.repartition(3), again, {"v": 1}, evaluate).collect()}
    assert asked == [["a", "b"], ["c"]] and {k: r["from_store"] for k, r in out.items()} == {"x": True, "b": True, "c": False}
    plain = formula.columns(features.compute(bars, ["RET1", "RET5"]), again).agg(*[F.round(F.avg(k), 9).alias(k) for k in again], *[F.count(k).alias(f"n_{k}") for k in again]).first()
    assert {k: (r["m"], r["n"]) for k, r in out.items()} == {k: (plain[k], plain[f"n_{k}"]) for k in again}
    # known values need no panel: a bar that can't be read isn't
    unread = bars.withColumn("close", F.raise_error(F.lit("read")).cast("double"))
    store.values(unread, {"a": first["a"]}, store.panel_hash(bars)).collect()
    assert store.found == ["ADD(RET1,RET5)"] and store.computed == []
    store.values(bars, {"d": parse("SIGN(DELTA5(RET1))")}, parts=True).collect()
    assert store.found == ["DELTA5(RET1)"] and store.computed == ["SIGN(DELTA5(RET1))"]
    # other content, other settings
    store.results(bars.withColumn("close", F.col("close") + 1), first, {"v": 1}, evaluate)
    store.results(bars, first, {"v": 2}, evaluate)
    assert asked[2:] == [["a", "b"], ["a", "b"]]
    assert [p.text() for p in looks_back(parse("ADD(ZSCORE20(DELTA5(RET1)),DELTA5(RET1))"))] == ["DELTA5(RET1)", "ZSCORE20(DELTA5(RET1))"]


def enumerated(cap):
    """All formulas of at most ``cap`` tokens, by trying all tokens."""
    out, open_ = [], [()]
    while open_:
        prefix = open_.pop()
        for t in formula.next_tokens(prefix, cap):
            f = Formula((*prefix, t))
            (out if f.problem() is None else open_).append(f if f.problem() is None else f.tokens)
    return [f.tokens for f in out]


def test_numbered_formulas():
    for cap in (1, 2, 3, 4):
        want = enumerated(cap)
        assert formula_space.size(cap) == len(want) == len(set(want))
        got = formula_space.formulas_at(np.arange(len(want)), cap)
        made = [tuple(formula_space.TOKENS[t] for t in row if t >= 0) for row in got]
        assert set(made) == set(want) and all(formula_space.number_of(f, cap) == i for i, f in enumerate(made))
    # five tokens: counted, and every number leads back to itself
    n = formula_space.size(5)
    rows = formula_space.formulas_at(np.arange(0, n), 5)
    assert len(np.unique(rows, axis=0)) == n == len(enumerated(5))
    pick = np.random.default_rng(0).integers(0, formula_space.size(), 500)
    assert [formula_space.number_of(tuple(formula_space.TOKENS[t] for t in r if t >= 0)) for r in formula_space.formulas_at(pick)] == pick.tolist()


def test_drawn_formulas(spark):
    attempts = spark.range(3000, numPartitions=3).withColumn("number", formula_space.drawn_number(F.col("id"), 7, 4))
    got = formula_space.distinct_formulas(attempts, "id", "number", 4).collect()
    want = {}
    for r in attempts.collect():
        f = Formula(tuple(formula_space.TOKENS[t] for t in formula_space.formulas_at(np.array([r["number"]]), 4)[0] if t >= 0)).canonical()
        if not f.trivial():
            want.setdefault(f.sha256(), []).append((r["id"], f.text()))
    assert {r["formula_hash"]: (r["formula_text"], r["first_attempt"], r["attempts"]) for r in got} == {k: (v[0][1], min(v)[0], len(v)) for k, v in want.items()}
    odd = spark.createDataFrame([(None,), (-1,), (1 << 60,), (0,)], "number long")
    assert Counter(r["formula_text"] for r in formula_space.formulas(odd, "number").collect()) == Counter([None] * 3 + ["RET1"])


def test_three_hundred_thousand_attempts(spark):
    attempts = spark.range(300_000).withColumn("number", formula_space.drawn_number(F.col("id"), 1))
    one = formula_space.distinct_formulas(attempts, "id", "number").agg(F.count("*").alias("n"), F.sum("attempts").alias("a")).first()
    assert 290_000 < one["n"] <= one["a"] <= 300_000


def test_the_generator_learns():
    even = learned.drawn(learned.no_weights(), 4000, 1)
    assert all(learned.as_formula(r).problem() is None for r in even) and (learned.drawn(learned.no_weights(), 4000, 1) == even).all()
    # without weights all formulas are equally likely: their chance is one by their number
    log, used = learned.log_chances(learned.no_weights(), even)
    of = np.take_along_axis(log, np.maximum(even, 0)[:, :, None], axis=2)[:, :, 0]
    assert np.where(used, of, 0).sum(axis=1) == pytest.approx(-np.log(formula_space.size()))
    # the gradient is that of the log chance
    weights, batch, worth = np.random.default_rng(0).normal(size=(8, len(formula_space.TOKENS))), even[:20], np.linspace(-1, 1, 20)

    def value(w):
        log, used = learned.log_chances(w, batch)
        return float((worth * np.where(used, np.take_along_axis(log, np.maximum(batch, 0)[:, :, None], axis=2)[:, :, 0], 0).sum(axis=1)).sum())

    slope = learned.gradient(weights, batch, worth)
    for at in ((0, 0), (1, 20), (2, 5), (7, 3)):
        step = np.zeros_like(weights)
        step[at] = 1e-5
        assert (value(weights + step) - value(weights - step)) / 2e-5 == pytest.approx(slope[at], abs=1e-6)
    weights, wanted = learned.no_weights(), lambda rows: (rows == formula_space.TOKENS.index("RET5")).any(axis=1).astype(float)
    before = wanted(even).mean()
    for i in range(60):
        rows_ = learned.drawn(weights, 32, 2, i)
        weights = learned.improved(weights, rows_, wanted(rows_), 0.5)
    assert wanted(learned.drawn(weights, 500, 3)).mean() > before + 0.2
    assert (learned.improved(weights, even[:3], np.ones(3), 0.5) == weights).all() and (learned.improved(weights, even[:0], np.zeros(0), 0.5) == weights).all()


def test_a_search_goes_on_from_its_checkpoint():
    evaluate = lambda fs: ["bad" if "DIV" in f.tokens else float(len(f.tokens)) for f in fs]
    whole = learned.search(evaluate, learned.Budget(20, 30, 200), learned.Search(5))
    assert whole.done(learned.Budget(20, 30, 200)) and len(whole.order) == len(set(whole.order)) == len(whole.rewards) + len(whole.failed)
    part = learned.search(evaluate, learned.Budget(20, 30, 16), learned.Search(5))
    rest = learned.search(evaluate, learned.Budget(20, 30, 200), learned.Search(**json.loads(json.dumps(vars(part)))))
    assert vars(rest) == vars(whole)


def database(tmp_path):
    path = f"{tmp_path}/d b.db"
    with sqlite3.connect(path) as con:
        con.execute('create table p (trade_date text, ts_code text, close real, volume integer, "odd name" text)')
        con.executemany("insert into p values (?, ?, ?, ?, ?)", [(f"2024{1 + i // 50:02d}{1 + i % 28:02d}" if i % 97 else None, f"c{i % 9}", i / 4 if i % 5 else None, i, "x") for i in range(500)])
    return path


@pytest.mark.parametrize("key", ["rowid", "trade_date", "ts_code", "volume"])
def test_sqlite_ranges(spark, tmp_path, key):
    path = database(tmp_path)
    with sqlite3.connect(path) as con:
        want = con.execute("select * from p").fetchall()
    df = sqlite.read(spark, path, "p", key=key, parts=6, batch=17, progress=f"{tmp_path}/progress")
    assert dict(df.dtypes) == {"trade_date": "string", "ts_code": "string", "close": "double", "volume": "bigint", "odd name": "string"}
    assert Counter(map(tuple, df.collect())) == Counter(want) and 3 < df.rdd.getNumPartitions() <= 6
    done = sqlite.progress(f"{tmp_path}/progress")
    assert done["rows"] == 500 and done["hash"] == f"{sum(map(sqlite.row_hash, want)) % (1 << 128):032x}" and done["parts"] == df.rdd.getNumPartitions()


def test_sqlite_filters_reach_the_database(spark, tmp_path):
    path = database(tmp_path)
    few = sqlite.read(spark, path, "p", "ts_code string, volume long", key="volume", parts=4, progress=f"{tmp_path}/progress")
    got = few.filter("volume >= 100 and volume < 300 and ts_code in ('c1', 'c2') and ts_code is not null and volume % 2 = 0").collect()
    with sqlite3.connect(path) as con:
        want = con.execute("select ts_code, volume from p where volume >= 100 and volume < 300 and ts_code in ('c1', 'c2')").fetchall()
    assert sorted(map(tuple, got)) == sorted(w for w in want if w[1] % 2 == 0)
    assert sqlite.progress(f"{tmp_path}/progress")["rows"] == len(want)  # no other row left the database
    reader = sqlite.SqliteReader(few.schema, {"path": path, "table": "p"})
    kept = [sqlite.ds.EqualTo(("volume",), "7"), sqlite.ds.EqualTo(("a", "b"), 1), sqlite.ds.StringContains(("ts_code",), "c")]
    assert list(reader.pushFilters([sqlite.ds.EqualTo(("volume",), 7), *kept])) == kept and reader.conditions == ['"volume" = ?']
    assert sqlite.read(spark, path, "p").filter("volume > 10000").count() == 0
    with pytest.raises(Exception, match="no table"):
        sqlite.read(spark, path, "nowhere").count()
    with pytest.raises(sqlite3.OperationalError, match="readonly"):
        sqlite._open(path).execute("delete from p")


def test_generators_compared(spark):
    from panelforge.search import benchmark

    asked = []
    evaluate = lambda fs: asked.append(len(fs)) or ["bad" if "DIV" in f.tokens else float("RET5" in f.tokens) + len(f.tokens) / 100 for f in fs]
    budget = learned.Budget(40, 40, 60)
    summary, winners = benchmark.compared(spark, evaluate, budget, [0, 1, 2])
    rows_ = {(r["generator"], r["seed"]): r for r in summary.collect()}
    assert rows_.keys() == {(g, s) for g in ("policy", "uniform") for s in range(3)} and all(r["valid"] <= 40 and r["attempts"] == r["unique_formulas"] <= 60 for r in rows_.values())
    for r in winners.collect():
        a, b = rows_["policy", r["seed"]]["best"], rows_["uniform", r["seed"]]["best"]
        assert r["winner"] == ("policy" if a > b else "uniform" if b > a else "tie")


def test_completed_budget(tmp_path):
    from panelforge.search import benchmark

    evaluate = lambda fs: ["bad" if "DIV" in f.tokens else float(len(f.tokens)) for f in fs]
    config, path = {"seed": 3, "rate": 0.5}, tmp_path / "p.json"
    short = benchmark.completed_budget(path, evaluate, config, learned.Budget(12, 100, 8))
    assert not short["passed"] and short["stopped_by"] == "attempts" and short["attempts"] == 8
    rest = benchmark.completed_budget(path, evaluate, config, learned.Budget(12, 100, 400))
    whole = benchmark.completed_budget(tmp_path / "q.json", evaluate, config, learned.Budget(12, 100, 400))
    assert rest["passed"] and rest["resumed_from"] == short["completed"] and {**rest, "resumed_from": 0} == whole
    with pytest.raises(ValueError, match="another configuration"):
        benchmark.completed_budget(path, evaluate, config | {"seed": 4}, learned.Budget(12, 100, 400))
