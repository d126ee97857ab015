"""Quantiles, intervals, differences, rules and the forward log against plain definitions."""

import itertools
import random
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import checks, intervals, joins, multiset, quantiles
from panelforge.plans import evidence
from panelforge.streaming import forward_run

DATA = "/root/testdata/sf0.001"


def test_exact_quantiles(spark):
    pick = np.random.default_rng(1)
    groups = {"hot": [5.0] * 3000 + pick.normal(size=2000).round(2).tolist(), "few": [1.0, 2.0], "one": [7.5], "none": [None, None], None: [1.0, None, 4.0]}
    rows = [(k, x) for k, v in groups.items() for x in v]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    at = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.exact_quantiles(df, "x", at, ["g"]).collect()}
    want = {k: [x for x in v if x is not None] for k, v in groups.items() if any(x is not None for x in v)}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][0] == len(v) and got[k][1] == pytest.approx(np.quantile(v, at).tolist())
    whole = quantiles.exact_quantiles(df, "x", at).first()
    every = [x for v in want.values() for x in v]
    assert whole["n"] == len(every) and whole["q"] == pytest.approx(np.quantile(every, at).tolist())
    assert [tuple(r) for r in quantiles.exact_quantiles(df.limit(0), "x", [0.5]).collect()] == [(0, [None])] and quantiles.exact_quantiles(df.limit(0), "x", [0.5], ["g"]).count() == 0


def text(n):
    return (date(2020, 1, 1) + timedelta(days=n)).strftime("%Y%m%d")


def made_up_intervals(seed, n, code=("a", "b", "hot", "hot", "hot")):
    pick = random.Random(seed)
    return [(pick.choice(code), s := pick.randrange(400), s + pick.choice([0, 1, 5, 40, 300]), i % 4) for i in range(n)]


@pytest.mark.parametrize("width", [1, 16, 1000])
def test_overlaps(spark, width):
    a, b = made_up_intervals(1, 60), made_up_intervals(2, 50)
    rows = lambda x: [(c, text(s), text(e), v) for c, s, e, v in x]
    left = spark.createDataFrame([*rows(a), ("a", None, text(1), 9), ("a", text(9), text(3), 9), ("a", "20201399", text(9), 9)], "code string, s string, e string, v int")
    right = spark.createDataFrame(rows(b), "code string, s2 string, e2 string, v2 int")
    got = Counter((r["code"], r["s"], r["e"], r["v"], r["s2"], r["e2"], r["v2"]) for r in intervals.overlaps(left, right, ["code"], ("s", "e"), ("s2", "e2"), width).collect())
    assert got == Counter((c, text(s), text(e), v, text(s2), text(e2), w) for c, s, e, v in a for c2, s2, e2, w in b if c == c2 and s <= e2 and s2 <= e)


@pytest.mark.parametrize("width", [3, 128])
def test_timeline(spark, width):
    periods = made_up_intervals(3, 40)
    df = spark.createDataFrame([(c, text(s), text(e), v) for c, s, e, v in periods], "code string, start_date string, end_date string, v int")
    got = intervals.timeline(df, ["code"], "v", width).collect()
    days = {}
    for c, s, e, v in periods:
        for d in range(s, e + 1):
            days[c, d] = max(days.get((c, d), (-1, -1, -1)), (s, e, v))
    told = {}
    for r in got:
        d = r["start_date"]
        while d <= r["end_date"]:
            assert (r["code"], d) not in told
            told[r["code"], d] = r["v"]
            d = (date(int(d[:4]), int(d[4:6]), int(d[6:])) + timedelta(days=1)).strftime("%Y%m%d")
    assert told == {(c, text(d)): x[2] for (c, d), x in days.items()}
    ends = {(r["code"], r["end_date"]): r["v"] for r in got}
    for r in got:  # neighbours differ
        d = (date(int(r["start_date"][:4]), int(r["start_date"][4:6]), int(r["start_date"][6:])) - timedelta(days=1)).strftime("%Y%m%d")
        assert ends.get((r["code"], d)) != r["v"]


def fewest_alone(a, b, close):
    """Rows of ``a`` without a partner in a largest matching, by trying augmenting paths row by row."""
    partner = {}

    def place(i, seen):
        for j in range(len(b)):
            if j not in seen and close(a[i], b[j]):
                seen.add(j)
                if j not in partner or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return len(a) - sum(place(i, set()) for i in range(len(a)))


@pytest.mark.parametrize("columns", [1, 2])
def test_unmatched_rows_are_as_few_as_can_be(spark, columns):
    pick = random.Random(columns)
    left, right, want = [], [], {}
    for g in range(150):
        one = lambda: tuple(pick.choice([None, 0.0, 0.4, 1.0, 1.3, 2.0, 2.9, 7.0, float("nan")]) for _ in range(columns))
        a, b = [one() for _ in range(pick.randint(0, 7))], [one() for _ in range(pick.randint(0, 7))]
        none = lambda x: x is None or x != x
        close = lambda x, y: all(none(p) and none(q) or not none(p) and not none(q) and abs(p - q) <= 1.0 for p, q in zip(x, y, strict=True))
        want[g] = (fewest_alone(a, b, close), fewest_alone(b, a, close))
        left += [(g, "s", *x) for x in a]
        right += [(g, "s", *x) for x in b]
    names = ["x", "y"][:columns]
    schema = "g int, t string, " + ", ".join(f"{n} double" for n in names)
    out = multiset.unmatched(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g", "t"], dict.fromkeys(names, 1.0))
    got = {r["g"]: (r["a"], r["b"]) for r in out.groupBy("g").agg(F.sum("left").alias("a"), F.sum("right").alias("b")).collect()}
    assert {g: got.get(g, (0, 0)) for g in want} == want
    same = spark.createDataFrame(left, schema)
    assert multiset.unmatched(same, same.repartition(3), ["g", "t"], dict.fromkeys(names, 1e-9)).count() == 0
    assert multiset.unmatched(same, same.limit(0), ["g", "t"], dict.fromkeys(names, 1e-9)).agg(F.sum("left")).first()[0] == len(left)


def test_unmatched_rows_without_tolerances(spark):
    a, b = spark.createDataFrame([("p",), ("p",), (None,), ("q",)], "k string"), spark.createDataFrame([("p",), (None,), ("r",)], "k string")
    assert sorted(map(str, map(tuple, multiset.unmatched(a, b, ["k"], {}).collect()))) == ["('p', 1, 0)", "('q', 1, 0)", "('r', 0, 1)"]


def test_rules_in_one_pass(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 2, -1.0), ("c", 3, None), (None, 4, -2.0)], "code string, day int, x double")
    rules = [checks.Rule("negative", F.col("x") < 0, "g"), checks.Rule("missing", F.col("x").isNull()), checks.Rule("never", F.lit(False))]
    out = checks.judged(df, rules, ["code", "day"])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("negative", "g", 2, ":4", "b:2"), ("missing", "", 1, "c:3", "c:3"), ("never", "", 0, None, None)]))
    assert checks.first_failures(out) == ["missing:1:c:3", "negative:2::4"] and checks.first_failures(checks.judged(df.limit(0), rules, ["code"])) == []
    n, seen = checks.profiled(df, lambda x: x.filter("x < 0").count())
    assert n == 2 and seen["rows"] == 4 and seen["seconds"] > 0


def test_forward_log_of_events(spark):
    """The registered query against a walk over each protocol's events, in order of time."""
    got = sorted(map(tuple, evidence.forward_log(spark, DATA).collect()))
    events = [tuple(r) for r in evidence.forward_events(spark.read.parquet(f"{DATA}/events.parquet")).withColumn("ts", F.unix_millis("ts")).collect()]
    through = max(e[4] for e in events) - 2 * 86_400_000
    want = []
    for p, own in itertools.groupby(sorted(events), key=lambda e: e[0]):
        rows, _ = forward_run.walk(p, forward_run.Progress(), [(e[4], e[1], e[2], e[3]) for e in own], through)
        want += rows
    assert got == sorted(want) and {r[2] for r in got} >= {"signal", "missed_signal_cycle", "activation_pending"}


@pytest.mark.parametrize("width", [1.0, 7.0, 1e6])
def test_as_of_rows(spark, width):
    pick = random.Random(9)
    left = [(pick.choice(["a", "b", "hot", "hot", None]), pick.choice([None, *range(60)]), i) for i in range(120)]
    right = [(pick.choice(["a", "hot", "hot", None]), pick.choice([None, *range(0, 60, 3)]), i) for i in range(60)]
    df, marks = spark.createDataFrame(left, "k string, t long, i int"), spark.createDataFrame(right, "k string, u long, v int")
    for tolerance in (None, 4.0, 0.0):
        got = {r["i"]: (r["u"], r["v"]) for r in joins.as_of_rows(df, marks, ["k"], "t", "u", tolerance, width).collect()}
        want = {}
        for k, t, i in left:
            hits = [(u, v) for c, u, v in right if k is not None and t is not None and c == k and u is not None and u <= t]
            best = max(hits, default=(None, None))
            want[i] = best if hits and (tolerance is None or t - best[0] <= tolerance) else (None, None)
        assert got == want
    assert joins.as_of_rows(df.limit(0), marks, ["k"], "t", "u").count() == 0 and joins.as_of_rows(df, marks.limit(0), ["k"], "t", "u").filter("v is not null").count() == 0
