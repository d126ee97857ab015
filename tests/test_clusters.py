"""Parallel greedy clusters and blocked rank correlations against plain walks."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import correlation, graphs


def walk(order, close):
    """The sequential walk: a name joins the first kept one it is close to, else it is kept."""
    kept, members = [], {}
    for name in order:
        first = next((k for k in kept if (name, k) in close or (k, name) in close), None)
        if first is None:
            kept.append(name)
        else:
            members[name] = first
    return kept, members


def test_a_thousand_graphs(spark):
    pick = random.Random(4)
    names, edges, want = [], [], set()
    for g in range(1000):
        n = pick.randint(1, 12)
        order = [f"n{i}" for i in range(n)]
        pick.shuffle(order)
        close = {(a, b): pick.choice([-1, 1]) * pick.choice([0.5, 0.7, 0.9]) for a in order for b in order if a < b and pick.random() < pick.choice([0.05, 0.2, 0.6])}
        names += [(g, x, i) for i, x in enumerate(order)]
        edges += [(g, a, b, c) if pick.random() < 0.5 else (g, b, a, c) for (a, b), c in close.items()]
        close = {k: c for k, c in close.items() if abs(c) >= 0.7}
        kept, members = walk(order, close)
        want |= {(g, k, k, 1.0) for k in kept} | {(g, k, m, close.get((m, k), close.get((k, m)))) for m, k in members.items()}
    edges += [(0, "n0", "elsewhere", 0.9), (1, "n0", "n0", 1.0), (2, "n0", "n1", None)]
    out = graphs.greedy_clusters(spark.createDataFrame(names, "g int, name string, place int"), spark.createDataFrame(edges, "g int, a string, b string, correlation double"), 0.7, ["g"])
    assert {tuple(r) for r in out.select("g", "representative", "member", "correlation").collect()} == want


def test_rounds_grow_with_the_logarithm(spark):
    pick = random.Random(7)
    n = 800
    order = list(range(n))
    pick.shuffle(order)
    place = {x: i for i, x in enumerate(order)}
    thick = {tuple(sorted(pick.sample(range(n), 2))) for _ in range(4 * n)}
    chain = {(i, i + 1) for i in range(n - 1)}
    for close, at in ((thick, place), (chain, {i: i for i in range(n)})):
        report = []
        names = spark.createDataFrame([(str(x), at[x]) for x in range(n)], "name string, place int")
        kept = graphs.kept_names(names, spark.createDataFrame([(str(a), str(b)) for a, b in close], "a string, b string"), report=report)
        want, _ = walk(sorted(range(n), key=at.get), close)
        assert {r["name"] for r in kept.collect()} == set(map(str, want))
        assert len(report) <= 1 + math.log2(n) and report == sorted(report, reverse=True) and report[-1] == 0


def test_no_names_and_no_pairs(spark):
    names, pairs = spark.createDataFrame([("a", 0)], "name string, place int"), spark.createDataFrame([], "a string, b string, correlation double")
    assert [tuple(r) for r in graphs.greedy_clusters(names, pairs, 0.5).collect()] == [("a", "a", 1.0)]
    assert graphs.greedy_clusters(names.limit(0), pairs, 0.5).count() == 0


def plainly(frame, names, most):
    out = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = frame[[a, b]].replace([np.inf, -np.inf], np.nan).dropna()
            step = max(1, len(both) // most)
            both = both.iloc[::step].head(most)
            r = both.rank()
            if len(both) >= 10 and r[a].std() > 0 and r[b].std() > 0:
                out[a, b] = np.corrcoef(r[a], r[b])[0, 1]
    return out


@pytest.mark.parametrize(("most", "block"), [(20_000, 64), (100, 3), (37, 1)])
def test_rank_correlations(spark, most, block):
    pick = np.random.default_rng(2)
    keys = [(f"d{d:02d}", f"c{c:02d}") for d in range(20) for c in range(15)]
    frame = pd.DataFrame(keys, columns=["trade_date", "ts_code"])
    names = [f"x{i}" for i in range(9)] + ["flat", "rare", "void", "odd name"]
    for i, n in enumerate(names):
        x = pick.normal(size=len(frame)).round(1) + (frame["x0"].fillna(0) if 0 < i < 5 else 0)
        x[: 15 * (i % 4)] = np.nan  # a warm-up that some share
        frame[n] = x
    frame["flat"], frame["void"] = 1.0, np.nan
    frame.loc[9:, "rare"] = np.nan
    frame.loc[pick.integers(0, 300, 40), "x7"] = np.nan
    frame.loc[50, "x8"], frame.loc[60, "x8"] = np.inf, -np.inf
    rows = [[None if isinstance(v, float) and np.isnan(v) else v for v in r] for r in frame.astype(object).to_numpy().tolist()]
    wide = spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if i < 2 else 'double'}" for i, c in enumerate(frame.columns))).repartition(5)
    got = {(r["a"], r["b"]): r["correlation"] for r in correlation.rank_correlations(wide, names, most=most, block=block).collect()}
    want = plainly(frame, names, most)
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9)
    assert {k for k, c in want.items() if abs(c) >= 0.5} == {(r["a"], r["b"]) for r in correlation.rank_correlations(wide, names, most=most, block=block, least=0.5).collect()}


def test_five_hundred_columns_in_one_plan(spark):
    names = [f"f{i}" for i in range(500)]
    wide = spark.range(400).selectExpr("cast(id div 20 as string) trade_date", "cast(id % 20 as string) ts_code", *[f"case when id >= {i % 3 * 20} then sin(id * {i % 100 + 1}) end as {n}" for i, n in enumerate(names)])
    out = correlation.rank_correlations(wide, names, least=0.999999)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 400") == 0  # the panel is made once, both scans are behind its checkpoint
    got = {(r["a"], r["b"]) for r in out.collect()}
    assert {("f0", "f300"), ("f0", "f100"), ("f5", "f405")} <= got  # equal but for their first rows
    assert all((int(a[1:]) - int(b[1:])) % 100 == 0 for a, b in got)


def test_only_the_first_of_a_cluster_is_folded(spark):
    """Correlations decide what the account fold gets: a formula's mirror image is a member and has no account."""
    from panelforge.functions import features as feat
    from panelforge.plans import queries, research

    seen, made, fold, compute = [], [], queries.backtest_accounts, feat.compute
    feat.compute = lambda *a: made.append(a) or compute(*a)
    queries.backtest_accounts = lambda spark, sf_dir, formulas=None, *a, **k: seen.append(sorted(formulas)) or fold(spark, sf_dir, formulas, *a, **k)
    try:
        out = research.research_pipeline(spark, "/root/testdata/sf0.001", {"against": "NEG(RET5)", "momentum": "RET5", "low_vol": "NEG(RET_STD20)", "empty": "DIV(RET1,SUB(RET5,RET5))"})
        rows = {r["formula"]: r for r in out.collect()}
    finally:
        queries.backtest_accounts, feat.compute = fold, compute
    assert seen == [["low_vol", "momentum"]] and len(made) == 1  # features are made once for all stages
    a, m, e = rows["against"], rows["momentum"], rows["empty"]
    assert (a["pipeline_status"], a["representative"], a["closest"], a["closest_correlation"], a["total_return"], a["trade_count"], a["grade"]) == ("deduplicated_by_correlation", "momentum", "momentum", -1.0, None, None, "Rejected")
    assert m["pipeline_status"] == "selected_for_full_backtest" and m["representative"] == "momentum" and m["total_return"] is not None and abs(rows["low_vol"]["closest_correlation"]) < 0.95
    assert e["pipeline_status"] == "rejected" and e["representative"] is None and e["closest"] is None
    assert [r["formula"] for r in research.research_pipeline(spark, "/root/testdata/sf0.001", {"empty": "DIV(RET1,SUB(RET5,RET5))"}).collect()] == ["empty"]
