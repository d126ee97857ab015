"""Queries over finds, candidates, schedules and windows; their SQL is in :mod:`panelforge.plans.research_sql`."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from panelforge.functions import features as feat
from panelforge.functions.formula import columns, parse
from panelforge.lineage import checkpointed, shared_folder
from panelforge.operators import backtest, correlation, crosssec, graphs, joins, research, rules, stats, tables
from panelforge.plans import queries as q
from panelforge.schema import KEY
from panelforge.sources import bars as src, candidates as made

GENERATORS = ["policy", "uniform"]
#: The weekly composite: percentiles of these are averaged.
COMPOSITE = ("NEG(RET_STD20)", "NEG(RET5)", "RET60", "TREND20", "VOL_RATIO20")
THROUGH = "20240120"


def _bars(spark, sf_dir):
    return src.bars(spark, sf_dir)


def reward_verdict(spark, sf_dir):
    return research.reward_verdict(made.candidates(spark, sf_dir), 5).select("formula_hash", "reward", "validity_status", "failure_reason")


def sortino_diagnosis(spark, sf_dir):
    return research.sortino_diagnosis(made.candidates(spark, sf_dir)).select("formula_hash", "sortino_status", "sortino_reason")


def _graded(spark, sf_dir):
    return research.segment_grade(research.grade(research.robustness(made.candidates(spark, sf_dir))))


def robust_grade(spark, sf_dir):
    return _graded(spark, sf_dir).select("formula_hash", "positive_period_ratio", "robustness_status", "grade")


def segment_grade(spark, sf_dir):
    return _graded(spark, sf_dir).select("formula_hash", "final_grade", F.array_join("reasons", ";").alias("reasons"), F.array_join("missing", ";").alias("missing"))


def candidate_order(spark, sf_dir):
    return research.within_budget(made.candidates(spark, sf_dir), 500).select("place", "formula_hash", "rank_ic_mean", "coverage", "formula_text")


def pipeline_status(spark, sf_dir):
    screened = made.candidates(spark, sf_dir)
    chosen = research.within_budget(screened.filter("fast_screen_status = 'passed'"), 400)
    # a cluster here: formulas of one rank IC; the first in order stands for it
    ranked = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("rank_ic_mean").orderBy("place")))
    kept = ranked.filter("nth = 1").withColumn("p", F.row_number().over(Window.orderBy("place")))  # 400 rows at most
    out = research.pipeline_status(screened, chosen, ranked.filter("nth > 1"), kept.filter("p <= 50"), kept.filter("p > 50"))
    return out.select("formula_hash", "pipeline_status", F.array_join("status_history", ">").alias("status_history"), "budget_excluded", "rejected")


def run_diagnostics(spark, sf_dir):
    reward = reward_verdict(spark, sf_dir).select("formula_hash", "failure_reason")
    out = pipeline_status(spark, sf_dir).join(robust_grade(spark, sf_dir), "formula_hash").join(reward, "formula_hash", "left")
    return out.groupBy("pipeline_status", "grade", F.coalesce("failure_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def bounded_pool(spark, sf_dir):
    return research.bounded_pool(made.finds(spark, sf_dir), 200).select("place", "formula_hash", "train_reward", "discovery_order")


def shortlist(spark, sf_dir):
    return research.shortlist(made.candidates(spark, sf_dir), 30).select("place", "formula_hash", "validation_sortino", "train_sortino")


def decay_signs(spark, sf_dir):
    return q._rounded(research.decay(made.candidates(spark, sf_dir)).select("formula_hash", "train_validation_decay", "positive_sign_preserved"), ["train_validation_decay"], 6)


def view_statistics(spark, sf_dir):
    views = research.views(made.finds(spark, sf_dir), GENERATORS)
    out = research.view_statistics(made.candidates(spark, sf_dir).join(views, "formula_hash"), "view")
    return q._rounded(out, [c for c, t in out.dtypes if t == "double"], 6)


def formula_views(spark, sf_dir):
    return research.views(made.finds(spark, sf_dir), GENERATORS)


def keep_best_sets(spark, sf_dir):
    out = research.keep_best(made.finds(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("formula_hash", "generator", "best_source_seed", "train_reward", text("source_seeds").alias("source_seeds"), F.array_join("source_generators", ",").alias("source_generators"),
                      text(F.transform("discoveries", lambda d: d["discovery_order"])).alias("orders"))


def searchers_compared(spark, sf_dir):
    return research.searchers_compared(made.finds(spark, sf_dir), GENERATORS)


def search_summary(spark, sf_dir):
    return q._rounded(research.search_summary(made.finds(spark, sf_dir), "generator", "seed"), ["median", "top_10_mean"], 6)


def freeze_candidates(spark, sf_dir):
    return research.freeze(made.finds(spark, sf_dir), 20)


def merge_first_wins(spark, sf_dir):
    f = made.finds(spark, sf_dir)
    order = [F.when(F.col("generator") == "policy", 0).otherwise(1), "discovery_order"]
    return tables.first_of(f, ["formula_hash"], order).select("formula_hash", "generator", "seed", "discovery_order")


def labelled_formulas(spark, sf_dir):
    labels = [("RET1", "[r1]"), ("RET120", "[r120]"), ("NEG", "minus"), ("VOL_RATIO20", "[volume]")]
    return made.finds(spark, sf_dir).select("discovery_order", "formula_text", research.relabelled(F.col("formula_text"), labels).alias("label"))


def scan_window(spark, sf_dir):
    b = src.scan_bars(_bars(spark, sf_dir), "19950101", "19961231", None, ["raw_open", "raw_close", "pre_close"])
    return b.join(src.limits(b), ["trade_date", "ts_code"])


def symbols_lookup(spark, sf_dir):
    """Closes of the watchlist's names on the watchlist's day: an IN-list as a broadcast semi-join."""
    names = q.observation_watchlist(spark, sf_dir).select("ts_code")
    return _bars(spark, sf_dir).select("trade_date", "ts_code", "raw_close").join(F.broadcast(names), "ts_code", "left_semi")  # 20 names


def interval_semi(spark, sf_dir):
    """Any period that holds the date counts, whatever its flag."""
    p = src.st_periods(spark, sf_dir).select(F.col("ts_code").alias("code"), "start_date", "end_date")
    b = _bars(spark, sf_dir).select("trade_date", "ts_code")
    return b.join(p, (F.col("ts_code") == F.col("code")) & F.col("trade_date").between(F.col("start_date"), F.col("end_date")), "left_semi")


def interval_overlap(spark, sf_dir):
    return src.st_periods(spark, sf_dir).filter((F.col("start_date") <= "19951231") & (F.col("end_date") >= "19950701"))


def next_weekly_signal(spark, sf_dir):
    return research.next_weekly_signals(src.calendar(_bars(spark, sf_dir)))


def warm_up_days(spark, sf_dir):
    return research.days_back(src.calendar(_bars(spark, sf_dir)), 120)


def warm_up_context(spark, sf_dir):
    """Bars from 120 open days before a segment to its end; ``inside`` marks the segment."""
    b, start, end = _bars(spark, sf_dir), "19950101", "19951231"
    days = src.calendar(b).filter(F.col("trade_date") < start).orderBy(F.desc("trade_date")).limit(120).agg(F.min("trade_date").alias("warm"))
    out = b.filter(F.col("trade_date") <= end).join(F.broadcast(days), (F.col("trade_date") >= F.coalesce("warm", F.lit(start))))
    return out.groupBy("trade_date").agg(F.count("*").alias("n"), F.max(F.col("trade_date") >= start).alias("inside"))


def range_return(spark, sf_dir):
    return q._rounded(research.range_return(_bars(spark, sf_dir)), ["range_return"])


def quintile_spread(spark, sf_dir):
    s = q._scored(spark, sf_dir).filter("factor_value is not null and forward_return is not null")
    s = s.withColumn("quintile", F.ntile(5).over(Window.partitionBy("formula", "trade_date").orderBy("factor_value", "ts_code")))
    m = s.groupBy("formula", "quintile").agg(F.avg("forward_return").alias("m"), F.count("*").alias("n"))
    wide = m.groupBy("formula").agg(F.sum("n").alias("n"), (F.max(F.when(F.col("quintile") == 5, F.col("m"))) - F.max(F.when(F.col("quintile") == 1, F.col("m")))).alias("spread"))
    return q._rounded(wide, ["spread"])


def _targets(spark, sf_dir, b=None):
    """Every week the five best names by the mean percentile, a fifth each, from the next week's first day to that after."""
    b = b or _bars(spark, sf_dir)
    names = [f"f{i}" for i in range(len(COMPOSITE))]
    df = columns(feat.compute(b, feat.NAMES), {n: parse(t) for n, t in zip(names, COMPOSITE, strict=True)})
    df = df.join(F.broadcast(rules.weekly_schedule(src.calendar(b))), F.col("trade_date") == F.col("signal_date"))  # one row a week
    df = q._rounded(df.select("trade_date", "ts_code", "entry_date", "exit_date", *names), names).dropna(subset=names)
    score = F.round(sum(crosssec.percentile_of(n, "trade_date") for n in names) / len(names), 10)
    best = crosssec.top(df.withColumn("score", score), "score", 5)
    return best.select(F.lit("composite").alias("plan"), F.concat_ws(":", "trade_date", "ts_code").alias("window_id"), F.col("trade_date").alias("signal_date"), "entry_date", "exit_date", "ts_code", F.lit(0.2).alias("weight"), "rank", "score")


def weekly_targets(spark, sf_dir):
    return q._rounded(_targets(spark, sf_dir).drop("plan"), ["score"], 6)


def signal_snapshots(spark, sf_dir):
    t = _targets(spark, sf_dir).groupBy("signal_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ts_code"))), lambda x: x["ts_code"]), ",").alias("codes"))  # five names
    return t.select("signal_date", "codes", F.sha2(F.to_json(F.struct("codes", "signal_date")), 256).alias("snapshot_sha256"))


def schedule_violations(spark, sf_dir):
    return research.out_of_order(rules.weekly_schedule(src.calendar(_bars(spark, sf_dir))), ["signal_date", "entry_date", "exit_date"])


def external_windows(spark, sf_dir):
    b = checkpointed(_bars(spark, sf_dir))
    return backtest.external_windows(_targets(spark, sf_dir, b).select("plan", "window_id", "entry_date", "exit_date", "ts_code", "weight"), q._market(spark, sf_dir, b), src.calendar(b))


def window_status(spark, sf_dir):
    """Orders as target windows, their lines as trades: odd ones entries, even ones exits; of lines with one number and part the first in the table counts."""
    line = src.placed(src.table(spark, sf_dir, "lineitem"))
    trades = line.select(
        F.col("l_orderkey").alias("window_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"), F.when(F.col("l_linenumber") % 2 == 1, "entry").when(F.col("l_linenumber").isNotNull(), "exit").alias("purpose"),
        F.when(F.col("l_returnflag") == "R", "unfilled").when(F.col("l_returnflag").isNotNull(), "filled").alias("status"), F.date_format("l_shipdate", "yyyyMMdd").alias("reason"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("double").alias("notional"),
        F.round(F.col("l_tax") * 100).cast("long").cast("double").alias("cost"), F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"), "place")
    out = research.window_status(src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("window_id")), trades)
    return q._rounded(out, ["net_return"])


def window_status_summary(spark, sf_dir):
    return stats.window_summary(window_status(spark, sf_dir), F.substring("actual_exit_date", 1, 4).alias("y")).select("y", "target_window_count", "completed_window_count", "entry_unfilled_count", "incomplete_exit_count", "missing_status_count", "delayed_exit_count", "positive_count", "negative_count")


def due_events(spark, sf_dir):
    """Each week's signal, looked at from one of five days around it, with data up to one of three."""
    s = rules.weekly_schedule(src.calendar(_bars(spark, sf_dir)))
    w = Window.orderBy("signal_date")  # one row a week
    s = s.withColumn("i", F.row_number().over(w))
    today = F.when(F.col("i") % 5 == 0, F.lag("signal_date").over(w)).when(F.col("i") % 5 == 1, F.col("entry_date")).otherwise(F.col("signal_date"))
    ready = F.when(F.col("i") % 7 == 0, None).when(F.col("i") % 3 == 0, F.lag("signal_date").over(w)).otherwise(F.col("signal_date"))
    return s.withColumns({"today": today, "ready": ready}).select("signal_date", rules.due(F.col("signal_date"), F.col("i") % 11 == 0, F.col("today"), F.col("ready")).alias("reason"))


def forward_tick(spark, sf_dir):
    """The log holds clicks; a tick with data up to a day adds what has arrived by then and leaves later events out."""
    from panelforge.streaming.forward import tick

    e = src.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyyMMdd").alias("trade_date"), F.sha2("props", 256).alias("payload"), "event_type")
    return tick(e.filter("event_type = 'click'"), e, THROUGH)


def active_records(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return tables.active_records(e, e.filter("event_type = 'error'"), "event_id")


def resume_tasks(spark, sf_dir):
    """Orders as tasks of a run, of which finished ones are completed."""
    o = src.table(spark, sf_dir, "orders")
    progress = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "interrupted").otherwise("pending").alias("status"))
    return tables.remaining(o.select("o_orderkey", "o_custkey"), progress, "o_orderkey")


def json_flatten(spark, sf_dir):
    """Events as JSON responses of five shapes, flattened to a queue without repeats."""
    e = src.table(spark, sf_dir, "events")
    item = lambda url, body: F.to_json(F.struct(url.alias("url"), F.col("event_type").alias("title"), F.get_json_object("props", "$.k").alias(body)))
    one, two = item(F.concat(F.lit("u"), F.col("user_id")), "markdown"), item(F.concat(F.lit("e"), F.col("event_id")), "content")
    both = F.concat(F.lit("["), one, F.lit(","), two, F.lit("]"))
    shape = F.col("event_id") % 5
    inside = F.concat(F.lit('{"'), F.when(shape == 0, "data").when(shape == 1, "results").otherwise("items"), F.lit('":'), both, F.lit("}"))
    raw = e.select(F.when(shape == 3, both).when(shape == 4, one).otherwise(inside).alias("response"))
    out = research.flatten_items(raw)
    return out.withColumn("record_id", tables.stable_id("review", F.col("url"), F.col("title"), tables.snippet(F.col("text"), 400))).dropDuplicates(["record_id"])


def text_snippets(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", tables.snippet(F.col("text"), 360).alias("snippet"))


def source_match(spark, sf_dir):
    wanted = ["STEEL", "BRASS", "COPPER", "ANODIZED"]
    hit = tables.listed(F.replace(F.upper("p_type"), F.lit(" "), F.lit(" ; ")), wanted)
    return src.table(spark, sf_dir, "part").select("p_partkey", F.array_join(hit, ";").alias("matched"), F.when(F.size(hit) > 0, "verified").otherwise("unverified").alias("verification"))


def curation_counts(spark, sf_dir):
    full = lambda *c: sum((F.trim(F.coalesce(F.col(x), F.lit(""))) != "").cast("int") for x in c) == len(c)
    p = src.table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(full("p_name", "p_brand", "p_type")).alias("complete"), F.count_if(full("p_name", "p_brand", "p_type") & F.col("p_size").isin(1, 2, 3, 5, 8, 13)).alias("accepted"))


def preferred_sources(spark, sf_dir):
    n = src.table(spark, sf_dir, "nation")
    return research.preferred_first(n.select("n_name", "n_nationkey"), "n_name", "n_nationkey", ["JAPAN", "CANADA", "NOWHERE", "BRAZIL"], 10)


def json_row_hash(spark, sf_dir):
    return src.table(spark, sf_dir, "orders").select("o_orderkey", research.json_hash("o_custkey", "o_orderkey", "o_orderstatus").alias("sha256"))


def metrics_of_accounts(spark, sf_dir):
    """Metrics of a given account path: a unit of every code's first bar, held; every fifth day pays."""
    b = _bars(spark, sf_dir)
    a = b.groupBy("trade_date").agg(F.round(F.avg("raw_close"), 6).alias("total_equity"), F.count("*").alias("c"))
    w = Window.orderBy("trade_date")  # a few thousand days
    a = a.withColumns({"formula": F.lit("held"), "net_return": F.round(F.coalesce(F.col("total_equity") / F.lag("total_equity").over(w) - 1, F.lit(0.0)), 8)})
    a = a.withColumns({"gross_return": F.col("net_return"), "cash": F.round(F.col("total_equity") / 4, 6), "turnover": F.col("c") / 1000.0, "cumulative_cost": F.row_number().over(w) / 100.0})
    t = src.table(spark, sf_dir, "lineitem").select(F.lit("held").alias("formula"), F.when(F.col("l_linenumber") % 2 == 1, "buy").otherwise("sell").alias("side"), F.when(F.col("l_returnflag") == "R", "unfilled").otherwise("filled").alias("status"))
    out = stats.account_metrics(a, t)
    return q._rounded(out, [c for c, k in out.dtypes if k == "double"], 5)


def cost_levels(spark, sf_dir):
    """The account fold at three costs as one plan, one row a formula."""
    out = q.backtest_accounts(spark, sf_dir, {"low_vol": "NEG(RET_STD20)"}, (10.0, 20.0, 40.0)).filter("kind = 'account'")
    last = out.groupBy(F.substring_index("formula", "@", 1).alias("formula"), F.substring_index("formula", "@", -1).cast("int").alias("bps")).agg(F.max_by("total_equity", "trade_date").alias("e"))
    return last.groupBy("formula").pivot("bps", [10, 20, 40]).agg(F.round(F.first("e"), 2))


def split_funnel(spark, sf_dir):
    """Formulas are ranked by their training segment's rank IC, the best go to validation, the best of these to the blind one."""
    split = F.when(F.col("trade_date") < "19950101", "train").when(F.col("trade_date") < "19980101", "validation").otherwise("blind")
    days = crosssec.by_date(q._scored(spark, sf_dir)).withColumn("split", split)
    ic = days.groupBy("formula").pivot("split", ["train", "validation", "blind"]).agg(F.round(F.avg("ic"), 6))
    by = lambda c: F.row_number().over(Window.orderBy(F.desc(F.abs(F.coalesce(c, F.lit(0.0)))), "formula"))  # noqa: E731  one row a formula
    ic = ic.withColumn("train_place", by("train")).withColumn("validation", F.when(F.col("train_place") <= 3, F.col("validation")))
    ic = ic.withColumn("validation_place", F.when(F.col("train_place") <= 3, by("validation").cast("double")))
    return ic.select("formula", "train", "train_place", "validation", "validation_place", F.when(F.col("validation_place") <= 2, F.col("blind")).alias("blind"))


def research_pipeline(spark, sf_dir, formulas=None):
    """Screen, order, correlation clusters, account fold, robustness and grade; each stage works on what the one before left.

    Clusters are those of the chosen formulas, in the candidate order; only the first of each is
    folded. A chosen formula has its ``representative`` and the other one that it is ``closest`` to.
    Forward returns and all formulas' values are made with the bars, in one shuffle of the lines, and
    written once, as columns: rounded for the screen and the correlations, exact for the fold.
    """
    text = formulas or q.SCREENED
    b = columns(feat.compute(crosssec.forward_return(_bars(spark, sf_dir).select(*src.FOLDED), 5), feat.NAMES), {k: parse(t) for k, t in text.items()})
    b = b.select(*KEY, "raw_open", "raw_close", "pre_close", "forward_return", *text, *[F.col(n).alias(f"{n}_exact") for n in text])
    folder = f"{shared_folder(spark)}/research-panel-{uuid.uuid4().hex}"
    q._rounded(b, [*text, "forward_return"]).write.parquet(folder)
    b = spark.read.parquet(folder)
    exact = b.select(*KEY, *[F.col(f"{n}_exact").alias(n) for n in text])
    days = crosssec.by_date_wide(b, list(text))
    fast = crosssec.screened(days).withColumn("formula_text", F.create_map(*[F.lit(x) for kv in text.items() for x in kv])[F.col("formula")])
    fast = checkpointed(fast.withColumn("formula_hash", F.sha2("formula_text", 256)))
    chosen = checkpointed(research.within_budget(fast.filter("fast_screen_status = 'passed'"), 100))
    names = [r["formula"] for r in chosen.orderBy("place").collect()]  # a budget's worth
    pairs = checkpointed(correlation.rank_correlations(b, names, written=True))
    clusters = checkpointed(graphs.greedy_clusters(q.in_order(spark, names), pairs, 0.95).select(F.col("member").alias("formula"), "representative"))
    members = clusters.filter("representative <> formula").select("formula")
    both = pairs.select(F.col("a").alias("formula"), F.col("b").alias("other"), "correlation").unionByName(pairs.select(F.col("b").alias("formula"), F.col("a").alias("other"), "correlation"))
    closest = both.groupBy("formula").agg(F.max_by(F.struct("other", "correlation"), F.struct(F.abs("correlation"), "other")).alias("c")).select("formula", F.col("c.other").alias("closest"), F.col("c.correlation").alias("closest_correlation"))
    kept = chosen.join(members, "formula", "left_anti")
    tested = checkpointed(research.within_budget(kept.drop("place"), 50))
    state = research.pipeline_status(fast, chosen, chosen.join(members, "formula", "left_semi"), tested, kept.join(tested.select("formula"), "formula", "left_anti"))
    folded = {r["formula"]: text[r["formula"]] for r in tested.select("formula").collect()}  # a budget's worth
    metrics = q.backtest_metrics(spark, sf_dir, b, folded, exact) if folded else spark.createDataFrame([], "formula string, status string, total_return double, max_drawdown double, sortino double, trade_count long")
    metrics = metrics.withColumn("full_backtest_status", F.when(F.col("status") == "ok", "passed").otherwise("failed"))
    judged = state.join(metrics.select("formula", "full_backtest_status", "total_return", "max_drawdown", "sortino", "trade_count", F.col("status").alias("account_status")), "formula", "left")
    graded = research.grade(research.robustness(judged)).join(clusters, "formula", "left").join(closest, "formula", "left")
    out = graded.select("formula", "formula_hash", "fast_screen_status", "pipeline_status", F.array_join("status_history", ">").alias("status_history"), "rank_ic_mean", "coverage", "total_return", "max_drawdown", "sortino", "trade_count", "robustness_status", "grade", "representative", "closest", "closest_correlation")
    return q._rounded(out, ["rank_ic_mean", "coverage", "total_return", "max_drawdown", "sortino", "closest_correlation"], 6)


NAMES = (
    "reward_verdict sortino_diagnosis robust_grade segment_grade candidate_order pipeline_status run_diagnostics bounded_pool shortlist decay_signs view_statistics formula_views keep_best_sets searchers_compared "
    "search_summary freeze_candidates merge_first_wins labelled_formulas scan_window symbols_lookup interval_semi interval_overlap next_weekly_signal warm_up_days warm_up_context range_return quintile_spread weekly_targets "
    "signal_snapshots schedule_violations external_windows window_status window_status_summary due_events forward_tick active_records resume_tasks json_flatten text_snippets source_match curation_counts preferred_sources "
    "json_row_hash metrics_of_accounts cost_levels split_funnel research_pipeline"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
