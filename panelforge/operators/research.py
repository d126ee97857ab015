"""Judging and choosing formulas: verdicts, total orders, bounded pools, views, search statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Thresholds of grades and the reward of what can't be judged.
A_IC, A_DRAWDOWN, B_IC, LEAST_POSITIVE, NO_REWARD = 0.03, 0.35, 0.015, 0.45, -1.0


def reward_verdict(rows: DataFrame, least_trades: int) -> DataFrame:
    """``reward``, ``validity_status`` and ``failure_reason`` from status, trade_count and sortino."""
    why = F.when(F.col("status") == "insufficient_data", "insufficient_data").when(F.coalesce("trade_count", F.lit(0)) < least_trades, "insufficient_trade_count").when(F.col("sortino").isNull(), "sortino_unavailable")
    return rows.withColumns({"reward": F.when(why.isNull(), F.col("sortino")).otherwise(NO_REWARD), "validity_status": F.when(why.isNull(), "valid").otherwise("failed"), "failure_reason": why})


def sortino_diagnosis(rows: DataFrame) -> DataFrame:
    """Whether there is a Sortino ratio, and the first reason why not."""
    why = (
        F.when(F.col("sortino").isNotNull(), F.lit(None).cast("string")).when(F.col("daily_count") == 0, "returns_sequence_empty").when(F.col("negative_count") == 0, "no_negative_return_observation")
        .when(F.coalesce("trade_count", F.lit(0)) == 0, "trade_count_zero").otherwise(F.coalesce("status", F.lit("downside_deviation_zero_or_unavailable"))))
    return rows.withColumns({"sortino_status": F.when(F.col("sortino").isNull(), "unavailable").otherwise("available"), "sortino_reason": why})


def robustness(rows: DataFrame, least_positive: float = LEAST_POSITIVE) -> DataFrame:
    """``positive_period_ratio`` (1 for a positive total return, else 0) and ``robustness_status``."""
    ratio = F.when(F.col("total_return") > 0, 1.0).otherwise(0.0)
    return rows.withColumns({"positive_period_ratio": ratio, "robustness_status": F.when((F.col("full_backtest_status") == "passed") & (ratio >= least_positive), "passed").otherwise("rejected")})


def grade(rows: DataFrame) -> DataFrame:
    """A, B, C or Rejected, from the judged backtest, its robustness and the rank IC."""
    size = lambda c: F.abs(F.coalesce(F.col(c), F.lit(0.0)))
    passed = (F.col("full_backtest_status") == "passed") & (F.col("robustness_status") == "passed") & (F.coalesce("total_return", F.lit(0.0)) > 0)
    return rows.withColumn("grade", F.when(~passed, "Rejected").when((size("rank_ic_mean") >= A_IC) & (size("max_drawdown") <= A_DRAWDOWN), "A").when(size("rank_ic_mean") >= B_IC, "B").otherwise("C"))


def segment_grade(rows: DataFrame, least_ic: float = B_IC) -> DataFrame:
    """The grade over a selection and a stability segment, with all ``reasons`` and what is ``missing`` (arrays)."""
    needed = [(s, m) for s in ("selection", "stability") for m in ("trade_win_rate", "profit_loss_ratio")]
    absent = lambda label: F.array_compact(F.array(*[F.when(F.col(f"{s}_{m}").isNull(), F.lit(label(s, m))) for s, m in needed]))
    rows = rows.withColumns({"missing": absent(lambda s, m: m), "absent": absent(lambda s, m: f"{s}_{m}_missing")})
    robust, complete = F.col("robustness_status") == "passed", F.size("missing") == 0
    step = (
        F.when(F.col("fast_screen_status") != "passed", F.struct(F.when(complete & robust, "C").otherwise("Rejected").alias("g"), F.lit("fast_screen_not_passed").alias("why")))
        .when(~complete, F.struct(F.lit("Rejected").alias("g"), F.lit(None).cast("string").alias("why"))).when(~robust, F.struct(F.lit("Rejected").alias("g"), F.lit("robustness_not_passed").alias("why")))
        .when(F.coalesce("stability_total_return", F.lit(0.0)) <= 0, F.struct(F.lit("C").alias("g"), F.lit("stability_total_return_non_positive").alias("why")))
        .when((F.abs(F.coalesce("rank_ic_mean", F.lit(0.0))) >= least_ic) & (F.abs(F.coalesce("stability_rank_ic_mean", F.lit(0.0))) >= least_ic), F.struct(F.lit("B").alias("g"), F.lit(None).cast("string").alias("why")))
        .otherwise(F.struct(F.lit("C").alias("g"), F.lit(None).cast("string").alias("why"))))
    rows = rows.withColumn("step", step)
    return rows.withColumns({"final_grade": F.col("step.g"), "reasons": F.array_compact(F.concat("absent", F.array("step.why")))}).drop("absent", "step")


def candidate_order() -> list[Column]:
    """Largest absolute IC first, then coverage, the shorter formula, the hash: a total order."""
    return [F.desc(F.abs(F.coalesce("rank_ic_mean", F.lit(0.0)))), F.desc(F.coalesce("coverage", F.lit(0.0))), F.char_length("formula_text"), F.col("formula_hash")]


def within_budget(rows: DataFrame, budget: int, place: str = "place") -> DataFrame:
    """The first ``budget`` rows of the candidate order, with their ``place``; a limit, not a sort of everything in one task."""
    few = rows.orderBy(*candidate_order()).limit(budget)
    return few.withColumn(place, F.row_number().over(Window.orderBy(*candidate_order())))


def pipeline_status(screened: DataFrame, correlated: DataFrame, members: DataFrame, tested: DataFrame, untested: DataFrame) -> DataFrame:
    """Where each screened formula ended: ``pipeline_status``, ``status_history`` (array), ``budget_excluded``, ``rejected``.

    The other frames hold ``formula_hash``: chosen for correlation, members of another's cluster,
    chosen for the full backtest, and left out of it by its budget.
    """
    out = screened
    for name, df in (("_c", correlated), ("_m", members), ("_t", tested), ("_u", untested)):
        out = out.join(df.select("formula_hash").distinct().withColumn(name, F.lit(True)), "formula_hash", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    passed = F.col("fast_screen_status") == "passed"
    last = F.when(~F.col("_c"), "excluded_by_correlation_budget").when(F.col("_m"), "deduplicated_by_correlation").when(F.col("_t"), "selected_for_full_backtest").when(F.col("_u"), "excluded_by_full_backtest_budget")
    history = F.array_compact(F.array(F.when(passed & F.col("_c"), F.lit("selected_for_correlation")), F.when(passed, last)))
    status = F.when(~passed, F.col("fast_screen_status")).otherwise(F.coalesce(last, F.lit("selected_for_correlation")))
    out = out.withColumns({"pipeline_status": F.coalesce(status, F.lit("unknown")), "status_history": history, "rejected": ~F.coalesce(passed, F.lit(False))})
    return out.withColumn("budget_excluded", F.col("pipeline_status").isin("excluded_by_correlation_budget", "excluded_by_full_backtest_budget")).drop("_c", "_m", "_t", "_u")


def best_first(reward: str) -> list[Column]:
    """Largest reward first, null last, then the hash."""
    return [F.desc_nulls_last(reward), F.col("formula_hash")]


def bounded_pool(rows: DataFrame, capacity: int, seen: str = "discovery_order", reward: str = "train_reward") -> DataFrame:
    """Of each formula the first find; of these the ``capacity`` best.

    The pool that is trimmed after every find holds the same: a formula once trimmed ranks behind
    ``capacity`` others for good.
    """
    first = rows.groupBy("formula_hash").agg(F.min_by(F.struct(reward, seen), seen).alias("f")).select("formula_hash", "f.*")
    return first.orderBy(*best_first(reward)).limit(capacity).withColumn("place", F.row_number().over(Window.orderBy(*best_first(reward))))


def shortlist(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` validated formulas with the largest positive validation Sortino; ties by the training one (null last), then the hash."""
    order = [F.desc("validation_sortino"), F.desc_nulls_last("train_sortino"), F.col("formula_hash")]
    few = rows.filter("validation_status = 'completed' and validation_sortino > 0").orderBy(*order).limit(n)
    return few.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def shortlist_id(chosen: DataFrame) -> DataFrame:
    """A hash of the shortlist in order, and its length."""
    item = F.to_json(F.struct("formula_hash", "validation_sortino", "train_sortino"))
    return chosen.agg(F.count("*").alias("n"), F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("j")))), lambda x: x["j"]), ","), 256), 1, 16).alias("shortlist_id"))  # n rows


def decay(rows: DataFrame) -> DataFrame:
    """What validation lost against training, and whether a positive sign held."""
    return rows.withColumns({"train_validation_decay": F.col("train_sortino") - F.col("validation_sortino"), "positive_sign_preserved": F.coalesce((F.col("train_sortino") > 0) & (F.col("validation_sortino") > 0), F.lit(False))})


def view_statistics(rows: DataFrame, *by: str) -> DataFrame:
    """Per view: counts, the validation Sortino's distribution, the best tenth's mean, decay, signs kept and ranks retained.

    Retention: of the best fifth by training, the share that is in the best fifth by validation.
    """
    v, t, view = F.col("validation_sortino"), F.col("train_sortino"), list(by)
    both = v.isNotNull() & t.isNotNull()
    w = Window.partitionBy(*view)
    has = Window.partitionBy(*view, both.alias("has"))
    rows = rows.withColumns({
        "_v": F.row_number().over(w.orderBy(F.desc_nulls_last("validation_sortino"), "formula_hash")), "_n": F.count(v).over(w), "_b": both,
        "_tr": F.row_number().over(has.orderBy(F.desc("train_sortino"), F.desc("formula_hash"))), "_vr": F.row_number().over(has.orderBy(F.desc("validation_sortino"), F.desc("formula_hash"))), "_k": F.greatest(F.lit(1), F.ceil(F.count(F.when(both, 1)).over(w) * 0.2))})
    top = v.isNotNull() & (F.col("_v") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    out = rows.groupBy(*view).agg(
        F.count("*").alias("candidate_count"), F.count_if(F.col("validation_status") == "completed").alias("completed_count"), F.median(v).alias("validation_median"), F.avg(v).alias("validation_mean"), F.avg(F.when(top, v)).alias("validation_top_10_mean"),
        F.avg(F.when(v.isNotNull(), (v > 0).cast("int"))).alias("validation_positive_ratio"), F.max(v).alias("validation_best"), F.min(v).alias("validation_worst"), F.stddev_pop(v).alias("validation_std"), F.avg(t - v).alias("decay"),
        F.try_divide(F.count_if(both & (t > 0) & (v > 0)), F.nullif(F.count_if(both & (t > 0)), F.lit(0))).alias("sign_preservation"),
        (F.count_if(F.col("_b") & (F.col("_tr") <= F.col("_k")) & (F.col("_vr") <= F.col("_k"))) / F.max("_k")).alias("rank_retention"), F.count_if("_b").alias("_pairs"))
    return out.withColumn("rank_retention", F.when(F.col("_pairs") >= 2, F.col("rank_retention"))).drop("_pairs")


def keep_best(rows: DataFrame) -> DataFrame:
    """Per formula: its best find, all seeds and generators (sorted), and its finds in order of seed."""
    order = F.struct(F.coalesce("train_reward", F.lit(-1e99)).alias("r"), (-F.col("discovery_order")).alias("d"))
    trail = F.array_sort(F.collect_list(F.struct("seed", "discovery_order", "train_reward")))  # a formula's own finds
    return rows.groupBy("formula_hash").agg(
        F.max_by("generator", order).alias("generator"), F.max_by("seed", order).alias("best_source_seed"), F.max("train_reward").alias("train_reward"), F.sort_array(F.collect_set("seed")).alias("source_seeds"),
        F.sort_array(F.collect_set("generator")).alias("source_generators"), trail.alias("discoveries"))


def searchers_compared(rows: DataFrame, generators: list[str]) -> DataFrame:
    """Per seed the best reward of each generator and the winner; ``majority`` names who won more seeds, or ``inconclusive``."""
    out = rows.groupBy("seed").pivot("generator", generators).agg(F.max("train_reward"))
    a, b = (F.coalesce(F.col(g), F.lit(-1e99)) for g in generators)
    out = out.withColumn("winner", F.when(a > b, generators[0]).when(b > a, generators[1]).otherwise("tie"))
    w = Window.partitionBy()  # one row a seed
    wins = [F.count_if(F.col("winner") == g).over(w) for g in generators]
    return out.withColumn("majority", F.when(wins[0] > wins[1], generators[0]).when(wins[1] > wins[0], generators[1]).otherwise("inconclusive"))


def search_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Per search: attempts, formulas, valid finds, best and median reward, the best tenth's mean, when the first positive and the best were met."""
    w = Window.partitionBy(*by)
    r = F.col("train_reward")
    rows = rows.withColumns({"_p": F.row_number().over(w.orderBy(F.desc_nulls_last("train_reward"), "discovery_order")), "_n": F.count("train_reward").over(w)})
    top = r.isNotNull() & (F.col("_p") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    return rows.groupBy(*by).agg(
        F.count("*").alias("attempts"), F.count_distinct("formula_hash").alias("unique_formulas"), F.count(r).alias("valid"), F.max(r).alias("best"), F.median(r).alias("median"), F.avg(F.when(top, r)).alias("top_10_mean"),
        F.min(F.when(r > 0, F.col("discovery_order"))).alias("first_positive"), F.min(F.when(F.col("_p") == 1, F.col("discovery_order"))).alias("best_at"))


def views(rows: DataFrame, generators: list[str]) -> DataFrame:
    """Each formula once, by who found it: one generator only, or both."""
    found = rows.groupBy("formula_hash").agg(F.collect_set("generator").alias("g"))
    return found.select("formula_hash", F.when(F.size("g") > 1, "overlap").otherwise(F.concat(F.col("g")[0], F.lit("_only"))).alias("view"))


def freeze(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` best formulas of each generator, with their place and whether the other froze them too."""
    best = rows.groupBy("generator", "formula_hash").agg(F.max("train_reward").alias("train_reward")).filter("train_reward is not null")
    w = Window.partitionBy("generator").orderBy(*best_first("train_reward"))
    chosen = best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return chosen.withColumn("overlap", F.count("*").over(Window.partitionBy("formula_hash")) > 1)


def window_status(targets: DataFrame, trades: DataFrame) -> DataFrame:
    """What became of each target window (``window_id``), from its trades: window_id, seq, purpose, status, reason, notional, cost, trade_date.

    The first entry and the last exit count. Of trades with one ``seq`` it is the first by ``place``,
    a number, if there is such a column, and then by the columns, so that no tie is left open.
    Trades without a ``seq`` are counted, but none is first or last; those without a purpose or a
    status don't count, and a reason that is null is none.
    """
    entry, exit_, filled = F.col("purpose") == "entry", F.col("purpose") == "exit", F.col("status") == "filled"
    row, seq = F.struct("trade_date", "notional", "cost"), F.col("seq")
    place = F.col("place") if "place" in trades.columns else F.lit(0)
    known, told = seq.isNotNull(), seq.isNotNull() & F.col("reason").isNotNull()
    t = trades.groupBy("window_id").agg(
        F.min_by(row, F.when(entry & filled & known, F.struct(seq, place, row))).alias("e"), F.max_by(row, F.when(exit_ & filled & known, F.struct(seq, -place, row))).alias("x"), F.count_if(entry & ~filled).alias("ue"), F.count_if(exit_ & ~filled).alias("ux"),
        F.min_by("reason", F.when(entry & ~filled & told, F.struct(seq, place, "reason"))).alias("why_entry"), F.min_by("reason", F.when(exit_ & ~filled & told, F.struct(seq, place, "reason"))).alias("why_exit"))
    j = targets.join(t, "window_id", "left")
    done = F.col("e").isNotNull() & F.col("x").isNotNull()
    paid = F.col("e.notional") + F.col("e.cost")
    return j.withColumns({
        "status": F.when(done, "completed").when(F.col("e").isNotNull(), "entry_filled_exit_incomplete").when(F.col("ue") > 0, "entry_unfilled").otherwise("missing_execution_status"),
        "failure_reason": F.when(done, None).when(F.col("e").isNotNull(), F.coalesce("why_exit", F.lit("missing_exit_execution"))).when(F.col("ue") > 0, F.col("why_entry")),
        "delayed_exit": F.coalesce((F.col("ux") > 0) & F.col("x").isNotNull(), F.lit(False)), "net_return": F.when(done & (paid != 0), (F.col("x.notional") - F.col("x.cost") - paid) / paid),
        "actual_entry_date": F.when(done, F.col("e.trade_date")), "actual_exit_date": F.when(done, F.col("x.trade_date"))}).drop("e", "x", "ue", "ux", "why_entry", "why_exit")


def flatten_items(raw: DataFrame, text: str = "response") -> DataFrame:
    """``url``, ``title`` and ``text`` of every item of JSON responses, whatever their shape.

    A response is a list, an object with a list under data, results or items (the first that is
    one), or itself an item if it has any of url, title, markdown and content.
    """
    item = "struct<url:string,sourceURL:string,title:string,metadata:struct<title:string>,markdown:string,content:string,description:string>"
    body = F.col(text)
    lists = [F.from_json(body, f"array<{item}>")] + [F.from_json(F.get_json_object(body, f"$.{k}"), f"array<{item}>") for k in ("data", "results", "items")]
    listed = [F.ltrim(body).startswith("[")] + [F.ltrim(F.get_json_object(body, f"$.{k}")).startswith("[") for k in ("data", "results", "items")]
    own = F.from_json(body, item)
    itself = own["url"].isNotNull() | own["title"].isNotNull() | own["markdown"].isNotNull() | own["content"].isNotNull()
    found = F.when(F.coalesce(listed[0], F.lit(False)), lists[0])
    for is_list, values in zip(listed[1:], lists[1:], strict=True):
        found = found.when(F.coalesce(is_list, F.lit(False)), values)
    found = found.when(itself, F.array(own))
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    i = F.col("i")
    return raw.select(F.explode(found).alias("i")).select(some(i["url"], i["sourceURL"]).alias("url"), some(i["title"], i["metadata"]["title"]).alias("title"), some(i["markdown"], i["content"], i["description"]).alias("text"))


def next_weekly_signals(calendar: DataFrame) -> DataFrame:
    """For each day as activation date: the last day of the smallest (year, ISO week) that any later or equal day has."""
    day = F.to_date("trade_date", "yyyyMMdd")
    k = calendar.select("trade_date", (F.year(day) * 100 + F.weekofyear(day)).alias("k"))
    w = Window.orderBy("trade_date").rowsBetween(0, Window.unboundedFollowing)  # a few thousand days
    last = k.groupBy("k").agg(F.max("trade_date").alias("signal_date"))
    return k.select("trade_date", F.min("k").over(w).alias("k")).join(F.broadcast(last), "k").select(F.col("trade_date").alias("activation_date"), "signal_date")


def days_back(calendar: DataFrame, n: int) -> DataFrame:
    """For each day the day ``n`` trading days before; the first day where there are fewer."""
    w = Window.orderBy("trade_date")  # a few thousand days
    return calendar.select("trade_date", F.coalesce(F.lag("trade_date", n).over(w), F.min("trade_date").over(w)).alias("start_date"))


def range_return(bars: DataFrame) -> DataFrame:
    """Per code the return from its first to its last close; null for a single bar."""
    first, last = F.min_by("close", "trade_date"), F.max_by("close", "trade_date")
    return bars.groupBy("ts_code").agg(F.when(F.count("*") >= 2, F.try_divide(last, first) - 1).alias("range_return"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def out_of_order(schedule: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """Up to ``most`` rows whose dates don't strictly follow one another; none if all is well."""
    bad = F.lit(False)
    for a, b in zip(columns, columns[1:], strict=False):
        bad = bad | ~(F.col(a) < F.col(b))
    return schedule.filter(bad).orderBy(*columns).limit(most)


def preferred_first(rows: DataFrame, key: str, order: str, preferred: list[str], n: int) -> DataFrame:
    """``n`` rows: those named in ``preferred``, in its order, then the others in theirs."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col(key))
    by = [F.when(place > 0, place).otherwise(len(preferred) + 1), F.col(order)]
    return rows.orderBy(*by).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*by)))


def relabelled(text: Column, labels: list[tuple[str, str]]) -> Column:
    """Replacements one after the other, so a short name inside a longer one is replaced first if it comes first."""
    for old, new in labels:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def json_hash(*columns: str) -> Column:
    """SHA-256 of the row as JSON, names in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
