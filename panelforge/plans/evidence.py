"""Queries over versions, stores, rules, intervals and differences; their SQL is in :mod:`panelforge.plans.evidence_sql`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelforge.functions import features as feat, formula_space
from panelforge.functions.formula import parse
from panelforge.lineage import checkpointed, shared_folder
from panelforge.operators import checks, correlation, crosssec, graphs, intervals, multiset, quantiles, rules
from panelforge.plans import queries as q
from panelforge.schema import KEY, finite
from panelforge.sources import bars as src, versions
from panelforge.sources.factor_store import FactorStore

#: Screened besides: one that is null everywhere, one that is constant, one with little to say, and values beyond numbers.
HARD = {"empty": "DIV(RET1,SUB(RET5,RET5))", "level": "SUB(RET1,RET1)", "weak": "SIGN(RET120)"}


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _wild(df, name):
    """A value of which the large ones are infinite and the small ones not a number."""
    x = F.col(name)
    return F.when(x > 0.05, F.exp(F.lit(1000.0))).when(x < -0.05, F.lit(float("nan"))).otherwise(x)


def feature_clusters(spark, sf_dir):
    """All features, in the language's order, clustered by rank correlation."""
    panel = q._rounded(feat.compute(q._bars(spark, sf_dir), feat.NAMES), feat.NAMES)
    pairs = q._rounded(correlation.rank_correlations(panel, list(feat.NAMES), least=0.5), ["correlation"], 6)
    return graphs.greedy_clusters(q.in_order(spark, list(feat.NAMES)), pairs, 0.6)


def screen_verdicts(spark, sf_dir):
    """Every verdict of the fast screen, infinite and undefined values among what is screened."""
    from panelforge.functions.formula import columns

    df = feat.compute(crosssec.forward_return(q._bars(spark, sf_dir), 5), feat.NAMES)
    texts = q.SCREENED | HARD
    df = columns(df, {k: parse(t) for k, t in texts.items()}).withColumn("wild", _wild(df, "RET5"))
    names = [*texts, "wild"]
    df = df.withColumns({n: F.round(finite(F.col(n)), 8) for n in names} | {"forward_return": F.round("forward_return", 8)})
    out = crosssec.screened(crosssec.by_date_wide(df, names), 0.3, 0.0005, 0.01)
    return q._rounded(out, [c for c, t in out.dtypes if t == "double"], 6)


def finite_validity(spark, sf_dir):
    """How many values are infinite or undefined, and that they make a formula invalid."""
    df = q._rounded(feat.compute(q._bars(spark, sf_dir), ["RET5"]), ["RET5"])
    df = df.withColumn("wild", _wild(df, "RET5"))
    odd = F.col("wild").isNotNull() & finite(F.col("wild")).isNull()
    df = df.withColumns({"odd": odd, "x": finite(F.col("wild"))})
    return q._rounded(rules.validity(df, "x", F.col("odd")), ["std"], 6)


def factor_store_screen(spark, sf_dir):
    """A screen of three formulas, then one of four that are partly the same: what the second one answers, and from where."""
    bars = q._rounded(crosssec.forward_return(q._bars(spark, sf_dir), 5), ["forward_return"])
    store = FactorStore(spark, _folder(spark, "factors"))
    panel = store.panel_hash(bars)
    known = {k: parse(t) for k, t in q.SCREENED.items() if k != "busy"}

    def screened(formulas):
        """Forward returns lie beside the values; both are dealt out by date once, a row a key."""
        return store.results(bars, formulas, {"horizon": 5, "digits": 8}, evaluate, panel, ("forward_return",), keep=True, deal="trade_date")

    def evaluate(values):
        return crosssec.fast_screen(values.withColumn("factor_value", F.round(finite(F.col("factor_value")), 8)))

    screened(known)
    out = screened({k: parse(t) for k, t in q.SCREENED.items()})
    return q._rounded(out, [c for c, t in out.dtypes if t == "double"], 6)


def registry_versions(spark, sf_dir):
    """Customers as a registry: a first load, a replay, changed balances, a quarantine; the first version beside the newest."""
    c = src.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    table = versions.Table(spark, _folder(spark, "registry"), ["c_custkey"], "c_custkey long, c_acctbal double, c_mktsegment string")
    table.append_unique(c, "c_acctbal")
    table.append_unique(c.unionByName(c), "c_acctbal")
    table.upsert(c.filter("c_custkey % 7 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 100, 2)))
    table.quarantine(c.filter("c_mktsegment = 'BUILDING' and c_custkey % 5 = 0"))
    newest = table.newest()
    return table.read(1).withColumn("version", F.lit(1)).unionByName(table.read(newest).withColumn("version", F.lit(newest)))


def run_outputs(spark, sf_dir):
    """Orders and their lines as the tables of one run, published twice: rows of every table by version."""
    run = versions.Run(spark, _folder(spark, "run"))
    o, line = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    run.publish({"orders": o, "lines": line}, most_bytes=1 << 40, spare=0.0)
    run.publish({"orders": o.filter("o_orderstatus = 'F'"), "lines": line.join(o.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")})
    parts = [run.table(n, v).select(F.lit(n).alias("name"), F.lit(v).alias("version")) for n in ("orders", "lines") for v in (1, 2)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name", "version").agg(F.count("*").alias("n"))


def formula_draws(spark, sf_dir):
    """Parts as attempts of a search over all formulas up to three tokens: each formula once, with its first attempt."""
    number = F.pmod(F.col("p_partkey") * 7919 + F.col("p_size") * 104729, F.lit(formula_space.size(3)))
    attempts = src.table(spark, sf_dir, "part").select("p_partkey", number.alias("number"))
    return formula_space.distinct_formulas(attempts, "p_partkey", "number", 3)


def exact_quantiles(spark, sf_dir):
    """Quantiles of all prices and of each return flag's, however many there are."""
    line = src.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    whole = quantiles.exact_quantiles(line, "l_extendedprice", at).withColumn("l_returnflag", F.lit("all"))
    out = whole.unionByName(quantiles.exact_quantiles(line, "l_extendedprice", at, ["l_returnflag"]))
    return out.select("l_returnflag", "n", *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(len(at))])


def _listed(b):
    return b.groupBy("ts_code").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def interval_pairs(spark, sf_dir):
    """Stretches of quarters in which a name traded against its periods of special treatment."""
    b = q._bars(spark, sf_dir)
    quarter = F.concat(F.substring("trade_date", 1, 4), F.floor((F.substring("trade_date", 5, 2).cast("int") - 1) / 3).cast("string"))
    traded = b.groupBy("ts_code", quarter.alias("quarter")).agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    return intervals.overlaps(traded, src.st_periods(spark, sf_dir), ["ts_code"], ("first_date", "last_date"), ("start_date", "end_date"))


def st_timeline(spark, sf_dir):
    return intervals.timeline(src.st_periods(spark, sf_dir), ["ts_code"], "historical_is_st")


def unmatched_rows(spark, sf_dir):
    """Customers without their keys, compared with a copy whose balances have rounding errors, of which some have moved and some are gone."""
    c = src.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey")
    noise = F.when(k % 3 == 0, 1e-10).when(k % 3 == 1, -1e-10).otherwise(0.0)
    other = c.filter(k % 41 != 0).withColumn("c_acctbal", F.col("c_acctbal") + noise + F.when(k % 29 == 0, 0.004).otherwise(0.0))
    out = multiset.unmatched(c.drop("c_custkey"), other.drop("c_custkey"), ["c_nationkey", "c_mktsegment"], {"c_acctbal": 1e-8})
    # rows of one balance but for rounding errors are one
    return out.groupBy("c_nationkey", "c_mktsegment", F.round("c_acctbal", 4).alias("c_acctbal")).agg(F.sum("left").alias("left"), F.sum("right").alias("right"))


def _broken(spark, sf_dir):
    """The panel with planted violations: by code and day of the month."""
    b = q._bars(spark, sf_dir)
    n, day = F.col("ts_code").cast("int"), F.substring("trade_date", 7, 2).cast("int")
    hit = lambda a, d: (n % a == 0) & (day == d)
    return b.withColumns({
        "raw_close": F.when(hit(3, 1), -F.col("raw_close")).when(hit(5, 2), None).otherwise(F.col("raw_close")), "raw_high": F.when(hit(4, 3), F.col("raw_low") - 1).otherwise(F.col("raw_high")),
        "raw_open": F.when(hit(7, 4), F.col("raw_high") + 5).otherwise(F.col("raw_open")), "volume": F.when(hit(2, 5), 0.0).otherwise(F.col("volume")),
        "amount": F.when(hit(6, 6), F.exp(F.lit(1000.0))).otherwise(F.col("amount")), "trade_date": F.when(hit(9, 7), F.concat(F.substring("trade_date", 1, 6), F.lit("99"))).otherwise(F.col("trade_date"))})


def panel_rules(spark, sf_dir):
    """Ten rules over the panel in one pass, each with its violations and the first and last of them."""
    limit = F.col("pre_close")
    found = [
        checks.Rule("close_missing", F.col("raw_close").isNull(), "prices"), checks.Rule("close_not_positive", F.col("raw_close") <= 0, "prices"), checks.Rule("high_below_low", F.col("raw_high") < F.col("raw_low"), "prices"),
        checks.Rule("open_out_of_range", (F.col("raw_open") > F.col("raw_high")) | (F.col("raw_open") < F.col("raw_low")), "prices"), checks.Rule("first_bar", limit.isNull(), "prices"),
        checks.Rule("move_over_limit", F.abs(F.col("raw_open") - limit) > 0.1005 * limit, "limits"), checks.Rule("no_volume", F.coalesce("volume", F.lit(0.0)) <= 0, "volumes"),
        checks.Rule("amount_not_finite", finite(F.col("amount")).isNull(), "volumes"), checks.Rule("no_date", F.try_to_date("trade_date", "yyyyMMdd").isNull(), "keys"), checks.Rule("code_not_six_digits", ~F.col("ts_code").rlike("^[0-9]{6}$"), "keys"),
    ]
    return checks.judged(_broken(spark, sf_dir), found, ["ts_code", "trade_date"])


def broken_schedule(spark, sf_dir):
    """The weekly schedule with some weeks entered too early or left too soon: the first three of them."""
    from panelforge.operators import research

    s = rules.weekly_schedule(src.calendar(q._bars(spark, sf_dir)))
    n = F.substring("signal_date", 7, 2).cast("int")
    s = s.select("signal_date", F.when(n % 9 == 0, F.col("signal_date")).otherwise(F.col("entry_date")).alias("entry_date"), F.when(n % 11 == 0, F.col("entry_date")).otherwise(F.col("exit_date")).alias("exit_date"))
    return research.out_of_order(s, ["signal_date", "entry_date", "exit_date"])


def forward_events(events):
    """Events of users as what a forward run meets: twenty protocols, days up to a week ahead that are open, days that are complete, looks."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "calendar").when(F.col("event_type") == "purchase", "data").otherwise("check")
    ahead = F.when(kind == "calendar", (F.col("event_id") % 8).cast("int")).otherwise(0)
    return events.select(F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("protocol"), F.col("event_id").cast("string").alias("event_id"), kind.alias("kind"),
                         F.date_format(F.date_add(F.to_date("ts"), ahead), "yyyyMMdd").alias("trade_date"), F.col("ts").cast("timestamp").alias("ts"))


def forward_log(spark, sf_dir):
    """The log of a forward run over all events as a stream; the last two days still wait for what may be late."""
    from panelforge.streaming import forward_run

    folder = _folder(spark, "forward")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern it may be a file or a folder
    log = versions.Table(spark, f"{folder}/log", ["event_id"], forward_run.LOG)
    forward_run.run(forward_events(stream), log, f"{folder}/mark").awaitTermination()
    return log.read()


def seed_gate(spark, sf_dir):
    """Parts as seed records of a second round: each under every rule that it breaks."""
    from panelforge.operators import second_round

    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(size % 11 == 0, "requires_new_data").when(size % 13 == 0, "partial_source_candidate").when(size % 17 != 0, "computable_with_current_data")
    seeds = src.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), k.cast("string")).alias("seed_factor_id"), kind.alias("computability_class"), F.when(k % 17 != 0, F.col("p_brand")).alias("source_title"), F.when(k % 34 == 0, "").when(k % 5 != 0, F.col("p_name")).alias("source_url_or_path"),
        F.when(k % 19 != 0, size % 7 != 0).alias("source_verified_by_firecrawl"), (size == 50).alias("requires_new_operator"), (k % 23 == 0).alias("requires_new_external_data"), (F.floor("p_retailprice") % 5 != 0).alias("suggested_for_second_batch_minimal_experiment"))
    return second_round.breaches(seeds, second_round.seed_rules(), "seed_factor_id")


def run_equivalence(spark, sf_dir):
    """Two runs table by table: equal but for rounding errors, with moved cash, with lost rows, with another column, with a table that only one has."""
    from panelforge.operators import equivalence

    c = src.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("cash"), "c_mktsegment")
    o = src.table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").alias("notional"))
    n = src.table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    moved = c.withColumn("cash", F.col("cash") + F.when(F.col("c_custkey") % 3 == 0, 5e-9).otherwise(0.0) + F.when(F.col("c_custkey") % 100 == 0, 1.0).otherwise(0.0))
    left = {"account": c, "noise": c.select("cash"), "orders": o, "names": n, "regions": n}
    right = {"account": moved, "noise": c.select((F.col("cash") - 3e-9).alias("cash")), "orders": o.filter("o_custkey % 10 <> 3"), "names": n.withColumnRenamed("n_name", "name")}
    return equivalence.runs_compared(left, right).select("section", "equal", "difference_count")


def asof_events(spark, sf_dir):
    """Each purchase with its user's last view or click at most six hours before."""
    from panelforge.operators import joins

    e = src.table(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    seen = e.filter("event_type in ('view', 'click')").select("user_id", F.col("event_id").alias("seen_id"), F.col("ts").alias("seen_ts"), F.col("event_type").alias("seen_type"))
    return joins.as_of_rows(bought, seen, ["user_id"], "ts", "seen_ts", 6 * 3600.0)


def scan_basic(spark, sf_dir):
    """A range of bars with the turnover rate of the basic table, where it has one."""
    b = src.scan_bars(q._bars(spark, sf_dir), "19950101", "19951231", None, ["raw_close", "volume"])
    return b.join(src.basic(spark, sf_dir, "19950101", "19951231"), KEY, "left")


SEGMENTS = {"train": ("19920101", "19941231"), "validation": ("19950101", "19971231"), "blind": ("19980101", "20051231")}


def frozen_validation(spark, sf_dir):
    """Formulas chosen on one segment, looked at on two later ones."""
    from panelforge.plans import validation

    return validation.frozen_on(q._bars(spark, sf_dir), {k: parse(t) for k, t in q.SCREENED.items()}, SEGMENTS)


def rewards_described(spark, sf_dir):
    from panelforge.plans import validation
    from panelforge.sources import candidates

    out = validation.rewards_described(candidates.finds(spark, sf_dir))
    return q._rounded(out, ["mean", "std", "p10", "p50", "p90"], 6)


NAMES = (
    "asof_events scan_basic seed_gate run_equivalence frozen_validation rewards_described feature_clusters screen_verdicts finite_validity factor_store_screen registry_versions run_outputs formula_draws exact_quantiles interval_pairs st_timeline unmatched_rows panel_rules broken_schedule forward_log"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
