"""Portfolios that a market regime switches on and off, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Trading days that a year counts.
YEAR = 252


def held_days(days: DataFrame, freq: int = 5) -> DataFrame:
    """``days`` (trade_date, regime_on) with ``is_rebalance`` and ``held_from``: the day whose picks are held.

    Every ``freq``-th day is a rebalance day. Picks are those of the last rebalance day since the
    regime was last off; null while it is off and until the first such day. One index in order: a
    few thousand rows, however many names the panel has.
    """
    w = Window.orderBy("trade_date")
    d = days.withColumns({"is_rebalance": (F.row_number().over(w) - 1) % freq == 0, "stretch": F.count_if(~F.col("regime_on")).over(w)})
    own = Window.partitionBy("stretch").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    picked = F.when(F.col("regime_on") & F.col("is_rebalance"), F.col("trade_date"))
    return d.withColumn("held_from", F.last(picked, ignorenulls=True).over(own)).drop("stretch")


def gated_path(days: DataFrame, picks: DataFrame, returns: DataFrame, top_n: int = 20, freq: int = 5, cost_bps: float = 20) -> DataFrame:
    """Daily return of the picks (trade_date, ts_code) held while the regime is on; cash otherwise.

    Every pick weighs 1 / ``top_n``; one without a row in ``returns`` (trade_date, ts_code, ret)
    on a day counts as zero. A rebalance day with holdings pays the cost of a sale and a purchase.
    Null returns are zero; a rebalance day without picks leaves nothing held until the next.
    """
    d = held_days(days, freq)
    chosen = d.filter("held_from is not null").select("trade_date", "held_from").join(picks.select(F.col("trade_date").alias("held_from"), "ts_code"), "held_from")
    held = chosen.join(returns.select("trade_date", "ts_code", "ret"), ["trade_date", "ts_code"], "left").groupBy("trade_date")
    held = held.agg(F.count("*").alias("n"), (F.sum(F.coalesce("ret", F.lit(0.0))) / top_n).alias("gross"))
    out = d.join(held, "trade_date", "left").withColumn("holdings_count", F.coalesce("n", F.lit(0)))
    cost = F.when(F.col("is_rebalance") & (F.col("holdings_count") > 0), F.lit(2 * cost_bps / 10000)).otherwise(0.0)
    return out.select("trade_date", "regime_on", "is_rebalance", "holdings_count", (F.coalesce("gross", F.lit(0.0)) - cost).alias("portfolio_return"), cost.alias("cost"))


def path_metrics(path: DataFrame, ret: str = "portfolio_return", *by: str) -> DataFrame:
    """One row a path (``by``): compounded return, sample-deviation ratios, drawdown, switches, days won.

    A path's first day counts as a switch. Ratios without a deviation are zero.
    """
    w = Window.partitionBy(*by).orderBy("trade_date")
    r = F.col(ret)
    p = path.withColumn("equity", F.exp(F.sum(F.log1p(r)).over(w))).withColumns({
        "peak": F.max("equity").over(w), "switched": ~F.col("regime_on").eqNullSafe(F.lag("regime_on").over(w))})
    m = p.groupBy(*by).agg(
        F.count("*").alias("days"), (F.max_by("equity", "trade_date") - 1).alias("total_return"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.stddev_samp(F.when(r < 0, r)).alias("dsd"),
        F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"), F.count_if("regime_on").alias("risk_on_days"), F.count_if("switched").alias("switch_count"), F.avg((r > 0).cast("int")).alias("win_rate"))
    year = F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.col("days")) - 1
    ratio = lambda sd: F.when(F.col(sd) > 0, F.col("mean") / F.col(sd) * YEAR**0.5).otherwise(0.0)
    m = m.withColumns({"annualized_return": year, "sharpe": ratio("sd"), "sortino": ratio("dsd")})
    m = m.withColumn("calmar", F.when(F.col("max_drawdown") != 0, F.col("annualized_return") / F.abs("max_drawdown")).otherwise(0.0))
    return m.drop("mean", "sd", "dsd")


def watchlist(picks: DataFrame, limits: DataFrame, tradability: DataFrame) -> DataFrame:
    """The picks of a day with special treatment, limits that the close touches, tradability and an equal weight.

    Names that ``tradability`` calls untradable, blocked or suspended aren't tradable; its other
    rows don't matter.
    """
    near = 1e-6
    shut = tradability.filter(F.upper("tradability_proxy").isin("UNTRADABLE", "BLOCKED", "SUSPENDED")).select("trade_date", "ts_code", F.lit(False).alias("open"))
    out = picks.join(limits, ["trade_date", "ts_code"]).join(shut, ["trade_date", "ts_code"], "left")
    return out.select(
        "trade_date", "ts_code", "rank", "factor_value", F.coalesce("historical_is_st", F.lit(0)).alias("is_st"), "limit_status", (F.col("raw_close") >= F.col("limit_up") - near).alias("hit_limit_up"),
        (F.col("raw_close") <= F.col("limit_down") + near).alias("hit_limit_down"), F.coalesce("open", F.lit(True)).alias("tradable"), F.round(1 / F.count("*").over(Window.partitionBy("trade_date")), 8).alias("weight"))


def cost_grid(path: DataFrame, bps: list[float], paid_bps: float = 20, *by: str) -> DataFrame:
    """The path at each of a few costs: ``cost`` is what it paid at ``paid_bps``. One row a day and cost."""
    out = path.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(b)) for b in bps])))
    net = F.col("portfolio_return") + F.col("cost") - F.col("cost") * F.col("cost_bps") / paid_bps
    return out.withColumn("portfolio_return", net).drop("cost")
