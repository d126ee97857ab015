"""Account, trade and distribution statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def account_metrics(accounts: DataFrame, trades: DataFrame, by: str = "formula", periods: int = 252) -> DataFrame:
    """Returns, risk and trade counts of each account path (``by``, trade_date, total_equity, net_return, ...).

    Downside risk is the population deviation of the negative returns about their own mean; the
    annualising exponent counts all rows.
    """
    w = Window.partitionBy(by).orderBy("trade_date")
    a = accounts.withColumn("dd", F.col("total_equity") / F.max("total_equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    at = F.col("trade_date")
    m = a.groupBy(by).agg(
        F.count("*").alias("rows"), (F.max_by("total_equity", at) / F.min_by("total_equity", at) - 1).alias("total_return"), F.count("net_return").alias("n"),
        F.stddev_pop("net_return").alias("sd"), F.stddev_pop(F.when(F.col("net_return") < 0, F.col("net_return"))).alias("dsd"), F.min("dd").alias("max_drawdown"),
        F.sum("turnover").alias("turnover"), (F.product(1 + F.col("gross_return")) - 1).alias("gross_return"), (F.product(1 + F.col("net_return")) - 1).alias("net_return"),
        F.max_by("cumulative_cost", at).alias("cumulative_cost"), F.avg(F.try_divide(F.col("cash"), F.col("total_equity"))).alias("cash_ratio"))
    year = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), F.lit(float(periods)) / F.greatest(F.col("n"), F.lit(1))) - 1)
    m = m.withColumns({"annualized_return": year, "annualized_volatility": F.col("sd") * periods**0.5})
    m = m.withColumns({
        "sharpe": F.when(F.col("sd") > 0, F.col("annualized_return") / F.col("annualized_volatility")), "sortino": F.when(F.col("dsd") > 0, F.col("annualized_return") / (F.col("dsd") * periods**0.5)),
        "calmar": F.when(F.col("max_drawdown") != 0, F.col("annualized_return") / F.abs("max_drawdown")), "status": F.when(F.col("rows") < 2, "insufficient_data").otherwise("ok")})
    t = trades.groupBy(by).agg(
        F.count_if(F.col("status") == "filled").alias("trade_count"), F.count_if((F.col("side") == "buy") & (F.col("status") == "unfilled")).alias("unfilled_buy_count"),
        F.count_if((F.col("side") == "sell") & (F.col("status") == "unfilled")).alias("unfilled_sell_count"))
    return m.drop("rows", "n", "sd", "dsd").join(t, by, "left").fillna(0, ["trade_count", "unfilled_buy_count", "unfilled_sell_count"])


def drawdown(df: DataFrame, ret: str, by: str, order: str) -> DataFrame:
    """Compounded equity and its distance from the running maximum."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0)))).over(w)))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def monthly(df: DataFrame, ret: str, *by: str) -> DataFrame:
    return df.groupBy(*by, F.substring("trade_date", 1, 6).alias("month")).agg((F.product(1 + F.col(ret)) - 1).alias("month_return"))


def distribution(df: DataFrame, x: str, *by: str) -> DataFrame:
    p = F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), p.alias("p")).select(
        *by, "n", "mean", "std", "min", "max", F.col("p")[0].alias("p10"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p90"))


def pair_trades(trades: DataFrame) -> DataFrame:
    """Each sell with the last buy before it that no other sell has closed (a later buy replaces an open one).

    A sell number counts the sells before a row; the last buy of the same number is the open one.
    """
    w = Window.partitionBy("ts_code").orderBy("trade_date", "seq")
    sell = F.col("side") == "sell"
    t = trades.withColumn("island", F.sum(sell.cast("int")).over(w) - sell.cast("int"))
    i = Window.partitionBy("ts_code", "island").orderBy("trade_date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("entry", F.last(F.when(~sell, F.struct("trade_date", "price")), ignorenulls=True).over(i))
    return t.filter(sell & F.col("entry").isNotNull()).select("ts_code", F.col("entry.trade_date").alias("entry_date"), F.col("trade_date").alias("exit_date"), (F.col("price") / F.col("entry.price") - 1).alias("trade_return"))


def window_summary(windows: DataFrame, *by: str) -> DataFrame:
    """Counts of target windows by status and the net returns of completed ones (null if there are none)."""
    status, net = F.col("status"), F.when(F.col("status") == "completed", F.col("net_return"))
    return windows.groupBy(*by).agg(
        F.count("*").alias("target_window_count"),
        *[F.count_if(status == s).alias(n) for s, n in (
            ("completed", "completed_window_count"), ("entry_unfilled", "entry_unfilled_count"), ("entry_filled_exit_incomplete", "incomplete_exit_count"), ("missing_execution_status", "missing_status_count"))],
        F.count_if("delayed_exit").alias("delayed_exit_count"), F.count(net).alias("net_return_count"), F.count_if(net > 0).alias("positive_count"), F.count_if(net < 0).alias("negative_count"),
        F.count_if(net == 0).alias("zero_count"), F.avg(net).alias("mean_net_return"), F.median(net).alias("median_net_return"))
