"""Performance metrics and trade statistics (M7-M9, M12, W16, W17, A6-A9,
A24, O2, O5, J12, T8).

Curves are keyed by a ``name`` column (strategy, benchmark or sweep point),
so one grouped pass computes the metrics of any number of curves; windows
are partitioned by that key and hold one row per business day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from .quantiles import grouped_quantiles

SQRT252 = math.sqrt(252.0)


def with_returns(curve: DataFrame, key: str = "name", value: str = "portfolio_value") -> DataFrame:
    """W7 + W16 on a value curve: daily return (NULL after a value of zero or less), running max and drawdown."""
    w = Window.partitionBy(key).orderBy("date")
    before = F.lag(value).over(w)
    return (curve.withColumn("daily_return", F.when(before > 0, F.col(value) / before - 1))
                 .withColumn("running_max", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("drawdown", F.try_divide(F.col(value) - F.col("running_max"), F.col("running_max"))))


def performance(curve: DataFrame, capital: float, key: str = "name", value: str = "portfolio_value") -> DataFrame:
    """M12 per curve: total and annualised return (%), volatility (%), Sharpe,
    Sortino (annualised, and the reference's un-annualised form), max drawdown (%).

    Sharpe = mean/std * sqrt(252), 0 when std is 0 or undefined. A curve that ends at
    zero or less has lost everything: its annualised return is -100 %.
    """
    r = with_returns(curve, key, value)
    # an unchanged value may differ in its last bit between two sums: that is no loss
    neg = F.when(F.col("daily_return") < -1e-12, F.col("daily_return"))
    agg = r.groupBy(key).agg(
        F.max_by(value, "date").alias("_last"),
        F.count(F.lit(1)).alias("n_days"),
        F.avg("daily_return").alias("_mean"),
        F.stddev_samp("daily_return").alias("_std"),
        F.stddev_samp(neg).alias("_dstd"),
        F.min("drawdown").alias("_mdd"))
    std_ok = F.coalesce(F.col("_std") > 0, F.lit(False))
    dstd_ok = F.coalesce(F.col("_dstd") > 0, F.lit(False))
    return agg.select(
        key,
        ((F.col("_last") / capital - 1) * 100).alias("total_return"),
        F.when(F.col("_last") > 0, (F.pow(F.col("_last") / capital, 252.0 / F.col("n_days")) - 1) * 100)
         .otherwise(F.lit(-100.0)).alias("annualized_return"),
        (F.col("_std") * SQRT252 * 100).alias("volatility"),
        F.when(std_ok, F.col("_mean") / F.col("_std") * SQRT252).otherwise(F.lit(0.0)).alias("sharpe"),
        F.when(dstd_ok, F.col("_mean") / F.col("_dstd") * SQRT252).otherwise(F.lit(0.0)).alias("sortino"),
        F.when(dstd_ok, F.col("_mean") / F.col("_dstd")).otherwise(F.lit(0.0)).alias("sortino_reference"),
        (F.coalesce(F.col("_mdd"), F.lit(0.0)) * 100).alias("max_drawdown"),
        F.col("_last").alias("final_value"),
        "n_days")


def benchmark_curves(bars: DataFrame, capital: float, start: str, end: str,
                     names: dict[str, str] | None = None) -> DataFrame:
    """Buy-and-hold value close / first close * capital per benchmark symbol."""
    from .trades import as_date
    b = bars.filter(F.col("date").between(as_date(start), as_date(end)))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    nm = F.col("ticker")
    if names:
        m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
        nm = F.coalesce(m[F.col("ticker")], F.col("ticker"))
    return b.select(nm.alias("name"), "date",
                    (F.col("close") / F.first("close").over(w) * capital).alias("portfolio_value"))


def compare_to_benchmarks(perf: DataFrame, strategy: str = "strategy", key: str = "name") -> DataFrame:
    """Strategy total return minus each benchmark's; out/under-performed.

    The strategy's return enters as a scalar subquery.
    """
    s = perf.filter(F.col(key) == strategy).agg(F.max("total_return")).scalar()
    b = perf.filter(F.col(key) != strategy)
    return b.select(F.col(key).alias("benchmark"), s.alias("strategy_return"),
                    F.col("total_return").alias("benchmark_return"),
                    (s - F.col("total_return")).alias("difference"),
                    F.when(s - F.col("total_return") > 0, "outperformed")
                     .otherwise("underperformed").alias("status"))


def trade_stats(trades: DataFrame, group: list[str] | None = None) -> DataFrame:
    """A6 + A7: counts, win/loss rates, mean P&L, mean win/loss, total, profit factor.

    Without trades the rates are NULL, as the means and the total are, and the profit factor is 0.
    """
    pnl = F.col("pnl")
    wins, losses = F.count_if(pnl > 0), F.count_if(pnl < 0)
    gross_win = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))
    gross_loss = F.abs(F.sum(F.when(pnl < 0, pnl)))
    aggs = [F.count(F.lit(1)).alias("trades"), wins.alias("wins"), losses.alias("losses"),
            (safe_div(wins, F.count(F.lit(1))) * 100).alias("win_rate"),
            (safe_div(losses, F.count(F.lit(1))) * 100).alias("loss_rate"),
            F.avg(pnl).alias("avg_pnl"),
            F.avg(F.when(pnl > 0, pnl)).alias("avg_win"),
            F.avg(F.when(pnl < 0, pnl)).alias("avg_loss"),
            F.sum(pnl).alias("total_pnl"),
            (gross_win / F.coalesce(gross_loss, F.lit(1.0))).alias("profit_factor")]
    return trades.groupBy(*(group or [])).agg(*aggs)


def quartile_bins(df: DataFrame, col: str, out: str = "quartile") -> DataFrame:
    """M7 (qcut, q=4): edges are the interpolated 25/50/75 % quantiles; bins are
    right-closed with the lowest value included (1..4). Not ``ntile``.

    The edges are a scalar subquery (computed once, then a literal to every
    row) over exact quantiles by ranges of values; no task holds the whole column.
    """
    q = grouped_quantiles(df.withColumn("_all_rows", F.lit(1)), ["_all_rows"], col, [0.25, 0.5, 0.75]).select("q").scalar()
    x = F.col(col)
    b = (F.when(x <= q[0], 1).when(x <= q[1], 2).when(x <= q[2], 3).otherwise(4))
    return df.withColumn(out, F.when(x.isNotNull(), b))


def quartile_performance(trades: DataFrame) -> DataFrame:
    """Per signal-score quartile: mean/sum/count P&L, mean P&L %, mean size, win rate."""
    q = quartile_bins(trades, "signal_score")
    return q.groupBy("quartile").agg(
        F.avg("pnl").alias("avg_pnl"), F.sum("pnl").alias("total_pnl"), F.count(F.lit(1)).alias("trades"),
        F.avg("pnl_pct").alias("avg_pnl_pct"), F.avg("position_size").alias("avg_position"),
        (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)) * 100).alias("win_rate"))


def score_relationship(trades: DataFrame) -> DataFrame:
    """M8 + M9: Pearson correlation and degree-1 fit of pnl_pct on signal_score.

    The correlation is NULL where one of the two does not vary (``corr`` divides by zero there).
    """
    x = F.when(F.col("pnl_pct").isNotNull(), F.col("signal_score"))
    y = F.when(F.col("signal_score").isNotNull(), F.col("pnl_pct"))
    return trades.agg(safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("correlation"),
                      F.regr_slope("pnl_pct", "signal_score").alias("slope"),
                      F.regr_intercept("pnl_pct", "signal_score").alias("intercept"))


def top_trades(trades: DataFrame, n: int = 20) -> DataFrame:
    """O2: the ``n`` most profitable trades (ties broken by ticker, entry date),
    with their rank, long count, total and share of all profit (%)."""
    order = [F.col("pnl").desc(), F.col("ticker"), F.col("entry_date")]
    top = trades.orderBy(*order).limit(n)
    total = trades.agg(F.sum("pnl")).scalar()
    top_long = top.agg(F.count_if(F.col("direction") == "long")).scalar()
    top_total = top.agg(F.sum("pnl")).scalar()
    w = Window.orderBy(*order)
    return (top.withColumn("rank", F.row_number().over(w))
               .withColumn("top_long", top_long)
               .withColumn("top_total", top_total)
               .withColumn("top_share", F.try_divide(top_total, total) * 100))


def monthly_returns(curve: DataFrame, key: str = "name", value: str = "portfolio_value") -> DataFrame:
    """Per month, last / first value - 1 (in %)."""
    m = curve.withColumn("month", F.trunc("date", "month"))
    return (m.groupBy(key, "month")
             .agg(((F.max_by(value, "date") / F.min_by(value, "date") - 1) * 100).alias("monthly_return")))


def best_by(perf: DataFrame, key: str = "name") -> DataFrame:
    """The best curve by total return, by Sharpe and by (least negative) drawdown."""
    return perf.agg(F.max_by(key, "total_return").alias("best_return"),
                    F.max_by(key, "sharpe").alias("best_sharpe"),
                    F.max_by(key, "max_drawdown").alias("best_drawdown"))


def value_counts(df: DataFrame, col: str | Column) -> DataFrame:
    """A8."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
