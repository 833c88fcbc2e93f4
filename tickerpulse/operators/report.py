"""Report queries behind the per-date and per-ticker pages (P14, A3-A5, A27,
W5, W6, W15, J10).

The reference answers them for one (ticker, date) request at a time; here an
``anchors`` frame of (ticker, end_date) rows answers every request in one
job. Each anchor is expanded to its ``days + 1`` calendar dates and joined on
(ticker, date) - bounded work per anchor, no range join - and the windows are
partitioned by anchor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rolling, safe_div, stable_round
from ..functions.dates import window_start
from .daily import daily_sentiment_sql

ANCHOR = ["ticker", "end_date"]


def available_dates(signals: DataFrame) -> DataFrame:
    """Distinct signal days (the page lists them newest first)."""
    return signals.select(F.to_date("signal_date").alias("signal_date")).distinct()


def signals_by_date(signals: DataFrame) -> DataFrame:
    """P14 for every date: BUY / SELL / total counts and the tickers in order."""
    return (signals.groupBy(F.to_date("signal_date").alias("signal_date"))
                   .agg(F.count_if(F.col("signal_type") == "BUY").alias("n_buy"),
                        F.count_if(F.col("signal_type") == "SELL").alias("n_sell"),
                        F.count(F.lit(1)).alias("n_signals"),
                        F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("tickers")))


def _expand(anchors: DataFrame, days: int) -> DataFrame:
    return (anchors.select(*ANCHOR).distinct()
                   .withColumn("date", F.explode(F.sequence(window_start("end_date", days), F.col("end_date")))))


def sentiment_history(results: DataFrame, anchors: DataFrame, signals: DataFrame | None = None,
                      days: int = 30) -> DataFrame:
    """A3 + W5 + J10: daily AVG / COUNT / SUM(upvotes) / STDDEV over [end - days, end]
    per anchor, the 3-row window over days WITH data (no gap fill), and the
    stored signal metrics of that ticker and day (left join; two signals on one
    day give two rows)."""
    per_day = daily_sentiment_sql(results, with_median=False).select(
        "ticker", F.col("sentiment_date").alias("date"), "sentiment_mean", "mentions",
        "total_upvotes", F.col("sentiment_std").alias("sentiment_stddev"))
    h = _expand(anchors, days).join(per_day, ["ticker", "date"])
    w3 = Window.partitionBy(*ANCHOR).orderBy("date").rowsBetween(-2, 0)
    h = (h.withColumn("weighted_sentiment", F.col("sentiment_mean") * F.col("mentions"))
          .withColumn("window_sentiment", safe_div(F.sum("weighted_sentiment").over(w3),
                                                   F.nullif(F.sum("mentions").over(w3).cast("double"), F.lit(0.0)))))
    if signals is not None:
        s = signals.select("ticker", F.col("signal_date").alias("date"), "baseline_mean", "baseline_std",
                           "z_score", "signal_type")
        h = h.join(s, ["ticker", "date"], "left")
    return h


def history_bands(history: DataFrame, base_z: float = 2.0, sens: float = 0.2) -> DataFrame:
    """Baseline over the slice (30 rows, >= 15 values), then - on the rows
    that have a baseline only - the 3-row mention sum, dynamic threshold and
    the upper / lower bands."""
    w = Window.partitionBy(*ANCHOR).orderBy("date")
    b = (history.withColumn("baseline_mean_computed", rolling(F.avg, "window_sentiment", w.rowsBetween(-29, 0), 15))
                .withColumn("baseline_std_computed", rolling(F.stddev_samp, "window_sentiment",
                                                             w.rowsBetween(-29, 0), 15)))
    t = b.filter(F.col("baseline_mean_computed").isNotNull() & F.col("baseline_std_computed").isNotNull())
    mf = F.sum("mentions").over(w.rowsBetween(-2, 0))
    thr = base_z / (1 + sens * F.log1p(F.greatest(mf.cast("double"), F.lit(1.0))))
    return (t.withColumn("mention_factor", mf).withColumn("z_threshold", thr)
             .withColumn("upper_band", F.col("baseline_mean_computed") + F.col("z_threshold")
                         * F.col("baseline_std_computed"))
             .withColumn("lower_band", F.col("baseline_mean_computed") - F.col("z_threshold")
                         * F.col("baseline_std_computed")))


def history_summary(history: DataFrame) -> DataFrame:
    """A4: per anchor: mean sentiment (3 dp), total mentions, mean window
    sentiment (3 dp), std of daily sentiment (3 dp; 0 for one row), days,
    signal days, z > 0 and z < 0 counts, mean z (2 dp)."""
    n = F.count(F.lit(1))
    return history.groupBy(*ANCHOR).agg(
        stable_round(F.avg("sentiment_mean"), 3).alias("avg_sentiment"),
        F.sum("mentions").alias("total_mentions"),
        stable_round(F.avg("window_sentiment"), 3).alias("window_sentiment"),
        F.when(n > 1, stable_round(F.stddev_samp("sentiment_mean"), 3)).otherwise(F.lit(0.0))
         .alias("sentiment_volatility"),
        n.alias("total_days"),
        F.count("z_score").alias("signal_days"),
        F.count_if(F.col("z_score") > 0).alias("buy_signals"),
        F.count_if(F.col("z_score") < 0).alias("sell_signals"),
        stable_round(F.avg("z_score"), 2).alias("avg_z_score"))


def price_panel(bars: DataFrame, anchors: DataFrame, days: int = 30) -> DataFrame:
    """W7 + W15 per anchor: bars of [end - days, end], daily % change and the full 3-bar mean."""
    p = _expand(anchors, days).join(bars, ["ticker", "date"])
    w = Window.partitionBy(*ANCHOR).orderBy("date")
    return (p.withColumn("pct_change", (safe_div(F.col("close"), F.lag("close").over(w)) - 1) * 100)
             .withColumn("ma_3", rolling(F.avg, "close", w.rowsBetween(-2, 0), 3)))


def price_summary(panel: DataFrame, padding: float = 0.08) -> DataFrame:
    """A5: first / last close, % change, min / max and the padded axis range."""
    g = panel.groupBy(*ANCHOR).agg(F.min_by("close", "date").alias("first_price"),
                                   F.max_by("close", "date").alias("last_price"),
                                   F.min("close").alias("price_min"), F.max("close").alias("price_max"))
    pad = (F.col("price_max") - F.col("price_min")) * padding
    return (g.withColumn("price_change_pct", (F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100)
             .withColumn("y_min", F.col("price_min") - pad).withColumn("y_max", F.col("price_max") + pad))

