"""Sentiment shocks: 3-day window (W2), 30-day baseline (W3), z-score (W4),
dynamic threshold (M1) and the BUY/SELL rule (M2, M3).

Physical plan: one hash shuffle by ticker (inside :func:`gap_fill_calendar`),
then every window below shares that partitioning and sort order, so the whole
stage runs without another exchange. Frames are bounded (3 and 30 rows) and a
ticker has at most one row per calendar day, so a hot ticker costs days, not
mentions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rolling, safe_div
from ..schemas import SIGNAL_COLUMNS
from .daily import daily_sentiment_weighted, gap_fill_calendar


@dataclass(frozen=True)
class ShockParams:
    window_days: int = 3
    baseline_days: int = 30
    min_baseline_days: int = 15
    min_mentions: float = 5
    base_z_threshold: float = 2.0
    min_abs_sent_change: float = 0.1
    mention_sensitivity: float = 0.2
    bullish_bias: float = 0.0


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def shock_windows(daily: DataFrame, p: ShockParams = ShockParams()) -> DataFrame:
    """J4 + W2 + W3 + W4 + M1 on the weighted daily table (A2 output).

    Adds window_sentiment, window_mentions, baseline_mean, baseline_std,
    z_score, z_threshold, abs_sent_change for every calendar day of a ticker.
    """
    filled = gap_fill_calendar(daily, "ticker", "date", fill_zero=("mentions",))
    w = Window.partitionBy("ticker").orderBy("date")
    w_short = w.rowsBetween(-(p.window_days - 1), 0)
    w_base = w.rowsBetween(-(p.baseline_days - 1), 0)
    roll_m = F.sum("mentions").over(w_short)
    roll_s = F.sum(F.col("sentiment_mean") * F.col("mentions")).over(w_short)
    df = (filled
          .withColumn("window_mentions", roll_m.cast("double"))
          .withColumn("window_sentiment", safe_div(roll_s, F.nullif(roll_m.cast("double"), F.lit(0.0))))
          .withColumn("baseline_mean", rolling(F.avg, "window_sentiment", w_base, p.min_baseline_days))
          .withColumn("baseline_std", rolling(F.stddev_samp, "window_sentiment", w_base, p.min_baseline_days)))
    diff = F.col("window_sentiment") - F.col("baseline_mean")
    thr = _lit(p.base_z_threshold) / (1 + _lit(p.mention_sensitivity)
                                      * F.log1p(F.greatest(F.col("window_mentions"), F.lit(1.0))))
    return (df.withColumn("z_score", safe_div(diff, "baseline_std"))
              .withColumn("z_threshold", thr)
              .withColumn("abs_sent_change", F.abs(diff)))


def signal_rule(p: ShockParams = ShockParams()) -> tuple[Column, Column]:
    """M2/M3: (signal_type, signal_direction) columns; 'NONE' / NULL when no signal.

    ``baseline_std > 0`` is required in both variants (a zero std yields no
    finite z either way).
    """
    base = (F.col("baseline_std").isNotNull() & (F.col("baseline_std") > 0)
            & F.col("window_sentiment").isNotNull()
            & (F.col("window_mentions") >= _lit(p.min_mentions))
            & (F.col("abs_sent_change") >= _lit(p.min_abs_sent_change)))
    buy_thr = F.col("z_threshold") - _lit(p.bullish_bias)
    sell_thr = F.col("z_threshold") + _lit(p.bullish_bias)
    buy = base & (F.col("z_score") >= buy_thr) & (F.col("window_sentiment") > 0)
    sell = base & (F.col("z_score") <= -sell_thr) & (F.col("window_sentiment") < 0)
    stype = F.when(buy, "BUY").when(sell, "SELL").otherwise("NONE")
    sdir = F.when(buy, F.lit(1)).when(sell, F.lit(-1))
    return stype, sdir


def with_signals(windows: DataFrame, p: ShockParams = ShockParams()) -> DataFrame:
    stype, sdir = signal_rule(p)
    return (windows.withColumn("signal_type", stype)
                   .withColumn("signal_direction", sdir)
                   .withColumn("signal_score", F.when(sdir.isNotNull(), F.col("z_score"))))


def shock_signals(results: DataFrame, p: ShockParams = ShockParams(),
                  approx_median: bool = False) -> DataFrame:
    """Flagship: sentiment_results -> sentiment_signals (BUY/SELL rows, 12 columns)."""
    daily = daily_sentiment_weighted(results, approx_median=approx_median, all_medians=False)
    sig = with_signals(shock_windows(daily, p), p)
    return (sig.filter(F.col("signal_type") != "NONE")
               .withColumnRenamed("date", "signal_date")
               .select(*SIGNAL_COLUMNS))
