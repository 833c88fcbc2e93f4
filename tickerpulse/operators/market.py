"""Market-move filter: rolling price metrics (W7-W14), trading-day adjustment
(D4) and the signal-to-bar join (J5).

Every metric only looks backwards, so computing "all metrics on the history up
to the signal date" for each signal equals ONE window pass over the whole bar
table followed by an equi-join on (ticker, date). The pass is partitioned by
ticker (rows per ticker are bounded by trading days) with bounded frames of
at most 20 rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ieee_div, rolling, stable_round
from ..functions.dates import to_trading_day
from ..schemas import FILTERED_SIGNAL_COLUMNS, MARKET_COLUMNS, SIGNAL_COLUMNS


@dataclass(frozen=True)
class MarketParams:
    z_threshold: float = 2.0
    vol_expansion_threshold: float = 1.75
    atr_move_threshold: float = 2.0
    recent_days: int = 5
    min_history: int = 20
    lookback: int = 20
    atr_days: int = 14


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def market_metrics(bars: DataFrame, p: MarketParams = MarketParams()) -> DataFrame:
    """W7-W13 per bar plus the bar's ordinal ``bar_n`` within its ticker.

    returns = close/prev - 1; pct_3d = 3-bar % change; *_z = (x - mean20)/std20
    with 20 full values; vol_expansion = std3/std20 of returns; tr = max of the
    three ranges (NULLs skipped); atr_14 = mean of 14 tr; atr_move = |3-bar move|/atr.
    Ratios with a zero divisor are +-inf like float arithmetic (0/0 is NULL).
    """
    w = Window.partitionBy("ticker").orderBy("date")
    wl = w.rowsBetween(-(p.lookback - 1), 0)
    w3 = w.rowsBetween(-2, 0)
    wa = w.rowsBetween(-(p.atr_days - 1), 0)
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    df = (bars
          .withColumn("bar_n", F.row_number().over(w))
          .withColumn("prev_close", F.lag("close", 1).over(w))
          .withColumn("close_3", F.lag("close", 3).over(w))
          .withColumn("returns", ieee_div(close, "prev_close") - 1)
          .withColumn("pct_3d_series", (ieee_div(close, "close_3") - 1) * 100)
          .withColumn("pct_change_3d", ieee_div(close - F.col("close_3"), "close_3") * 100)
          .withColumn("tr", F.greatest(high - low, F.abs(high - F.col("prev_close")),
                                       F.abs(low - F.col("prev_close")))))

    def zscore(c: str) -> Column:
        return ieee_div(F.col(c) - rolling(F.avg, c, wl, p.lookback), rolling(F.stddev_samp, c, wl, p.lookback))

    return (df.withColumn("pct_3d_z", zscore("pct_3d_series"))
              .withColumn("ret_z", zscore("returns"))
              .withColumn("vol_z", zscore("volume"))
              .withColumn("vol_expansion", ieee_div(rolling(F.stddev_samp, "returns", w3, 3),
                                                    rolling(F.stddev_samp, "returns", wl, p.lookback)))
              .withColumn("atr_14", rolling(F.avg, "tr", wa, p.atr_days))
              .withColumn("atr_move", ieee_div(F.abs(close - F.col("close_3")), "atr_14")))


def moved_flag(p: MarketParams = MarketParams()) -> Column:
    """1 if any of the last ``recent_days`` bars crosses a threshold, else 0."""
    z = _lit(p.z_threshold)
    hit = (F.coalesce(F.abs("pct_3d_z") >= z, F.lit(False))
           | F.coalesce(F.abs("ret_z") >= z, F.lit(False))
           | F.coalesce(F.abs("vol_z") >= z, F.lit(False))
           | F.coalesce(F.col("vol_expansion") >= _lit(p.vol_expansion_threshold), F.lit(False))
           | F.coalesce(F.col("atr_move") >= _lit(p.atr_move_threshold), F.lit(False)))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(p.recent_days - 1), 0)
    return F.max(hit.cast("int")).over(w)


def market_state(bars: DataFrame, p: MarketParams = MarketParams()) -> DataFrame:
    """Bars with metrics, ``market_moved_flag`` and ``checkable`` (>= min_history bars)."""
    m = market_metrics(bars, p)
    return (m.withColumn("market_moved_flag", moved_flag(p))
             .withColumn("checkable", F.col("bar_n") >= p.min_history))


def filter_unmoved(signals: DataFrame, bars: DataFrame, p: MarketParams = MarketParams(),
                   adjust_weekends: bool = True, report_scale: int | None = 2) -> DataFrame:
    """Keep signals whose (adjusted) date has a bar, >= min_history bars of
    history, and no market move in the last ``recent_days`` bars.

    Weekend signal dates are moved to the previous Friday (D4) when
    ``adjust_weekends``; the signal keeps its own date. Reported metrics are
    rounded to ``report_scale`` places (M13), as stored by the reference.
    """
    state = market_state(bars, p).select(
        "ticker", F.col("date").alias("_bar_date"), *MARKET_COLUMNS, "market_moved_flag", "checkable")
    target = to_trading_day("signal_date") if adjust_weekends else F.col("signal_date")
    sig = signals.withColumn("_target", target)
    joined = sig.join(state, (sig["ticker"] == state["ticker"]) & (sig["_target"] == state["_bar_date"]), "inner")
    kept = joined.filter(F.col("checkable") & (F.col("market_moved_flag") == 0))
    out = [sig[c] for c in SIGNAL_COLUMNS]
    out.append(F.date_format("_target", "yyyy-MM-dd").alias("target_date"))
    for c in MARKET_COLUMNS:
        out.append((stable_round(c, report_scale) if report_scale is not None else F.col(c)).alias(c))
    out.append(F.col("market_moved_flag").cast("int").alias("market_moved_flag"))
    return kept.select(*out)


def charting_window(bars: DataFrame, anchors: DataFrame, window_bars: int = 40,
                    p: MarketParams = MarketParams()) -> DataFrame:
    """Metrics recomputed on the last ``window_bars`` bars up to each anchor
    (ticker, target_date), so early z values in the slice are NULL, plus the
    triggered flags of the last ``recent_days`` bars.

    Each anchor's slice is formed by an equi-join on ticker of the anchor with
    bar ordinals in (n - window_bars, n]; one anchor meets at most
    ``window_bars`` bars, so the join output is bounded by anchors x 40.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    numbered = bars.withColumn("bar_n", F.row_number().over(w))
    a = (anchors.join(numbered.select("ticker", F.col("date").alias("target_date"),
                                      F.col("bar_n").alias("anchor_n")), ["ticker", "target_date"])
                .withColumn("k", F.explode(F.sequence(F.greatest(F.col("anchor_n") - window_bars + 1, F.lit(1)),
                                                      F.col("anchor_n")))))
    sliced = (a.join(numbered.withColumnRenamed("bar_n", "k"), ["ticker", "k"])
               .withColumn("slice", F.concat_ws("|", "ticker", F.col("target_date").cast("string"))))
    m = market_metrics(sliced.drop("bar_n").select("slice", "ticker", "target_date", "date", "open", "high",
                                                  "low", "close", "volume")
                             .withColumnRenamed("ticker", "_t").withColumnRenamed("slice", "ticker"), p)
    recent = F.col("bar_n") > F.max("bar_n").over(Window.partitionBy("ticker")) - p.recent_days
    z = p.z_threshold
    return (m.withColumn("is_recent", recent)
             .withColumn("trig_pct_3d_z", recent & (F.abs("pct_3d_z") >= z))
             .withColumn("trig_ret_z", recent & (F.abs("ret_z") >= z))
             .withColumn("trig_vol_z", recent & (F.abs("vol_z") >= z))
             .withColumn("trig_vol_expansion", recent & (F.col("vol_expansion") >= p.vol_expansion_threshold))
             .withColumn("trig_atr_move", recent & (F.col("atr_move") >= p.atr_move_threshold))
             .drop("ticker").withColumnRenamed("_t", "ticker"))
