"""Daily sentiment per ticker (A1, A2, A3) and the gap-filled calendar.

Scale notes: the group-by keys are (ticker, day), so Spark's partial
aggregation collapses a hot ticker map-side before the shuffle; after it a
ticker has at most one row per calendar day. Medians are exact and counted by
ranges of scores (``daily_state.py``, one scan and one shuffle of the raw rows, for A1;
``quantiles.py`` for A2); ``approx_median=True`` uses a sketch instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.dates import epoch_to_date
from ..session import materialize
from .daily_state import daily_from_state, value_state
from .quantiles import grouped_quantiles


def _medians(df: DataFrame, day: str) -> DataFrame:
    """``ticker, day, sentiment_median``: exact, by ranges of scores, so a hot symbol's day is spread over tasks."""
    q = grouped_quantiles(df, ["ticker", day], "final_sentiment_score", [0.5])
    return q.select(F.col("ticker").alias("_t"), F.col(day).alias("_d"), F.col("q")[0].alias("sentiment_median"))


def _with_median(agg: DataFrame, df: DataFrame, day: str, approx: bool) -> DataFrame:
    """``agg`` with ``sentiment_median`` (already there when ``approx``)."""
    if approx:
        return agg
    m = _medians(df, day)
    return agg.join(m, agg["ticker"].eqNullSafe(m["_t"]) & agg[day].eqNullSafe(m["_d"]), "left").drop("_t", "_d")


def with_sentiment_date(results: DataFrame, start_date: str | None = None,
                        end_date: str | None = None, ticker: str | None = None) -> DataFrame:
    """D1 plus the optional ticker / from / to filters of S12/S13."""
    df = results.withColumn("sentiment_date", epoch_to_date("created_utc"))
    if ticker is not None:
        df = df.filter(F.col("ticker") == ticker)
    if start_date is not None:
        df = df.filter(F.col("sentiment_date") >= F.to_date(F.lit(start_date)))
    if end_date is not None:
        df = df.filter(F.col("sentiment_date") <= F.to_date(F.lit(end_date)))
    return df


def daily_sentiment_sql(results: DataFrame, start_date: str | None = None,
                        end_date: str | None = None, ticker: str | None = None,
                        approx_median: bool = False, with_median: bool = True) -> DataFrame:
    """A1: the canonical ``sentiment_daily`` table, one row per (ticker, UTC day).

    STDDEV follows the database convention: 0 for a single value (Spark's
    ``stddev_samp`` alone gives NULL there). ``with_median=False`` leaves that column NULL
    for callers that do not read it.
    """
    s, u = F.col("final_sentiment_score"), F.col("normalized_upvotes")
    lab = F.col("final_sentiment_label")
    df = with_sentiment_date(results, start_date, end_date, ticker)
    if with_median and not approx_median:
        return daily_from_state(value_state(df), merged=True)
    sketch = [F.percentile_approx(s, 0.5, 10000).alias("sentiment_median")] if approx_median else []
    agg = (df.groupBy("ticker", "sentiment_date")
              .agg(F.avg(s).alias("sentiment_mean"), *sketch,
                   F.when(F.count(s) == 1, F.lit(0.0)).otherwise(F.stddev_samp(s)).alias("sentiment_std"),
                   F.count(F.lit(1)).alias("mentions"),
                   F.sum(u).alias("total_upvotes"),
                   F.avg(u).alias("avg_upvotes"),
                   safe_div(F.sum(s * u), F.sum(u)).alias("weighted_sentiment"),
                   F.count_if(lab == "positive").alias("positive_count"),
                   F.count_if(lab == "neutral").alias("neutral_count"),
                   F.count_if(lab == "negative").alias("negative_count")))
    out = agg if approx_median else agg.withColumn("sentiment_median", F.lit(None).cast("double"))
    return out.select("ticker", "sentiment_date", "sentiment_mean", "sentiment_median", "sentiment_std", "mentions",
                      "total_upvotes", "avg_upvotes", "weighted_sentiment", "positive_count", "neutral_count", "negative_count")


def daily_sentiment_weighted(results: DataFrame, approx_median: bool = False, all_medians: bool = True) -> DataFrame:
    """A2: upvote-weighted daily mean; a day whose upvotes sum to 0 takes the median.

    Output: ticker, date, sentiment_mean, total_upvotes, sentiment_median, mentions
    (mentions counts non-null scores). ``all_medians=False`` computes medians only for the
    days that need one (NULL elsewhere): what the shock rule uses.
    """
    s, u = F.col("final_sentiment_score"), F.col("normalized_upvotes")
    df = (results.withColumn("date", epoch_to_date("created_utc"))
                 .filter(F.col("ticker").isNotNull() & F.col("date").isNotNull()))
    sketch = [F.percentile_approx(s, 0.5, 10000).alias("sentiment_median")] if approx_median else []
    agg = (df.groupBy("ticker", "date")
             .agg(F.sum(s * u).alias("_su"),
                  F.coalesce(F.sum(u), F.lit(0.0)).alias("total_upvotes"), *sketch,
                  F.count(s).alias("mentions")))
    if not all_medians and not approx_median:
        agg = materialize(agg)  # one row per ticker and day
        zero = agg.filter(F.col("total_upvotes") == 0).select("ticker", "date")
        df = df.join(zero, ["ticker", "date"], "left_semi")
        if zero.isEmpty():
            df = df.limit(0)
    out = _with_median(agg, df, "date", approx_median)
    mean = (F.when(F.col("total_upvotes") == 0, F.col("sentiment_median"))
             .otherwise(safe_div("_su", "total_upvotes")))
    return out.select("ticker", "date", mean.alias("sentiment_mean"), "total_upvotes",
                      "sentiment_median", "mentions")


def gap_fill_calendar(daily: DataFrame, key: str = "ticker", date_col: str = "date",
                      fill_zero: tuple[str, ...] = ("mentions",)) -> DataFrame:
    """One row per key and calendar day between its first and last day.

    Instead of joining a generated calendar back to the data (a second shuffle),
    each data row emits itself plus the empty days up to the next data row
    (``lead`` over the key's ordered rows, then ``posexplode``). Gap days carry
    0 in ``fill_zero`` columns and NULL elsewhere. The only shuffle is the one by
    ``key`` that the following windows reuse; rows per key are bounded by days.
    """
    w = Window.partitionBy(key).orderBy(date_col)
    nxt = F.lead(date_col).over(w)
    last_day = F.coalesce(F.date_sub(nxt, 1), F.col(date_col))
    exploded = (daily.withColumn("_days", F.sequence(F.col(date_col), last_day))
                     .select("*", F.posexplode("_days").alias("_pos", "_day")))
    value_cols = [c for c in daily.columns if c not in (key, date_col)]
    out = [F.col(key), F.col("_day").alias(date_col)]
    for c in value_cols:
        if c in fill_zero:
            out.append(F.when(F.col("_pos") == 0, F.col(c)).otherwise(F.lit(0)).cast(
                daily.schema[c].dataType).alias(c))
        else:
            out.append(F.when(F.col("_pos") == 0, F.col(c)).alias(c))
    return exploded.select(*out)
