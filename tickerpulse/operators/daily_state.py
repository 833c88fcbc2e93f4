"""Mergeable state of the daily table (A1, S13): how often each score comes per ticker and day.

``value_state`` counts rows by (ticker, day, score) with the sums that the daily row needs; counts of two
batches merge by adding them up. ``daily_from_state`` turns counts, merged or not, into the rows of A1:
sums by key, and the exact median from the ranks of the scores, dealt out by ranges so that a hot
symbol's day is spread over tasks. The raw rows are read once and shuffled once, already counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import safe_div
from ..session import materialize

KEYS = ["ticker", "sentiment_date"]
SUMS = ["n", "n_upvotes", "upvotes", "positive_count", "neutral_count", "negative_count"]
STATE_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("sentiment_date", T.DateType()), T.StructField("score", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("n_upvotes", T.LongType()), T.StructField("upvotes", T.DoubleType()),
    T.StructField("positive_count", T.LongType()), T.StructField("neutral_count", T.LongType()), T.StructField("negative_count", T.LongType()),
])


def value_state(results: DataFrame) -> DataFrame:
    """Counts of ``results`` (ticker, sentiment_date, final_sentiment_score, normalized_upvotes, final_sentiment_label)."""
    label = F.col("final_sentiment_label")
    return (results.groupBy(*KEYS, F.col("final_sentiment_score").cast("double").alias("score"))
            .agg(F.count(F.lit(1)).alias("n"), F.count("normalized_upvotes").alias("n_upvotes"),
                 F.sum(F.col("normalized_upvotes").cast("double")).alias("upvotes"),
                 F.count_if(label == "positive").alias("positive_count"), F.count_if(label == "neutral").alias("neutral_count"),
                 F.count_if(label == "negative").alias("negative_count")))


def merge_state(state: DataFrame) -> DataFrame:
    """One row per (ticker, day, score) of counts that may come several times."""
    return state.groupBy(*KEYS, "score").agg(*[F.sum(c).alias(c) for c in SUMS])


def same_key(left: DataFrame, right: DataFrame) -> Column:
    """Null tickers and days are keys too."""
    return left["ticker"].eqNullSafe(right["ticker"]) & left["sentiment_date"].eqNullSafe(right["sentiment_date"])


def daily_from_state(state: DataFrame, merged: bool = False) -> DataFrame:
    """A1's rows from counts (``merged``: a score comes once per ticker and day already).

    STDDEV is 0 for a single score and null without one; sums over no upvotes are null.
    """
    own = state if merged else merge_state(state)
    dealt = materialize(own.repartitionByRange(*KEYS, "score").withColumn("_part", F.spark_partition_id()))
    scored = F.when(F.col("score").isNotNull(), F.col("n")).otherwise(0)
    totals = {c: F.sum(c) for c in SUMS} | {
        "n_scores": F.sum(scored), "score_sum": F.sum(F.col("n") * F.col("score")), "weighted": F.sum(F.col("score") * F.col("upvotes"))}
    parts = dealt.groupBy(*KEYS, "_part").agg(*[v.alias(k) for k, v in totals.items()])  # one row per key and range
    key = Window.partitionBy(*KEYS)
    before = key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("_part").alias("_of"), F.coalesce(F.sum("n_scores").over(before), F.lit(0)).alias("_base"),
                         *[F.sum(c).over(key).alias(f"all_{c}") for c in totals])
    running = Window.partitionBy(*KEYS, "_part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_part") == F.col("_of")
    for k in KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = dealt.withColumn("_scored", scored).withColumn("_upto", F.sum("_scored").over(running)).join(parts, same)
    last = F.col("_base") + F.col("_upto") - 1  # rank (from 0) of the score's last copy
    middle = (F.col("all_n_scores") - 1) / 2
    off = F.col("score") - safe_div("all_score_sum", "all_n_scores")
    picks = [F.max(F.when(rank.between(last - F.col("_scored") + 1, last), F.col("score"))).alias(name)
             for rank, name in ((F.floor(middle), "_low"), (F.ceil(middle), "_high"))]
    near = placed.groupBy(*KEYS).agg(*picks, F.sum(F.col("_scored") * off * off).alias("_squares"),
                                     *[F.max(f"all_{c}").alias(f"all_{c}") for c in totals])
    count, upvotes = F.col("all_n_scores"), F.col("all_upvotes")
    std = F.when(count == 1, F.lit(0.0)).when(count > 1, F.sqrt(F.col("_squares") / (count - 1)))
    return near.select(
        *KEYS, safe_div("all_score_sum", "all_n_scores").alias("sentiment_mean"),
        F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.col("_low") + F.col("_high")) / 2).alias("sentiment_median"),
        std.alias("sentiment_std"), F.col("all_n").alias("mentions"), upvotes.alias("total_upvotes"),
        safe_div("all_upvotes", "all_n_upvotes").alias("avg_upvotes"), safe_div("all_weighted", "all_upvotes").alias("weighted_sentiment"),
        F.col("all_positive_count").alias("positive_count"), F.col("all_neutral_count").alias("neutral_count"),
        F.col("all_negative_count").alias("negative_count"))
