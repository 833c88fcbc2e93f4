"""End-to-end compositions of the operators (preprocessing as one lazy plan)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dates import weekday0
from ..operators import clean, tickers
from ..schemas import PREPROCESSED_COLUMNS


def preprocess(posts: DataFrame, comments: DataFrame, dim: DataFrame,
               stoplist: DataFrame | None = None, compat: bool = False,
               keep_all_rows: bool = False) -> DataFrame:
    """Raw posts + comments -> ``preprocessed_data`` (one row per mention with tickers).

    Steps: S1/S2 scan -> P1/U1 -> P4 -> X1 -> P7 -> P5 -> P6 -> P8 -> D2/X8 -> W1 ->
    X5 (+J2) -> J3 -> X6 -> P9 -> D3. Shuffles: P6 (by id, map-side combined),
    the W1 group extremes (tiny, broadcast after a size check), the
    candidate re-group of X5 and the narrow parent join of J3.

    ``keep_all_rows`` skips P9 (for coverage reports on rows without tickers).
    """
    u = clean.harmonize(clean.scan_posts(posts), clean.scan_comments(comments))
    u = clean.blank_and_drop_placeholders(u)
    u = clean.merge_title(u)
    u = clean.coerce_types(u)
    u = clean.drop_invalid_texts(u)
    u = clean.dedupe_by_id(u)
    u = clean.drop_columns(u)
    u = clean.add_features(u)
    u = clean.minmax_by_group(u, "score", "subreddit", "normalized_upvotes").drop("score", "upvote_ratio")
    u = tickers.detect_tickers(u, dim, stoplist)
    u = u.withColumn("own_tickers", F.col("mentioned_tickers"))
    u = tickers.inherit_parent_tickers(u)
    u = u.withColumn("sentiment_ready_text", tx.normalize_text("text", "mentioned_tickers", compat=compat))
    if not keep_all_rows:
        u = clean.keep_with_tickers(u)
    return u


def preprocessed_table(df: DataFrame) -> DataFrame:
    """Export shape of ``preprocessed_data``: tickers as CSV (R5), weekday 0=Mon (D3), narrow types."""
    return df.select(
        "id", "sentiment_ready_text", "type", "subreddit", "created_utc",
        F.col("normalized_upvotes").cast("float").alias("normalized_upvotes"),
        tx.ticker_csv("mentioned_tickers").alias("mentioned_tickers"),
        F.col("n_tickers").cast("short").alias("n_tickers"),
        F.col("text_length").cast("int").alias("text_length"),
        F.col("word_count").cast("int").alias("word_count"),
        "date", F.col("hour").cast("byte").alias("hour"),
        weekday0("created_utc").alias("day_of_week"),
    ).select(*PREPROCESSED_COLUMNS)
