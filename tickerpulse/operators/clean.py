"""Mention cleaning: schema harmonisation (P1, U1), placeholders (P2-P4),
validity (P5), de-duplication (P6), type coercion (P7), column drops (P8),
final row filter (P9), per-subreddit normalisation (W1) and features (D2, D3, X8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import nan_to_null
from ..functions.dates import temporal_features

EPOCH_RANGE = (-62135596800, 253402300799)  # years 1 to 9999
POST_RENAME = {"body": "text"}
COMMENT_RENAME = {"body": "text"}
OPTIONAL_COLUMNS = ("author", "url", "parent_post_id", "is_original_content", "upvote_ratio", "title")


def scan_posts(df: DataFrame) -> DataFrame:
    """The post columns; whole bodies."""
    cols = ["author", "title", "created_utc", "id", "is_original_content", "score", "body",
            "subreddit", "upvote_ratio", "url"]
    return df.select(*cols)


def scan_comments(df: DataFrame) -> DataFrame:
    """The comment columns; whole bodies."""
    cols = ["author", "created_utc", "id", "parent_post_id", "score", "body", "subreddit"]
    return df.select(*cols)


def harmonize(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """P1 + U1: lower-case names, body -> text, missing columns NULL, ``type`` tag, union by name."""
    def prep(df, rename, kind):
        df = df.toDF(*[c.lower() for c in df.columns])
        for a, b in rename.items():
            if a in df.columns:
                df = df.withColumnRenamed(a, b)
        for c in OPTIONAL_COLUMNS:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        return df.withColumn("type", F.lit(kind))
    return prep(posts, POST_RENAME, "post").unionByName(prep(comments, COMMENT_RENAME, "comment"),
                                                       allowMissingColumns=True)


def placeholder_only(df: DataFrame) -> F.Column:
    """P3 predicate: post with title AND text placeholders, or comment with a placeholder text."""
    return (((F.col("type") == "post") & tx.is_placeholder("title") & tx.is_placeholder("text"))
            | ((F.col("type") == "comment") & tx.is_placeholder("text")))


def placeholder_report(df: DataFrame) -> DataFrame:
    """Placeholder-only rows by type (type, rows, placeholder_only)."""
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("rows"),
                                  F.count_if(placeholder_only(df)).alias("placeholder_only"))


def blank_and_drop_placeholders(df: DataFrame) -> DataFrame:
    """Placeholders -> '' (others stripped); drop posts with both parts empty and empty comments."""
    df = df.withColumn("title", tx.blank_placeholder("title")).withColumn("text", tx.blank_placeholder("text"))
    # keep = NOT (post with both parts empty OR comment with empty text)
    return df.filter((F.col("text") != "") | ((F.col("type") == "post") & (F.col("title") != "")))


def merge_title(df: DataFrame) -> DataFrame:
    """Fold the title into ``text`` for posts, then drop ``title``."""
    return df.withColumn("text", tx.merge_title_body("type", "title", "text")).drop("title")


def drop_invalid_texts(df: DataFrame, min_len: int = tx.MIN_TEXT_LENGTH) -> DataFrame:
    """P5."""
    return df.filter(tx.is_valid_text("text", min_len))


def dedupe_by_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per id, the first in source order (posts before comments, newest first).

    Implemented as an aggregation, not a window: ``min_by(row, order)`` is
    combined map-side, so an id with millions of copies is collapsed before
    the shuffle instead of landing whole in one task. A 128-bit hash of the remaining
    columns breaks ties, which makes the pick deterministic without a second copy of the text.
    """
    others = [c for c in df.columns if c != id_col]
    order = F.struct(F.when(F.col("type") == "post", 0).otherwise(1).alias("_t"),
                     (-F.col("created_utc").cast("double")).alias("_c"),
                     F.xxhash64(*others).alias("_h1"), F.xxhash64(F.lit(1), *others).alias("_h2"))
    row = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(id_col).agg(F.min_by(row, order).alias("_r"))
              .select(id_col, *[F.col(f"_r.{c}").alias(c) for c in others]))


def coerce_types(df: DataFrame) -> DataFrame:
    """created_utc -> timestamp (epoch seconds within years 1 to 9999, or a date-time
    string; bad -> NULL); score -> integer (bad, NaN and infinite -> 0); upvote_ratio ->
    double (bad, NaN and infinite -> NULL)."""
    raw = F.col("created_utc").cast("string")
    epoch = raw.try_cast("double")
    ts = F.coalesce(F.timestamp_seconds(F.when(epoch.between(*EPOCH_RANGE), epoch)), F.try_to_timestamp(raw))
    out = df.withColumn("created_utc", ts)
    if "score" in df.columns:
        score = F.col("score").cast("string").try_cast("double").try_cast("bigint")
        out = out.withColumn("score", F.coalesce(score, F.lit(0)))
    if "upvote_ratio" in df.columns:
        out = out.withColumn("upvote_ratio", nan_to_null(F.col("upvote_ratio").cast("string").try_cast("double")))
    return out


def drop_columns(df: DataFrame, cols=("url", "is_original_content", "author")) -> DataFrame:
    """P8."""
    return df.drop(*[c for c in cols if c in df.columns])


def add_features(df: DataFrame) -> DataFrame:
    """D2 + X8: date, hour, day name, month, weekend flag, text length, word count."""
    feats = temporal_features("created_utc")
    out = df
    for k in ("date", "hour", "month", "is_weekend"):
        out = out.withColumn(k, feats[k])
    out = out.withColumn("day_of_week", feats["day_name"])
    return (out.withColumn("text_length", tx.text_length("text"))
               .withColumn("word_count", tx.word_count("text")))


def minmax_by_group(df: DataFrame, value: str = "score", group: str = "subreddit",
                    out: str = "normalized_upvotes", eps: float = 1e-6) -> DataFrame:
    """(x - min) / (max - min + eps) within each group; NULL group -> NULL.

    Group extremes come from a map-side-combined aggregation (one row per
    group) joined back, rather than a window: a group holding a third of all
    rows would otherwise be one task. The join strategy is left to AQE, which
    measures the aggregated side at runtime and broadcasts it only under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold`` (else a shuffle join,
    whose hot keys the skew-join rule splits). An explicit pre-count here
    would run the whole upstream twice.
    """
    stats = (df.filter(F.col(group).isNotNull())
               .groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    j = df.join(stats, group, "left")
    val = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(eps))
    return j.withColumn(out, val.cast("double")).drop("_lo", "_hi")


def keep_with_tickers(df: DataFrame, text_col: str = "sentiment_ready_text") -> DataFrame:
    """At least one ticker and a non-empty text."""
    return df.filter((F.size("mentioned_tickers") > 0) & F.col(text_col).isNotNull() & (F.col(text_col) != ""))
