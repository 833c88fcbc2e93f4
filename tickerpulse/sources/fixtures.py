"""Stand-in inputs built from the test tables (FIXTURES.md part 2).

Each builder only maps test-table rows onto the schema a pipeline stage
expects; none of them does any of the stage's work. The DuckDB twins of these
builders live in :mod:`tickerpulse.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SENTIMENT_RESULTS_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol(c) -> F.Column:
    """16 symbols; S0 is hot and holds over a third of all rows."""
    return F.concat(F.lit("S"), F.when(F.col(c) % 3 == 0, 0).otherwise(F.col(c) % 16).cast("string"))


def sentiment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: one scored mention per ``lineitem`` row (schema of ``sentiment_results``)."""
    li = table(spark, sf_dir, "lineitem")
    disc = F.col("l_discount")
    return li.select(
        _symbol("l_suppkey").alias("ticker"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("created_utc"),
        ((disc - 0.05) / 0.05).alias("final_sentiment_score"),
        (F.col("l_quantity") / 50.0).alias("normalized_upvotes"),
        F.when(disc > 0.055, "positive").when(disc < 0.045, "negative")
         .otherwise("neutral").alias("final_sentiment_label"),
        F.lit("fixture").alias("source_model"),
        F.lit(None).cast("double").alias("tw_confidence"),
        F.col("l_returnflag").alias("subreddit"),
        F.lit("post").alias("type"),
        F.lit(None).cast("int").alias("text_length"),
        F.lit(None).cast("int").alias("word_count"),
    ).select(*SENTIMENT_RESULTS_COLUMNS)


def price_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily OHLCV bars per symbol from ``lineitem`` prices.

    open/close are the first/last price in a fixed row order of the day,
    high/low the max/min price, volume the summed quantity.
    """
    li = table(spark, sf_dir, "lineitem")
    # bounded: 100 plus or minus ten per cent, so no series can run to zero
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    price = F.lit(90.0) + F.pmod(unit, F.lit(20.0))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_extendedprice", "l_quantity")
    return (li.select(_symbol("l_suppkey").alias("ticker"),
                      F.to_date(F.col("l_shipdate")).alias("date"),
                      price.alias("price"), order.alias("k"), F.col("l_quantity"))
              .groupBy("ticker", "date")
              .agg(F.min_by("price", "k").alias("open"),
                   F.max("price").alias("high"),
                   F.min("price").alias("low"),
                   F.max_by("price", "k").alias("close"),
                   F.sum("l_quantity").alias("volume")))


BENCHMARK_SYMBOLS = ("S0", "S1", "S2")


def sparse_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a sparse mention stream from ``events`` (gap days, zero-upvote days)."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_utc"),
        F.least(F.col("value") / 50.0 - 1.0, F.lit(1.0)).alias("final_sentiment_score"),
        (k / 100.0).alias("normalized_upvotes"),
        F.lit("neutral").alias("final_sentiment_label"),
        F.lit("fixture").alias("source_model"),
        F.lit(None).cast("double").alias("tw_confidence"),
        F.col("event_type").alias("subreddit"),
        F.lit("comment").alias("type"),
        F.lit(None).cast("int").alias("text_length"),
        F.lit(None).cast("int").alias("word_count"),
    ).select(*SENTIMENT_RESULTS_COLUMNS)


# ------------------------------------------------------------------ F1
# Fixed fixture values: the ticker dimension and ticker stop-list of F1.
F1_TICKERS = ("CI", "DER", "DER-A", "QUE", "OU", "EN", "LA", "SS", "LE", "THE", "OF", "TO", "IN")
F1_STOPLIST = ("US", "in", "SS", "ss", "EUR")


def ticker_dim(spark: SparkSession) -> DataFrame:
    """F1 ticker dimension (ticker, company_name, exchange)."""
    rows = [(t, f"{t} Holdings", "NASDAQ" if i % 2 == 0 else "NYSE") for i, t in enumerate(F1_TICKERS)]
    return spark.createDataFrame(rows, "ticker string, company_name string, exchange string")


def ticker_stoplist(spark: SparkSession) -> DataFrame:
    """F1 stop-list as read from ``{"stopwords": [...]}`` (one ``word`` column)."""
    return spark.createDataFrame([(w,) for w in F1_STOPLIST], "word string")


def _f1_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") * 3 + F.col("turn")) % 8
    t = F.col("text")
    body = (F.when(k == 0, F.lit("[removed]"))
             .when(k == 1, F.concat(t, F.lit(" $CI ")))
             .when(k == 2, F.concat(t, F.lit(" DER.A QUE ")))
             .when(k == 3, F.concat(t, F.lit(" https://ex.com/x ")))
             .when(k == 4, F.concat(t, F.lit(" [link](https://ex.com) ")))
             .when(k == 5, F.lit("short"))
             .when(k == 6, F.lit(None).cast("string"))
             .otherwise(t))
    return conv.select(
        "conv_id", "turn", F.col("role").alias("author"), body.alias("body"),
        (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("long").alias("created_utc"),
        # some scores are no numbers: they count as 0
        F.when(F.col("conv_id") % 7 == 3, "NaN").when(F.col("conv_id") % 7 == 5, "inf").when(F.col("conv_id") % 7 == 6, "n/a")
         .otherwise((F.length(t) % 500).cast("string")).alias("score"),
        F.concat(F.lit("r"), (F.col("conv_id") % 5).cast("string")).alias("subreddit"))


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 posts: turn 0 of each conversation (historical_posts schema)."""
    b = _f1_base(spark, sf_dir).filter(F.col("turn") == 0)
    return b.select("author", F.substring("body", 1, 40).alias("title"), "created_utc",
                    F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"),
                    F.lit(1).alias("is_original_content"), "score", "body", "subreddit",
                    F.when(F.col("conv_id") % 10 == 7, "NaN").otherwise(((F.col("conv_id") % 10) / 10.0).cast("string"))
                     .alias("upvote_ratio"),
                    F.lit(None).cast("string").alias("url"))


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 comments: turns > 0, plus a later second copy of every comment of conv_id % 10 = 0."""
    b = _f1_base(spark, sf_dir).filter(F.col("turn") > 0)
    c = b.select("author", "created_utc",
                 F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"),
                          F.col("turn").cast("string")).alias("id"),
                 F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("parent_post_id"),
                 "score", "body", "subreddit", "conv_id")
    dup = c.filter(F.col("conv_id") % 10 == 0).withColumn("created_utc", F.col("created_utc") + 30)
    return c.unionByName(dup).drop("conv_id")


# ------------------------------------------------------------------ F5
N_MODELS = 4
# Fixed fixture values: generative-model answers by vec_id % 12.
F5_RESPONSES = (
    '{"sentiment": "Positive", "score": 0.8}',
    'Sure. Here is my answer: {"sentiment": "negative", "score": -0.45} Hope it helps.',
    '{"sentiment": "neutral", "score": "0.5"}',
    'Result {"sentiment": "positive", score": -0.7',
    '',
    '{"sentiment": null}',
    "{'sentiment': 'positive', 'score': 0.9}",
    '{"sentiment": "positive", "score": 0.05} and {more}',
    '{"sentiment": 1, "score": 0.3}',
    '{"sentiment": "Negative", "score": true}',
    '{"sentiment": "positive", "score": "NaN"}',
    'My "score": -3 it is',
)
DIMENSIONS = 64


def logits(j: int, element) -> list:
    """The three logits of model ``j``: every element of the vector belongs to one of the
    3 * N_MODELS logits, by its place modulo their number."""
    step = 3 * N_MODELS
    out = []
    for k in range(3):
        own = [element(i) for i in range(DIMENSIONS) if i % step == 3 * j + k]
        total = own[0]
        for x in own[1:]:
            total = total + x
        out.append(total)
    return out


def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per ``embeddings`` row the softmax(8 x) of each model's three logits as
    (p_neg, p_neu, p_pos), a ticker, a date and a model answer."""
    emb = table(spark, sf_dir, "embeddings")
    cols = [F.col("vec_id"),
            F.concat(F.lit("S"), (F.col("vec_id") % 10).cast("string")).alias("ticker"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 30).cast("int")).alias("date")]
    for j in range(N_MODELS):
        e = [F.exp(8 * x) for x in logits(j, lambda i: F.element_at("embedding", i + 1).cast("double"))]
        tot = e[0] + e[1] + e[2]
        for name, x in zip(("p_neg", "p_neu", "p_pos"), e):
            cols.append((x / tot).alias(f"m{j}_{name}"))
    resp = F.element_at(F.array(*[F.lit(r) for r in F5_RESPONSES]), (F.col("vec_id") % 12 + 1).cast("int"))
    cols.append(resp.alias("response"))
    cols.append(F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",").alias("raw_text"))
    return emb.select(*cols).withColumn(
        "created_utc", F.unix_timestamp(F.col("date").cast("timestamp")) + F.col("vec_id"))


def make_fixture_scorer(temperature: float = 8.0):
    """Stand-in batch classifier for the F4 hook: each text is a vector "x1,x2,..." and the
    class probabilities are softmax(temperature * logits of model 0) in (negative, neutral,
    positive) order; the label is the first maximum in that order (M5)."""
    import numpy as np

    def score(texts):
        out = []
        for t in texts:
            vector = [float(v) for v in t.split(",")]
            x = np.array(logits(0, vector.__getitem__), dtype="float64")
            e = np.exp(temperature * x)
            p = e / e.sum()
            probs = {"negative": float(p[0]), "neutral": float(p[1]), "positive": float(p[2])}
            out.append({"label": max(probs, key=probs.get),
                        "score": probs["positive"] - probs["negative"],
                        "p_pos": probs["positive"], "p_neu": probs["neutral"], "p_neg": probs["negative"]})
        return out
    return score
