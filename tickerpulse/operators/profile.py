"""Data-profile reports (A10-A23, O3): column statistics, distributions and
breakdowns. Every report is one grouped pass (or a few) over the input; wide
per-column results are unpivoted with ``stack`` into long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..session import materialize
from .quantiles import grouped_quantiles


def _stack(df_one_row: DataFrame, names: list[str], value_cols: list[str], label: str = "column") -> DataFrame:
    """Unpivot one wide row: ``names[i]`` -> the values ``{name}__{v}`` for v in value_cols."""
    parts = []
    for n in names:
        parts.append(f"'{n}'")
        parts.extend(f"`{n}__{v}`" for v in value_cols)
    expr = f"stack({len(names)}, {', '.join(parts)}) as ({label}, {', '.join(value_cols)})"
    return df_one_row.selectExpr(expr)


def distinct_counts(df: DataFrame) -> DataFrame:
    """Number of distinct non-null values per column.

    One pass: each row gives one narrow (column, 128-bit hash) pair per column, which are
    made distinct before and after a single shuffle; no text is shuffled.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("present"),
                                         F.xxhash64(F.col(c)).alias("h1"), F.xxhash64(F.lit(1), F.col(c)).alias("h2"))
                                for c in df.columns]))
    seen = df.select(pairs.alias("p")).select("p.*").distinct()
    return seen.groupBy("column").agg(F.count_if("present").alias("n_unique"))


def missingness(df: DataFrame) -> DataFrame:
    """NULL count and share (%) per column, only columns with NULLs; one pass."""
    total = F.count(F.lit(1))
    one = df.agg(*[x for c in df.columns for x in (
        F.count_if(F.col(c).isNull()).alias(f"{c}__missing"),
        F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, total).alias(f"{c}__pct"))])
    return _stack(one, df.columns, ["missing", "pct"]).filter(F.col("missing") > 0)


def word_stats(df: DataFrame, text: str = "text", short_len: int = 10) -> DataFrame:
    """Word counts (mean, median, min, max) of non-empty texts, per type and
    overall, and the share (%) of texts of at most ``short_len`` characters; from one pass that counts
    texts by type and number of words."""
    words = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).groupBy("type", word_count(text).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length(text) <= short_len).alias("short"))  # a row per type and word count
    scopes = F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col("type").alias("scope")), F.struct(F.lit(True).alias("all"), F.lit("all").alias("scope"))))
    own = words.withColumn("s", scopes).groupBy("s", "w").agg(F.sum("n").alias("n"), F.sum("short").alias("short"))
    scope = Window.partitionBy("s")
    ranked = own.withColumn("last", F.sum("n").over(scope.orderBy("w")) - 1).withColumn("middle", (F.sum("n").over(scope) - 1) / 2)
    at = lambda rank: F.max(F.when(rank.between(F.col("last") - F.col("n") + 1, F.col("last")), F.col("w")))
    return ranked.groupBy("s").agg(
        F.sum("n").alias("texts"), (F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("mean_words"),
        ((at(F.floor("middle")) + at(F.ceil("middle"))) / 2).alias("median_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"),
        (F.sum("short") / F.sum("n") * 100).alias("short_pct")).select(F.col("s.scope").alias("scope"), "texts", "mean_words", "median_words",
                                                                       "min_words", "max_words", "short_pct")


def activity(df: DataFrame, ts: str = "created_utc") -> DataFrame:
    """Row counts for all 7 weekdays (0 = Monday) and all 24 hours, zeros kept; one pass."""
    slots = df.groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))  # 7 x 24 rows
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("weekday", "hour")]))
    counts = slots.select(each.alias("s"), "n").groupBy("s.dimension", "s.value").agg(F.sum("n").alias("n"))
    spine = df.sparkSession.range(31).select(F.when(F.col("id") < 7, "weekday").otherwise("hour").alias("dimension"),
                                             F.when(F.col("id") < 7, F.col("id")).otherwise(F.col("id") - 7).cast("int").alias("value"))
    return spine.join(counts, ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))


def dates_ids_ratios(df: DataFrame, ts: str = "created_utc", id_col: str = "id", ratio: str = "upvote_ratio") -> DataFrame:
    """A17 + A18 + A19 in two passes: first and last day and span; rows, distinct ids and duplicates;
    mean and median upvote ratio of posts. Rows are first folded per id, so the distinct
    count needs no second expansion."""
    post_ratio = F.when(F.col("type") == "post", F.col(ratio))
    per_id = df.groupBy(id_col).agg(
        F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi"), F.count(F.lit(1)).alias("n"),
        F.sum(post_ratio).alias("s"), F.count(post_ratio).alias("k"))
    ids = F.count(id_col)  # a NULL id is no id
    one = per_id.agg(F.min("lo").alias("first_date"), F.max("hi").alias("last_date"),
                     F.datediff(F.max("hi"), F.min("lo")).alias("span_days"), F.sum("n").alias("total"), ids.alias("unique_ids"),
                     (F.sum("n") - ids).alias("duplicates"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean_ratio"))
    q = grouped_quantiles(df.filter(F.col("type") == "post").withColumn("_all_rows", F.lit(1)), ["_all_rows"], ratio, [0.5])
    return one.select("*", q.select(F.col("q")[0]).scalar().alias("median_ratio"))


def ticker_coverage(df: DataFrame, before: str = "own_tickers", after: str = "mentioned_tickers") -> DataFrame:
    """Rows with tickers per type before / after inheritance, gained rows and shares (%)."""
    return (df.groupBy("type").agg(F.count(F.lit(1)).alias("rows"),
                                   F.count_if(F.size(before) > 0).alias("with_tickers_before"),
                                   F.count_if(F.size(after) > 0).alias("with_tickers_after"))
              .withColumn("gained", F.col("with_tickers_after") - F.col("with_tickers_before"))
              .withColumn("pct_before", F.col("with_tickers_before") / F.col("rows") * 100)
              .withColumn("pct_after", F.col("with_tickers_after") / F.col("rows") * 100))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, std, min, 25/50/75 % (exact, interpolated) and max per column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("r"))
    long = long.select("r.*")
    v = F.col("x")
    basic = long.groupBy("column").agg(F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                       F.min(v).alias("min"), F.max(v).alias("max"))
    q = grouped_quantiles(long, ["column"], "x", [0.25, 0.5, 0.75])
    return basic.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise Pearson correlation, long form (a, b, corr) over all ordered pairs.

    Each unordered pair is computed once and shown both ways.
    """
    aggs = [F.corr(a, b).alias(f"{a}|{b}__corr") for i, a in enumerate(cols) for b in cols[i:]]
    names = [f"{a}|{b}" for i, a in enumerate(cols) for b in cols[i:]]
    half = _stack(df.agg(*aggs), names, ["corr"], label="pair").select(
        F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "corr")
    ways = F.array_distinct(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.explode(ways).alias("w"), "corr").select("w.a", "w.b", "corr")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max, the last bin closed; empty bins kept.

    Bin assignment follows the usual histogram rule: floor of the scaled
    offset, then one correction step against the explicit edges
    lo + k * (hi - lo) / bins, so values on an edge land in the upper bin. The rows are
    read once, to count equal values; extremes and bins come from the counts.
    """
    df = materialize(df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")))
    lo = df.agg(F.min(col)).scalar()
    hi = df.agg(F.max(col)).scalar()
    step = (hi - lo) / bins

    def edge(k):
        return F.when(k >= bins, hi).otherwise(lo + k * step)

    x = F.col(col)
    k0 = F.least(F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int"), F.lit(bins - 1))
    k = (F.when(x < edge(k0), k0 - 1)
          .when((x >= edge(k0 + 1)) & (k0 != bins - 1), k0 + 1).otherwise(k0))
    counts = (df.filter(x.isNotNull()).groupBy((k + 1).alias("bin")).agg(F.sum("_n").alias("n")))
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (spine.join(counts, "bin", "left")
                 .select("bin", edge(F.col("bin") - 1).alias("bin_start"), edge(F.col("bin")).alias("bin_end"),
                         F.coalesce("n", F.lit(0)).alias("n")))


def group_sentiment(df: DataFrame, key, score: str = "final_sentiment_score", min_count: int | None = None) -> DataFrame:
    """Mean score and row count per group (HAVING count >= min_count)."""
    g = df.groupBy(key).agg(F.avg(score).alias("mean_sentiment"), F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") >= min_count) if min_count else g


def top_by_count(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """O3: the ``n`` keys with most rows (ties: smaller key first)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("mentions"))
              .orderBy(F.col("mentions").desc(), F.col(key)).limit(n))
