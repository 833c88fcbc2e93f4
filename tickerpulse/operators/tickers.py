"""Ticker detection (X4, X5, J1), stop-list removal (J2), inheritance
and the exchange union (U2).

Plan shape: candidates are extracted per row with regexp_extract_all and looked up in the
ticker dimension inside the row's own expression (``dictionary.py``), so neither texts
nor candidates move. Only a dimension above ``dictionary.EXACT_WORDS`` symbols needs a join: a Bloom filter in
the row's expression leaves the few likely candidates, and these are verified over narrow columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import caps_words, cashtags, class_variants
from .dictionary import EXACT_WORDS, bloom_test, exact_test


def _empty():
    return F.array().cast("array<string>")


def normalize_dim(dim: DataFrame) -> DataFrame:
    """Ticker dimension -> distinct upper-cased, trimmed, non-null ``ticker`` values."""
    return (dim.select(F.upper(F.trim(F.col("ticker"))).alias("ticker"))
               .filter(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
               .distinct())


def detect_tickers(df: DataFrame, dim: DataFrame, stoplist: DataFrame | None = None,
                   id_col: str = "id", text_col: str = "text", max_exact: int = EXACT_WORDS) -> DataFrame:
    """X5 (+J2): add ``mentioned_tickers`` (sorted distinct array) and ``n_tickers``.

    A candidate is a cashtag (X2) or an ALL-CAPS word not on the English list
    (X3). Its variants are tried in order (X4); the first one present in the
    dimension is the symbol (J1). Symbols whose upper form is on ``stoplist``
    (a one-column ``word`` frame) are dropped (J2). Rows without a symbol get [].
    Every row is judged by itself; ``id_col`` only matters for dimensions above ``max_exact`` symbols, where rows
    of one id share their symbols and rows with a null id have none.
    """
    symbols = normalize_dim(dim)
    candidates = F.array_union(cashtags(F.col(text_col)), caps_words(F.col(text_col)))
    known = _bounded(symbols, max_exact)
    stopped = None if stoplist is None else stoplist.select(F.upper(F.col("word")).alias("ticker")).distinct()
    stop_words = None if stopped is None else _bounded(stopped, max_exact)
    if known is None or (stopped is not None and stop_words is None):
        return _detect_by_join(df, symbols, stopped, candidates, id_col)
    in_dim = exact_test(known)
    in_stop = exact_test(stop_words or [])

    def symbol(c):
        """The first variant in the dimension, unless it is on the stop-list; else null."""
        tried = [c, F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.", "-")), F.when(F.instr(c, "-") > 0, F.regexp_replace(c, "-", "."))]
        return F.coalesce(*[F.when(in_dim(v), v) for v in tried])

    found = F.filter(F.transform(candidates, symbol), lambda s: s.isNotNull() & ~in_stop(s))
    out = df.withColumn("mentioned_tickers", F.array_sort(F.array_distinct(found)))
    return out.withColumn("n_tickers", F.size("mentioned_tickers"))


def _bounded(words: DataFrame, bound: int) -> list[str] | None:
    """The words of a one-column frame, or None if there are more than ``bound``."""
    rows = words.limit(bound + 1).collect()
    return [r[0] for r in rows if r[0] is not None] if len(rows) <= bound else None


def _detect_by_join(df: DataFrame, symbols: DataFrame, stopped: DataFrame | None, candidates, id_col: str) -> DataFrame:
    """The same symbols for a dimension of any size: a Bloom filter in the row, then joins over (id, candidate)."""
    likely = bloom_test(symbols, symbols.count())
    cands = (df.select(F.col(id_col).alias("_id"), F.filter(candidates, lambda c: F.exists(class_variants(c), likely)).alias("_c"))
               .filter(F.size("_c") > 0)
               .select("_id", F.explode("_c").alias("_cand"))
               .select("_id", "_cand", F.posexplode(class_variants(F.col("_cand"))).alias("_pos", "ticker")))
    hits = (cands.join(symbols, "ticker", "inner")
                 .groupBy("_id", "_cand").agg(F.min_by("ticker", "_pos").alias("ticker")))
    if stopped is not None:
        hits = hits.join(stopped, "ticker", "left_anti")
    found = hits.groupBy("_id").agg(F.array_sort(F.collect_set("ticker")).alias("_found"))
    out = df.join(found, df[id_col] == found["_id"], "left")
    return (out.withColumn("mentioned_tickers", F.coalesce(F.col("_found"), _empty()))
               .withColumn("n_tickers", F.size("mentioned_tickers"))
               .drop("_id", "_found"))


def inherit_parent_tickers(df: DataFrame, id_col: str = "id", parent_col: str = "parent_post_id",
                           col: str = "mentioned_tickers") -> DataFrame:
    """J3 + U3: comments take the sorted union of their own and their parent post's symbols.

    Only narrow (id, parent, symbols) columns take part in the join on the
    parent id; a hot thread is one skewed key of that join, which AQE's skew
    handling splits. The result is joined back to ``df`` on id.
    """
    posts = (df.filter((F.col("type") == "post") & (F.size(col) > 0))
               .select(F.col(id_col).alias("_pid"), F.col(col).alias("_ptick")))
    links = (df.filter((F.col("type") == "comment") & F.col(parent_col).isNotNull())
               .select(F.col(id_col).alias("_cid"), F.col(parent_col).alias("_pid")))
    inh = links.join(posts, "_pid", "inner").select("_cid", "_ptick")
    out = df.join(inh, df[id_col] == inh["_cid"], "left")
    merged = F.when(F.col("_ptick").isNotNull(),
                    F.array_sort(F.array_union(F.col(col), F.col("_ptick")))).otherwise(F.col(col))
    return (out.withColumn(col, merged).withColumn("n_tickers", F.size(col)).drop("_cid", "_ptick"))


def combine_exchanges(*dims: DataFrame) -> DataFrame:
    """Union exchange lists (ticker, company_name, exchange); upper/trim the
    ticker, drop NULL symbols, and keep the first list's row on duplicates."""
    parts = []
    for i, d in enumerate(dims):
        parts.append(d.select(F.upper(F.trim(F.col("ticker"))).alias("ticker"),
                              F.col("company_name").cast("string").alias("company_name"),
                              F.col("exchange").cast("string").alias("exchange"),
                              F.lit(i).alias("_prio")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.filter(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    w = Window.partitionBy("ticker").orderBy("_prio", "company_name", "exchange")
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_prio")
