"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document if at least ``threshold`` of its distinct ``shingle``-word shingles
stand in the document, in any order and at any place. Words are lower-cased runs of letters, marks and
digits, so case, punctuation and line breaks do not hide a passage; an item of fewer words than a
shingle is one shorter shingle, which a document holds if its whole word sequence is that one.

* **Sketch.** Shingles are hashed once to 64 bits. An item of n shingles that is contained must share
  at least ceil(threshold * n) of them, so it must share at least one of its
  ``n - ceil(threshold * n) + 1`` smallest hashes. These bottom-k MinHash values are its sketch:
  a document that shares none of them cannot contain the item.
* **Size partition.** Items are partitioned by size (powers of two of their shingle count). Each
  partition has its own cut-off, the largest hash in any of its sketches, and its own least count.
  A document's sketch in that partition is all of its hashes up to the cut-off, and documents with fewer
  shingles than the partition's smallest item must share are not sketched for it at all.
  So the document sketch has a fixed *rate*, not a fixed length, and a 20-word item is found in
  a document of any length.
* **Verification.** Candidate pairs come from an equi-join of the sketches; for each, the shingles of
  the document are compared as words with the item's and the distinct ones counted exactly.

Only DataFrame functions are used. Item tables are broadcast after their rows were counted and are at
most ``BROADCAST_ROWS``; a larger benchmark runs as a shuffled join.

Defined results: null or empty texts hold nothing and are held by nothing; a document is a text under an
id, told apart by (doc_id, hash of the text), so repeated rows are one document, and different texts
under one id, or without an id, are looked at one by one; of several texts under one id the pair with the
most shared shingles is reported; equal items are each reported; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, once

BROADCAST_ROWS = 200_000
_TOKEN = r"[\p{L}\p{M}\p{N}]+"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def _shingles(words: Column, k: int, of) -> Column:
    """``of(list of k word columns)`` for each run of k words; a shorter sequence is one run."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: of([F.get(words, i + j) for j in range(k)]))
    short = F.array(of([F.get(words, F.lit(j)) for j in range(k)]))
    return F.when(n >= k, runs).when(n > 0, short)


def _hashed(words: Column, k: int) -> Column:
    return _shingles(words, k, lambda w: F.xxhash64(*w))


def _spelled(words: Column, k: int) -> Column:
    return _shingles(words, k, lambda w: F.concat_ws(" ", *w))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a checkpointed table if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contained_rows(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5,
                   doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """``(doc_id, h, item_id, n_shared, n_shingles)`` of every text (``h``: its hash) and item at the threshold."""
    own = items.select(F.col(item_id).alias("item_id"), once(_tokens(F.col(item_text))).alias("words"))
    own = own.select("item_id", F.array_distinct(_spelled(F.col("words"), shingle)).alias("spelled"),
                     F.array_sort(F.array_distinct(_hashed(F.col("words"), shingle))).alias("hashes"))
    own = own.select("item_id", once(F.struct("spelled", "hashes")).alias("s")).select("item_id", "s.*")
    own = own.where("size(spelled) > 0").select("item_id", "spelled", "hashes", F.size("spelled").alias("n_shingles"))
    own = own.withColumn("need", F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9)).cast("int"))
    own = checkpointed(own.withColumn("size_class", F.floor(F.log2("n_shingles")).cast("int")))

    sketch = own.select("item_id", "size_class", "need",
                        F.explode(F.slice("hashes", F.lit(1), F.col("n_shingles") - F.col("need") + 1)).alias("sh"))
    sketch = checkpointed(sketch)
    parts = (sketch.groupBy("size_class").agg(F.max("sh").alias("cut"), F.min("need").alias("least"))
             .orderBy("size_class").collect())  # at most 32 rows: one per power of two
    if not parts:
        empty = docs.select(F.col(doc_id).alias("doc_id"), F.lit(0).cast("bigint").alias("h")).limit(0)
        return empty.crossJoin(own.select("item_id").limit(0)).select(
            "doc_id", "h", "item_id", F.lit(0).cast("bigint").alias("n_shared"), F.lit(0).alias("n_shingles"))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), _text_hash(F.col(doc_text)).alias("h"), F.col(doc_text).alias("text"))
    words = narrow.select("doc_id", "h", once(_tokens(F.col("text"))).alias("words"))
    found = words.select("doc_id", "h", once(_hashed(F.col("words"), shingle)).alias("hashes"))
    found = found.select("doc_id", "h", F.size("hashes").alias("n"), "hashes")
    rows = found.select("doc_id", "h", "n", F.explode("hashes").alias("sh"))
    in_part = F.lit(False)
    for p in parts:
        in_part = in_part | ((F.col("sh") <= F.lit(p["cut"])) & (F.col("n") >= F.lit(p["least"])))
    rows = rows.where(in_part)
    on = [rows["sh"] == sketch["sh"], rows["n"] >= sketch["need"]]
    pairs = checkpointed(rows.join(_small(sketch), on).select("doc_id", "h", "item_id").distinct())

    wanted = pairs.select(F.col("doc_id").alias("pair_doc"), F.col("h").alias("pair_h")).distinct()
    texts = narrow.join(wanted, F.col("doc_id").eqNullSafe(F.col("pair_doc")) & (F.col("h") == F.col("pair_h")), "left_semi")
    spelled = texts.select("doc_id", "h", once(_tokens(F.col("text"))).alias("words"))
    spelled = spelled.select("doc_id", "h", once(_spelled(F.col("words"), shingle)).alias("runs"))
    spelled = spelled.select("doc_id", "h", F.explode("runs").alias("shingle"))
    wanted_shingles = checkpointed(own.select("item_id", "n_shingles", "need", F.explode("spelled").alias("shingle")))
    shared = spelled.join(_small(wanted_shingles), "shingle")
    exact = shared.groupBy("doc_id", "h", "item_id").agg(
        F.count_distinct("shingle").alias("n_shared"), F.max("n_shingles").alias("n_shingles"),
        F.max("need").alias("need"))
    verified = exact.where("n_shared >= need").alias("v").join(
        pairs.alias("p"), F.col("v.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("v.h") == F.col("p.h"))
        & F.col("v.item_id").eqNullSafe(F.col("p.item_id")), "left_semi")
    return verified.select("doc_id", "h", "item_id", "n_shared", "n_shingles")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5,
                    doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_shared, n_shingles, containment)`` of every pair at the threshold."""
    rows = contained_rows(docs, items, threshold, shingle, doc_id, doc_text, item_id, item_text)
    pairs = rows.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return pairs.select("doc_id", "item_id", "n_shared", "n_shingles",
                        (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` without the rows whose text holds an item; other texts under the same or no id stay."""
    rows = contained_rows(docs, items, threshold, shingle)
    hit = checkpointed(rows.select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")).distinct())
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("hit_id")) & (_text_hash(docs["text"]) == F.col("hit_h")), "left_anti")
