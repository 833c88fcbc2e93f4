"""SimHash near-duplicates with pivot distance tables.

1. Every text becomes a 64-bit fingerprint: ASCII-lower-cased words, 3-word shingles with repeats
   (a shorter text is one shingle, an empty one has fingerprint zero), XXH64 with seed 42, and a
   majority vote per bit (a tie gives 0).
2. Equal fingerprints are folded into one class, so a group of copies of any size is one row.
3. For every class the Hamming distances to ``PIVOTS`` reference fingerprints are stored.
4. Classes meet in an equi-join bucket: the bits are cut into ``max_bits + 3`` blocks, two
   fingerprints at ``max_bits`` or fewer differing bits agree on at least three blocks, and each
   choice of three blocks is a key, so no close pair is missed and no all-pairs join exists.
5. In a bucket, a pair whose distances to any pivot differ by more than ``max_bits`` is discarded
   (triangle inequality: no loss), survivors are verified by their exact Hamming distance.
   A bucket gives a spanning forest of its links, never all its pairs. Buckets of more than
   ``HOT`` classes are keyed again on a quarter of their other bits (again without loss), so
   a huge family of near copies is spread over many buckets.
6. Components of the links are found by star contraction (``graph.py``).

Defined results: null texts count as empty and link to each other; repeated rows share a class; null
ids are given a component but are never its name unless it has no other id; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .graph import connected_components

PIVOTS = 16
HOT = 4096
_ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), 42)]
    else:
        joined, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-1])]
        hashes = [h(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1:])]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for part in range(0, len(values), 1 << 16):  # bounded bit matrix for very long texts
        bits = np.unpackbits(values[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``(doc_id, h, fp)``, one row per row: the hash of the text, and the fingerprint as a signed long."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), _text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    return narrow.mapInArrow(run, f"doc_id {id_type}, h long, fp long")


def pivot_fingerprints(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of their numbers, as signed longs."""
    return [xxhash.xxh64_intdigest(b"pivot %d" % i, 42) - (1 << 63) for i in range(n)]


def _masks(max_bits: int, blocks: int) -> list[int]:
    """Signed bit masks of every choice of ``blocks - max_bits`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [sum(1 << k for k in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(own, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _rest_masks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` runs."""
    free = [k for k in range(64) if not mask >> k & 1]
    cut = [round(len(free) * i / parts) for i in range(parts + 1)]
    masks = [sum(1 << k for k in free[a:b]) for a, b in zip(cut, cut[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _table(fp: Column) -> list[Column]:
    """The pivot distances, eight of 8 bits in a long each."""
    d = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in pivot_fingerprints()]
    packed = []
    for part in range(0, len(d), 8):
        total = d[part]
        for k, x in enumerate(d[part + 1:part + 8], 1):
            total = total.bitwiseOR(F.shiftleft(x, 8 * k))
        packed.append(total.alias(f"table{part // 8}"))
    return packed


def forest(fps: np.ndarray, tables: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links in one bucket.

    From each reached class, the classes not reached yet are cut down by the largest difference
    of pivot distances, and the survivors verified by their Hamming distance.
    """
    left = np.arange(len(fps))
    links = []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            near = left[np.abs(tables[left] - tables[x]).max(axis=1) <= max_bits]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= max_bits]
            if len(near):
                links += [(x, int(y)) for y in near]
                front += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return links


def _bucket_links(max_bits: int):
    """mapInArrow over rows sorted by bucket: each bucket's forest. One bucket is held at a time."""
    def of(fps: np.ndarray, tables: np.ndarray) -> list[tuple[int, int]]:
        signed = fps.view(np.int64)
        return [(int(signed[i]), int(signed[j])) for i, j in forest(fps, tables, max_bits)]

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_key = None
        for b in batches:
            if not b.num_rows:
                continue
            key, fps, *packed = (b.column(c).to_numpy() for c in ("bucket", "fp", "table0", "table1"))
            fps = fps.view(np.uint64)
            tables = np.stack(packed, axis=1).view(np.uint8).reshape(len(fps), -1).astype(np.int16)
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            found: list[tuple[int, int]] = []
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(key)]):
                if held and held_key != key[s]:
                    found += of(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                if held or e == len(key):
                    held, held_key = [*held, (fps[s:e], tables[s:e])], key[s]
                elif e - s > 1:
                    found += of(fps[s:e], tables[s:e])
            yield batch_of(found)
        if held:
            yield batch_of(of(*(np.concatenate(x) for x in zip(*held))))

    return run


def links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(a, b)`` links that connect all fingerprints of ``classes(fp)`` at ``max_bits`` or fewer bits."""
    fp = F.col("fp")
    masks = _masks(max_bits, max_bits + 3)
    choice = F.explode(F.array(*(F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("part"))
                                 for k, m in enumerate(masks)))).alias("key")
    keyed = classes.select("fp", choice).select("fp", "key.choice", F.xxhash64("key.choice", "key.part").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # most keys are held by one class only: they go before the wider rows are made
    met = checkpointed(keyed.join(shared, "bucket"))
    plain = met.where(F.col("n") <= HOT).select("bucket", "fp")
    rest = F.lit(None).cast("array<bigint>")
    for k, m in enumerate(masks):
        cut = F.array(*(fp.bitwiseAND(F.lit(x)) for x in _rest_masks(m, max_bits + 1)))
        rest = F.when(F.col("choice") == k, cut).otherwise(rest)
    hot = (met.where(F.col("n") > HOT).select("fp", "bucket", F.posexplode(rest).alias("part", "bits"))
           .select(F.xxhash64("bucket", "part", "bits").alias("bucket"), "fp"))
    rows = plain.unionByName(hot).select("bucket", "fp", *_table(fp))
    spread = rows.repartition("bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(_bucket_links(max_bits), "a long, b long").distinct()


def components(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(doc_id, h, fp)`` rows with ``root``, the smallest fingerprint that links reach, and
    ``component_id``, the smallest doc_id there.

    ``prints`` should be checkpointed: it is read twice.
    """
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(classes, max_bits)).withColumnRenamed("node", "fp")
    joined = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = checkpointed(joined.join(names, "root").select("fp", "root", "component_id"))
    return prints.join(of_class, "fp").select("doc_id", "h", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """``(doc_id, h, fp, root, component_id)`` for every row of ``docs``."""
    return components(checkpointed(fingerprints(docs, text_col, id_col, shingle)), max_bits)


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest doc_id.

    If that id stands in several rows of the component, the one with the smallest text hash stays. A component
    without any id keeps one row of its smallest fingerprint. Rows are told apart by (doc_id, hash of the
    text), so texts of other components under the same id neither stand in for the kept row nor come with it.
    """
    marked = near_duplicates(docs, shingle=shingle, max_bits=max_bits)
    able = marked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "h").agg(
        F.min("fp").alias("fp"), F.count("*").alias("n_rows"))
    order = F.struct(F.when(F.col("doc_id").isNull(), F.col("fp")).alias("fp"), "h", "n_rows")
    chosen = checkpointed(able.groupBy("root").agg(F.min(order).alias("c"), F.first("doc_id").alias("kept_id")).select(
        "kept_id", F.col("c.h").alias("kept_h"), F.col("c.n_rows").alias("n_rows")))
    own = docs["doc_id"].eqNullSafe(F.col("kept_id")) & (_text_hash(docs["text"]) == F.col("kept_h"))
    once = docs.join(chosen.where("n_rows = 1"), own, "left_semi")
    again = docs.join(chosen.where("n_rows > 1"), own, "left_semi")
    row = F.struct(*docs.columns).alias("row")
    several = again.select("doc_id", _text_hash(F.col("text")).alias("__h"), row).groupBy("doc_id", "__h").agg(
        F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return once.unionByName(several)
