"""Language-model scoring: a Katz back-off bigram model of the training documents.

Seen words and word pairs keep a Good-Turing discounted share of their counts; what the discounts free is
given to the unseen: for a word pair through the back-off weight of its first word, for a word through one
class of unknown words. Weights are normalised exactly, so the probabilities after any word (and after the
start of a text) add up to one over the known words, the end of the text and the unknown class.

The corpus is never gathered in one place, and texts are not shuffled. Documents are read once into
*chunks* of about ``CHUNK_TOKENS`` tokens, which hold the chunk's different words and each token's number. Then:

1. *Words.* Each chunk sends its different words with their training counts to word tables, partitioned by word
   hash. A table adds them up and answers each chunk with the words' numbers and total counts.
2. *Pairs.* Each chunk sends its different word pairs with their training counts to pair tables, partitioned
   by the first word. A table adds them up and answers with each pair's total count and each first
   word's sums (how many of its pairs were seen 1 to 5 times, and what its seen words have in lower-order
   probability), from which the back-off weight follows.
3. *Scores.* A chunk evaluates every token: the pair if it was seen, else the weight times the word, else
   the weight times the unknown class.

The chunks are cut from the documents once and stored: all steps meet by chunk number, and numbers made
anew would follow the file splits, which Spark plans by the cores it has at that moment.

Everything sent is combined within its chunk first, so a word or pair that makes up a third of all tokens
is one entry per chunk. The pairs of a very frequent first word are dealt over several tables, whose sums
the chunk adds. Tables are packed numpy arrays in binary columns, written to the shared checkpoint
folder between the steps; what reaches the driver is the counts of counts and one row per table.

Defined results: a null or empty text is the end token alone; repeated rows and null ids are scored one by
one, and rows without an id are learnt from; without training documents every token is unknown, of
probability one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import checkpointed
from .quality_model import fold

CHUNK_TOKENS = 2_000_000
TABLE_TOKENS = 2_000_000
RARE = 5  # counts up to this one are discounted
_END = b""  # no word is empty
_START = 0xFFFF_FFFF  # a context only


def _packed(values: np.ndarray) -> bytes:
    """Compressed byte planes: the high bytes of small numbers then cost next to nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Factors for counts 0 to ``RARE`` (and 1 beyond), from how many items were seen 1 to RARE+1 times.

    Good-Turing as Katz has it, where it gives a factor strictly between 0 and 1; an absolute discount elsewhere.
    """
    n = [0, *counts_of_counts]
    flat = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] + n[2] else 0.5
    out = np.ones(RARE + 2)
    beyond = (RARE + 1) * n[RARE + 1] / n[1] if n[1] else 1.0
    for r in range(1, RARE + 1):
        turing = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        factor = (turing - beyond) / (1 - beyond) if beyond < 1 else 0.0
        out[r] = factor if 0 < factor < 1 else 1 - flat / r
    out[0] = 0.0
    return out


def _factor(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, RARE + 1).astype(np.int64)]


class WordLevel:
    """Lower-order probabilities as a function of a word's total count; count 0 is the unknown class."""

    def __init__(self, total: int, different: int, counts_of_counts: list[int]):
        self.total, self.different = total, different
        d = discounts(counts_of_counts)
        freed = sum((1 - d[r]) * r * counts_of_counts[r - 1] for r in range(1, RARE + 1))
        self.all = total if freed > 0 else total + 1  # nothing rare: the unknown class gets one count
        self.unknown = (freed or 1.0) / self.all if total else 1.0
        self.d = d

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, _factor(self.d, counts) * counts / self.all, self.unknown)


def chunks(docs: DataFrame, text_col: str, id_col: str, held_out_fold: int) -> DataFrame:
    """``chunk, docs, train, sizes, words, counts, codes``: the different words' hashes in order of appearance, their
    training counts, and every token's place among them; the documents' ids, whether they train, and their tokens."""
    train = F.coalesce(fold(F.col(id_col)) != held_out_fold, F.lit(True))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def one(number: int, ids: pa.Array, train: list[bool], own: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(w) for w in own], np.uint32)
        codes, names = pd.factorize(np.array([w for words in own for w in words], dtype=object))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
        counts = np.bincount(codes[np.repeat(np.array(train, bool), sizes)], minlength=len(hashes))
        row = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([train], pa.list_(pa.bool_())),
               *(pa.array([_packed(x)], pa.binary()) for x in (sizes, hashes, counts.astype(np.uint32), codes.astype(np.uint32)))]
        return pa.RecordBatch.from_arrays(row, ["chunk", "docs", "train", "sizes", "words", "counts", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            own: list[list[bytes]] = []
            first = size = 0
            train = b.column("train").to_pylist()
            for k, text in enumerate(b.column("text")):
                own.append([*(text.as_py() or "").encode().lower().split(), _END])
                size += len(own[-1])
                if size >= CHUNK_TOKENS or k + 1 == b.num_rows:
                    yield one(number, b.column("doc_id").slice(first, len(own)), train[first:k + 1], own)
                    number, first, size, own = number + 1, k + 1, 0, []

    return narrow.mapInArrow(run, f"chunk long, docs array<{id_type}>, train array<boolean>, sizes binary, words binary, "
                                  "counts binary, codes binary")


def _rows(names: dict[str, str], rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(names.items())})


def _schema(names: dict[str, str]) -> str:
    return ", ".join(f"{n} {k}" for n, k in names.items())


_WORD_ASK = {"part": "int", "chunk": "long", "words": "binary", "counts": "binary"}
_PAIR_ASK = {"part": "int", "chunk": "long", "first": "binary", "pairs": "binary", "second": "binary", "known": "binary", "counts": "binary"}
_REPLY = {"part": "int", "chunk": "long", "a": "binary", "b": "binary"}


def _counts_of_counts(totals: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(totals, RARE + 2).astype(np.int64), minlength=RARE + 3)[1:RARE + 2]


def word_tables(parts: DataFrame, n_tables: int) -> DataFrame:
    """Answers to the chunks, and per table a row of chunk -1: different words, tokens, counts of counts."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words, counts in zip(*(b.column(c).to_pylist() for c in ("chunk", "words", "counts"))):
                words, counts = _unpacked(words, "u8"), _unpacked(counts, "u4")
                where = (words % np.uint64(n_tables)).astype(np.int64)
                rows = [(t, chunk, _packed(words[where == t]), _packed(counts[where == t])) for t in np.unique(where).tolist()]
                yield from _rows(_WORD_ASK, rows).to_batches()

    def table(group: pa.Table) -> pa.Table:
        part, chunk = group["part"][0].as_py(), group["chunk"].to_pylist()
        words = [_unpacked(x, "u8") for x in group["words"].to_pylist()]
        counts = np.concatenate([_unpacked(x, "u4") for x in group["counts"].to_pylist()])
        different, which = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(which, counts, len(different)).astype(np.uint64)
        seen = totals[totals > 0]
        summary = np.array([len(different), len(seen), int(seen.sum()), *_counts_of_counts(seen)], np.int64)
        rows = [(part, -1, _packed(summary), b"")]
        at = 0
        for c, w in zip(chunk, words):
            own = which[at:at + len(w)]
            at += len(w)
            rows.append((part, c, _packed(own.astype(np.uint32)), _packed(totals[own])))
        return _rows(_REPLY, rows)

    asked = parts.select("chunk", "words", "counts").mapInArrow(ask, _schema(_WORD_ASK))
    return asked.groupBy("part").applyInArrow(table, _schema(_REPLY))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and every key's place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


class Layout:
    """One chunk's different word pairs, in the order of the tables they belong to; the same on every call."""

    def __init__(self, row: dict, replies: list[dict], set_up: Setup):
        words, codes = _unpacked(row["words"], "u8"), _unpacked(row["codes"], "u4").astype(np.int64)
        self.sizes = _unpacked(row["sizes"], "u4").astype(np.int64)
        number, known = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        where = (words % np.uint64(set_up.tables)).astype(np.int64)
        for r in replies:
            own = where == r["part"]
            number[own] = _unpacked(r["a"], "u4").astype(np.uint64) + np.uint64(set_up.offsets[r["part"]])
            known[own] = _unpacked(r["b"], "u8").astype(np.int64)
        # words by rank of their number, so that a pair fits one number; contexts: the token before, or the start
        by_number = np.argsort(number)
        rank = np.empty(len(words) + 1, np.int64)
        rank[by_number], rank[-1] = np.arange(len(words)), len(words)
        number, known = np.r_[number[by_number], np.uint64(_START)], np.r_[known[by_number], set_up.starts]
        second = rank[codes]
        self.token_known = known[second]
        first = np.roll(second, 1)
        self.begins = np.cumsum(self.sizes) - self.sizes
        first[self.begins] = len(words)
        pairs, which = _distinct(first * len(number) + second)
        first, second = pairs // len(number), pairs % len(number)
        first_known = known[first]
        # a frequent first word has its pairs in several tables, chosen by the second word
        spread = np.maximum(1, -(-first_known * set_up.tables // max(1, set_up.total)))
        mixed = (number[first] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
        salt = (number[second] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)).astype(np.int64) % spread
        part = (mixed + salt) % set_up.tables
        order = np.argsort(part.astype(np.min_scalar_type(set_up.tables)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.token_pair = place[which]
        learnt = np.repeat(np.array(row["train"], bool), self.sizes)
        self.counts = np.bincount(self.token_pair[learnt], minlength=len(order))
        self.part, self.second, self.known = part[order], number[second[order]], known[second[order]]
        # every table that holds a first word's pairs is asked for its sums, also where this chunk has no pair
        mine = self.part.astype(np.uint64) << np.uint64(32) | number[first[order]]
        several = np.flatnonzero(spread > 1)
        names, at = np.unique(first[several], return_index=True)
        new = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        asks, totals = [mine[new]], [first_known[order][new]]
        for name, k in zip(names, several[at]):
            tables = np.unique((mixed[k] + np.arange(spread[k])) % set_up.tables)
            asks.append(tables.astype(np.uint64) << np.uint64(32) | number[name])
            totals.append(np.full(len(tables), first_known[k]))
        asked, at = np.unique(np.concatenate(asks), return_index=True)
        self.ask_part, self.ask_first = (asked >> np.uint64(32)).astype(np.int64), asked & np.uint64(0xFFFF_FFFF)
        self.context = np.concatenate(totals)[at]
        self.owner = np.searchsorted(asked, mine)
        self.pairs = np.bincount(self.owner, minlength=len(asked))

    def requests(self, chunk: int) -> list[tuple]:
        rows = []
        for t in np.unique(self.ask_part).tolist():
            f, p = slice(*np.searchsorted(self.ask_part, [t, t + 1])), slice(*np.searchsorted(self.part, [t, t + 1]))
            rows.append((t, chunk, _packed(np.diff(self.ask_first[f].astype(np.int64), prepend=0)), _packed(self.pairs[f].astype(np.uint32)),
                         _packed(self.second[p].astype(np.uint32)), _packed(self.known[p].astype(np.uint64)), _packed(self.counts[p].astype(np.uint32))))
        return rows


@dataclass(frozen=True)
class Setup:
    """What every task needs to know: table count, first word number of each table, training documents and tokens."""
    tables: int
    offsets: np.ndarray
    starts: int
    total: int


def pair_requests(parts: DataFrame, answers: DataFrame, set_up: Setup) -> DataFrame:
    """What each chunk sends to the pair tables."""
    def one(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        rows = chunk.to_pylist()
        return _rows(_PAIR_ASK, Layout(rows[0], replies.to_pylist(), set_up).requests(rows[0]["chunk"]) if rows else [])

    small = parts.select("chunk", "train", "sizes", "words", "codes").groupBy("chunk")
    return small.cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(one, _schema(_PAIR_ASK))


def pair_tables(requests: DataFrame, level: WordLevel) -> DataFrame:
    """Answers to the chunks, and per table a row of chunk -1: counts of counts of the pairs."""
    def table(group: pa.Table) -> pa.Table:
        part, chunk = group["part"][0].as_py(), group["chunk"].to_pylist()
        cols = {c: [_unpacked(x, k) for x in group[c].to_pylist()] for c, k in
                (("first", "i8"), ("pairs", "u4"), ("second", "u4"), ("known", "u8"), ("counts", "u4"))}
        cols["first"] = [np.cumsum(x).astype(np.uint32) for x in cols["first"]]
        firsts, per = np.concatenate(cols["first"]), np.concatenate(cols["pairs"])
        key = np.repeat(firsts, per).astype(np.uint64) << np.uint64(32) | np.concatenate(cols["second"])
        different, at, which = np.unique(key, return_index=True, return_inverse=True)
        totals = np.bincount(which, np.concatenate(cols["counts"]), len(different)).astype(np.int64)
        if len(totals) and totals.max() > 0xFFFF_FFFF:
            raise OverflowError("a word pair was seen more often than 32 bits can count")
        lower = level(np.concatenate(cols["known"])[at].astype(np.int64))
        names, first_at = np.unique(firsts, return_inverse=True)
        owner = np.searchsorted(names, (different >> np.uint64(32)).astype(np.uint32))
        sums = np.zeros((len(names), RARE + 1))
        for r in range(1, RARE + 1):
            sums[:, r - 1] = np.bincount(owner[totals == r], minlength=len(names))
        sums[:, RARE] = np.bincount(owner[totals > 0], lower[totals > 0], len(names))
        seen = np.bincount(owner[totals > 0], minlength=len(names))
        rows = [(part, -1, _packed(_counts_of_counts(totals[totals > 0]).astype(np.int64)), b"")]
        p = f = 0
        for c, seconds, own, pairs in zip(chunk, cols["second"], cols["first"], cols["pairs"]):
            total, mine = totals[which[p:p + len(seconds)]], first_at[f:f + len(own)]
            reply = sums[mine]
            # a chunk that holds all seen pairs of a first word adds up their probabilities itself
            held = np.bincount(np.repeat(np.arange(len(own)), pairs), total > 0, len(own))
            reply[held == seen[mine], RARE] = 0.0
            rows.append((part, c, _packed(total.astype(np.uint32)), _packed(reply.ravel())))
            p, f = p + len(seconds), f + len(own)
        return _rows(_REPLY, rows)

    return requests.groupBy("part").applyInArrow(table, _schema(_REPLY))


def _evaluate(own: Layout, replies: list[dict], level: WordLevel, d: np.ndarray) -> np.ndarray:
    """Each token's probability."""
    replies.sort(key=lambda r: r["part"])
    totals = np.concatenate([_unpacked(r["a"], "u4") for r in replies]).astype(np.int64)
    sums = np.concatenate([_unpacked(r["b"], "f8").reshape(-1, RARE + 1) for r in replies]).copy()
    lower = level(own.known)
    mine = np.bincount(own.owner[totals > 0], lower[totals > 0], len(own.ask_first))
    sums[:, RARE] = np.where(sums[:, RARE] == 0, mine, sums[:, RARE])
    _, same = np.unique(own.ask_first, return_inverse=True)  # a first word dealt over several tables has its sums added
    joined = np.zeros((same.max() + 1, RARE + 1))
    np.add.at(joined, same, sums)
    joined = joined[same]
    freed = joined[:, :RARE] @ ((1 - d[1:RARE + 1]) * np.arange(1, RARE + 1))
    whole = np.where(freed > 0, own.context, own.context + 1)  # nothing rare after this word: the unseen get one count
    freed = np.where(freed > 0, freed, 1.0)
    weight = np.where(own.context > 0, freed / np.maximum(whole, 1) / np.maximum(1 - joined[:, RARE], 1e-300), 1.0)
    p = np.where(totals > 0, _factor(d, totals) * totals / np.maximum(whole[own.owner], 1), weight[own.owner] * lower)
    return p[own.token_pair]


def stored(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """The chunks as a table in the shared folder, bucketed by chunk: the cogroups read them where they are, and only
    the answers move. Each task writes its few chunks straight to their buckets."""
    spark = docs.sparkSession
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    path = scratch_path(spark, "katz-chunks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    parts.write.format("parquet").bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    return spark.table(name)


def score_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", held_out_fold: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``score`` is the model's log10 probability of the text; ``base_score`` that of smoothed word counts.
    """
    parts = stored(chunks(docs, text_col, id_col, held_out_fold), docs)
    size = parts.agg(F.sum(F.size(F.filter("train", lambda t: t))).alias("train"), F.count("*").alias("chunks")).first()
    n_tables = max(8, -(-(size["chunks"] or 0) * CHUNK_TOKENS // TABLE_TOKENS))
    answers = checkpointed(word_tables(parts, n_tables))
    summary = {r["part"]: _unpacked(r["a"], "i8") for r in answers.where("chunk = -1").collect()}  # one row a table
    stats = np.array([summary.get(t, np.zeros(RARE + 4, np.int64)) for t in range(n_tables)])
    total, different, of_words = int(stats[:, 2].sum()), int(stats[:, 1].sum()), stats[:, 3:].sum(axis=0).tolist()
    set_up = Setup(n_tables, np.cumsum(stats[:, 0]) - stats[:, 0], size["train"] or 0, total)
    level = WordLevel(total, different, of_words)
    if int(stats[:, 0].sum()) >= _START:
        raise OverflowError("more different words than 32 bits can number")
    replies = checkpointed(pair_tables(pair_requests(parts, answers, set_up), level))
    of_pairs = np.zeros(RARE + 1, np.int64)
    for r in replies.where("chunk = -1").collect():  # one row a table
        of_pairs += _unpacked(r["a"], "i8")
    d = discounts(of_pairs.tolist())
    id_type = parts.schema["docs"].dataType.elementType.simpleString()
    smooth = total + 0.5 * (different + 1)

    def score(chunk: pa.Table, mail: pa.Table) -> pa.Table:
        rows, mailed = chunk.to_pylist(), mail.to_pylist()
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [chunk.schema.field("docs").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        row = rows[0]
        own = Layout(row, [m for m in mailed if not m["pairs"]], set_up)
        p = _evaluate(own, [m for m in mailed if m["pairs"]], level, d)
        known = own.token_known
        per = [np.add.reduceat(x, own.begins) for x in ((known > 0).astype(np.int64), np.log10((known + 0.5) / smooth), np.log10(p))]
        cols = [row["docs"], [not t for t in row["train"]], own.sizes, per[0], [total] * len(own.sizes), per[1], per[2]]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    mail = answers.withColumn("pairs", F.lit(False)).unionByName(replies.withColumn("pairs", F.lit(True))).where("chunk >= 0")
    needed = parts.select("chunk", "docs", "train", "sizes", "words", "codes")
    return needed.groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInArrow(
        score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
