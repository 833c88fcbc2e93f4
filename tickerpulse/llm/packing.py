"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of the token streams of its documents. A window of ``window_sequences``
sequences visits every queue in turn and takes tokens up to that queue's deficit counter: the counter
grows by the source's quantum (its target share of a window) per window, and falls by what was served;
what is left, a part of a token, is carried to the next window. So every window meets the target
proportions to the token, and no queue drifts. The windows, one after another, form the token stream
that is cut into sequences, so only the very last sequence can need padding.

The counters follow from the number of the window alone (served tokens are the quantum times the
windows so far, rounded down), so any task can place any document once it knows where the document stands in its
source's queue. Those places are running sums: within a task while it tokenizes, then over
the tasks' totals. Counters are thus carried across partitions without a pass over the documents in order, and
a source with a third of all rows is spread over as many tasks as hold it.

With few sources each task knows all queues, and a window's order follows in closed form. With more, the shares
(window, source, tokens) are a Spark table, whose running sums give each share's place in the stream;
pieces meet it by (window, source). A share is at least one piece, so that table is no larger than the result.

Targets default to the sources' own shares of all tokens; then all queues run dry together. With other
targets, a queue that runs dry leaves its place in later windows to the rest.

Defined results: a null text is empty, which still has its end token; a null source is a queue of its
own; repeated rows and null ids are separate documents; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import word_tokenizer

#: Up to this many sources, tasks place pieces by the closed form over all queues; beyond it by a table of shares.
CLOSED_FORM_SOURCES = 256
#: Task totals (task, source) and shares (window, source) up to this many rows are broadcast, else joined by shuffle.
BROADCAST_ROWS = 500_000
#: Windows per block of the running sums.
_BLOCK = 4096
_FRACTION = 16  # bits after the point of a quantum


@dataclass(frozen=True)
class Packing:
    sequence_tokens: int = 4096
    window_sequences: int = 16
    end_id: int = 2


def tokenized(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """``(task, source, doc_id, n_tokens, before, ids)``: token ids of whole texts, packed little-endian,
    and the tokens of the same source that stand before the document in its task."""
    narrow = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(path)
        end = np.array([end_id], coder.dtype).tobytes()
        task = TaskContext.get().partitionId()
        so_far: dict[str | None, int] = {}
        for b in batches:
            ids = [x + end for x in coder.encode(b.column("text").to_pylist())]
            sizes = [len(x) // coder.dtype.itemsize for x in ids]
            before = []
            for source, n in zip(b.column("source").to_pylist(), sizes):
                before.append(so_far.get(source, 0))
                so_far[source] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(ids), pa.int32()), b.column("source"), b.column("doc_id"),
                 pa.array(sizes, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                ["task", "source", "doc_id", "n_tokens", "before", "ids"])

    return narrow.mapInArrow(run, f"task int, source string, doc_id {id_type}, n_tokens long, before long, ids binary")


class Rounds:
    """Places in the packed stream, from the queues' lengths and quanta."""

    def __init__(self, lengths: list[int], shares: list[float] | None, p: Packing):
        self.total = np.array(lengths, np.int64)
        self.quantum = _quantum(lengths, sum(lengths), shares, p)
        self.size = p.sequence_tokens

    @classmethod
    def of(cls, total: np.ndarray, quantum: np.ndarray, p: Packing) -> Rounds:
        """From known quanta, one entry a row."""
        out = cls.__new__(cls)
        out.total, out.quantum, out.size = total, quantum, p.sequence_tokens
        return out

    def served(self, source: int, window: np.ndarray) -> np.ndarray:
        """Tokens that a queue has given after so many windows."""
        last = -((-self.total[source] << _FRACTION) // self.quantum[source])
        return np.minimum(self.total[source], (self.quantum[source] * np.minimum(window, last)) >> _FRACTION)

    def window_of(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The window (from 1) that takes the token at ``place`` of a queue."""
        return -((-(place + 1) << _FRACTION) // self.quantum[source])

    def start_of(self, source: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Stream place of a queue's share in a window, less the tokens served before it."""
        out = np.zeros(len(window), np.int64)
        for s in range(len(self.total)):  # queues before this one have been served in this window already
            out += np.where(s == source, 0, self.served(s, window - (s > source)))
        return out

    def served_each(self, source: np.ndarray, window: np.ndarray) -> np.ndarray:
        total, quantum = self.total[source], self.quantum[source]
        last = -((-total << _FRACTION) // quantum)
        return np.minimum(total, (quantum * np.minimum(window, last)) >> _FRACTION)

    def turns(self, source: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, window, and first and end place in its queue, of what each window takes of documents at ``place``."""
        first, last = self.window_of(source, place), self.window_of(source, place + size - 1)
        row, window = _spread(first, last)
        s = source[row]
        a = np.maximum(place[row], self.served_each(s, window - 1))
        b = np.minimum((place + size)[row], self.served_each(s, window))
        some = b > a  # a quantum below one token leaves windows without a share
        return row[some], window[some], a[some], b[some]

    def pieces(self, source: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, start, length, window and stream place of every piece of documents at ``place``."""
        row, window, a, b = self.turns(source, place, size)
        at = self.start_of(source[row], window) + a
        part, low, n = _cut(at, b - a, self.size)
        return row[part], a[part] - place[row[part]] + low - at[part], n, window[part], low


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of ``first..last`` of every row."""
    n = last - first + 1
    row = np.repeat(np.arange(len(first)), n)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _cut(at: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, stream place and length of the parts of runs at ``at`` that lie in one sequence each."""
    part, block = _spread(at // size, (at + length - 1) // size)
    low = np.maximum(at[part], block * size)
    return part, low, np.minimum((at + length)[part], (block + 1) * size) - low


def _quantum(lengths: list[int], whole: int, shares: list[float] | None, p: Packing) -> np.ndarray:
    window = p.sequence_tokens * p.window_sequences
    exact = [(n * window << _FRACTION, whole) for n in lengths] if shares is None else [
        (int(s * window * (1 << _FRACTION)), 1) for s in shares]
    return np.array([max(1, -(-a // b)) for a, b in exact], np.int64)


def shares_of(rates: DataFrame) -> DataFrame:
    """``(window, queue, at)``: the stream place of each share that is not empty, from ``rates(queue, total, quantum)``.

    A queue of one token or more a window has a share in each of its windows; a slower one has one token a
    share, so its shares are found from its tokens.
    """
    one = 1 << _FRACTION
    up = lambda a: f"({a} + quantum - 1) div quantum"
    last = F.expr(up(f"total * {one}"))
    steps = F.when(F.col("quantum") >= one, last).otherwise(F.col("total"))
    blocks = rates.where("total > 0").select("*", last.alias("last"), steps.alias("steps"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(steps - 1) div {_BLOCK}"))).alias("b"))
    each = blocks.select("*", F.explode(F.sequence(F.col("b") * _BLOCK + 1, F.least("steps", (F.col("b") + 1) * _BLOCK))).alias("k"))
    each = each.withColumn("window", F.when(F.col("quantum") >= one, F.col("k")).otherwise(F.expr(up(f"k * {one}"))))
    served = lambda w: F.least("total", F.shiftright(F.col("quantum") * F.least(w, "last"), _FRACTION))
    size = served(F.col("window")) - served(F.col("window") - 1)
    share = checkpointed(each.select("window", "queue", size.alias("n")).where("n > 0"))
    # three running sums: blocks of windows, windows in a block, queues in a window
    total = share.groupBy("window").agg(F.sum("n").alias("n")).withColumn("block", F.expr(f"window div {_BLOCK}"))
    total = checkpointed(total)
    past = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(past(w)), F.lit(0))
    base = total.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(W.orderBy("block")).alias("base"))
    start = total.select("window", "block", before(W.partitionBy("block").orderBy("window")).alias("inner")).join(base, "block")
    start = start.select("window", (F.col("base") + F.col("inner")).alias("start"))
    own = share.select("window", "queue", before(W.partitionBy("window").orderBy("queue")).alias("own"))
    return own.join(start, "window").select("window", "queue", (F.col("start") + F.col("own")).alias("at"))


def _pack_many(tokens: DataFrame, bases: DataFrame, queues: DataFrame, p: Packing, targets: dict[str | None, float] | None) -> DataFrame:
    """``pack`` for any number of sources: nothing per source leaves the Spark tables."""
    whole = queues.agg(F.sum("n")).first()[0]
    scale = 1.0
    if targets is not None:  # the weights of all sources add up to this
        own = F.col("source").isin([t for t in targets if t is not None]) | (F.col("source").isNull() & F.lit(None in targets))
        named = queues.where(own).collect()  # at most one row a target
        scale = sum(targets[q["source"]] for q in named) + (whole - sum(q["n"] for q in named)) / whole

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, lengths = b.column("source").to_pylist(), b.column("n").to_pylist()
            shares = None if targets is None else [targets.get(name, n / whole) / scale for name, n in zip(names, lengths)]
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("n"), pa.array(_quantum(lengths, whole, shares, p))],
                                             ["queue", "total", "quantum"])

    rates = checkpointed(queues.mapInArrow(rate, "queue string, total long, quantum long"))
    known = bases.join(rates.withColumnRenamed("queue", "of"), F.col("queue").eqNullSafe(F.col("of"))).drop("of")
    small = F.broadcast(known) if bases.count() <= BROADCAST_ROWS else known
    placed = tokens.withColumnRenamed("task", "t").join(small, (F.col("t") == F.col("task")) & F.col("source").eqNullSafe(F.col("queue"))).select(
        "doc_id", "source", "n_tokens", (F.col("before") + F.col("base")).alias("place"), "ids", "total", "quantum")
    id_type = placed.schema["doc_id"].dataType.simpleString()

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, size = b.column("place").to_numpy(), b.column("n_tokens").to_numpy()
            rounds = Rounds.of(b.column("total").to_numpy(), b.column("quantum").to_numpy(), p)
            each = np.arange(len(place))
            row, window, a, end = rounds.turns(each, place, size)
            start, skip, packed = a - place[row], a - rounds.served_each(row, window - 1), b.column("ids").to_pylist()
            for begin in range(0, len(row), 4096):
                own = slice(begin, begin + 4096)
                take, cut = pa.array(row[own]), []
                for r, s, n in zip(row[own].tolist(), start[own].tolist(), (end - a)[own].tolist()):
                    width = len(packed[r]) // int(size[r])
                    cut.append(packed[r][width * s:width * (s + n)])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), b.column("source").take(take), b.column("n_tokens").take(take), pa.array(start[own]),
                     pa.array((end - a)[own]), pa.array(window[own]), pa.array(skip[own]), pa.array(cut, pa.binary())],
                    ["doc_id", "source", "doc_tokens", "start", "length", "window", "skip", "ids"])

    taken = placed.mapInArrow(turns, f"doc_id {id_type}, source string, doc_tokens long, start long, length long, window long, skip long, ids binary")
    shares = checkpointed(shares_of(rates).withColumnRenamed("window", "of"))
    near = F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares
    met = taken.join(near, (F.col("window") == F.col("of")) & F.col("source").eqNullSafe(F.col("queue"))).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("at") + F.col("skip")).alias("at"), "source", "window", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, length, start = (b.column(c).to_numpy() for c in ("at", "length", "start"))
            packed = b.column("ids").to_pylist()
            row, low, n = _cut(at, length, p.sequence_tokens)
            skip, take, ids = low - at[row], pa.array(row), []
            for r, s, k in zip(row.tolist(), skip.tolist(), n.tolist()):
                ids.append(np.frombuffer(packed[r], f"<u{len(packed[r]) // int(length[r])}")[s:s + k].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), pa.array(start[row] + skip), pa.array(n), b.column("doc_tokens").take(take),
                 pa.array(low // p.sequence_tokens), pa.array(low % p.sequence_tokens), b.column("source").take(take),
                 b.column("window").take(take), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "window", "ids"])

    return met.mapInArrow(cut, _pieces_schema(id_type))


def _pieces_schema(id_type: str) -> str:
    return (f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, source string, "
            "window long, ids binary")


def pack(docs: DataFrame, path: str, p: Packing = Packing(), targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, source, window, ids``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers. ``targets`` maps sources to
    weights; a source without one keeps its own share of all tokens.
    """
    tokens = checkpointed(tokenized(docs, path, p.end_id))
    totals = checkpointed(tokens.groupBy("task", "source").agg(F.sum("n_tokens").alias("n")))
    order = W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = checkpointed(totals.select("task", F.col("source").alias("queue"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")))
    lengths_of = checkpointed(totals.groupBy("source").agg(F.sum("n").alias("n")))
    if lengths_of.count() > CLOSED_FORM_SOURCES:
        return _pack_many(tokens, bases, lengths_of, p, targets)
    queues = lengths_of.orderBy("source").collect()  # at most CLOSED_FORM_SOURCES rows
    names, lengths = [q["source"] for q in queues], [q["n"] for q in queues]
    shares = None
    if targets is not None:
        whole = sum(lengths)
        weights = [targets.get(name, n / whole) for name, n in zip(names, lengths)]
        shares = [w / sum(weights) for w in weights]
    number = {name: k for k, name in enumerate(names)}
    rounds = Rounds(lengths, shares, p)
    small = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases
    placed = tokens.join(small, (tokens["task"] == bases["task"]) & tokens["source"].eqNullSafe(bases["queue"])).select(
        "doc_id", "source", "n_tokens", (F.col("before") + F.col("base")).alias("place"), "ids")
    id_type = placed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source = np.array([number[s] for s in b.column("source").to_pylist()], np.int64)
            place, size = b.column("place").to_numpy(), b.column("n_tokens").to_numpy()
            row, start, length, window, at = rounds.pieces(source, place, size)
            packed = b.column("ids").to_pylist()
            wide = {}
            for begin in range(0, len(row), 4096):  # small output batches: ids are the bulk
                own = slice(begin, begin + 4096)
                cut = []
                for r, s, n in zip(row[own].tolist(), start[own].tolist(), length[own].tolist()):
                    if r not in wide:
                        wide = {r: np.frombuffer(packed[r], f"<u{len(packed[r]) // int(size[r])}").astype("<u4").tobytes()}
                    cut.append(wide[r][4 * s:4 * (s + n)])
                take = pa.array(row[own])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), pa.array(start[own]), pa.array(length[own]),
                     b.column("n_tokens").take(take), pa.array(at[own] // p.sequence_tokens),
                     pa.array(at[own] % p.sequence_tokens), b.column("source").take(take), pa.array(window[own]),
                     pa.array(cut, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "window", "ids"])

    return placed.mapInArrow(run, _pieces_schema(id_type))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "source", "window")
