"""Periodic runs of words, found on a grammar (Re-Pair) of each document's word ids.

A run is a stretch of consecutive words with smallest period q, at least ``Shape.length`` words and
``Shape.exponent`` periods long, that no neighbouring word extends. The documents of a bounded group
are compressed together, each with word ids and rules of its own:

1. **Re-Pair.** A round counts every pair of neighbouring symbols in its document and replaces the
   pairs that occur twice or more and are more frequent than the pairs they overlap (ties by a hash
   of the pair) by new symbols; rounds go on until no pair repeats. A pair that occurs once never
   repeats later, so what lies between two such pairs is final and leaves the work.
2. **Boundaries.** Every run lies in the lowest rule that holds it whole and crosses that rule's
   boundary between left and right part. What stays at the end (the start rule) is a balanced tree
   of further boundaries. A run that crosses a boundary repeats the two words beside it once per
   period, so a boundary whose word pair is too rare inside its rule is passed over; the others
   are searched for squares that begin or end at the boundary, once per rule.
3. **Translation.** A rule's runs are moved to all places where the rule was used.
4. **Merging.** Of intervals with one period, those inside another are parts of the same run that a
   smaller rule has seen cut off, and go.

All steps are exact; hashes only choose what is compared word by word.

Defined results: a null text counts as empty and has no words and no runs; repeated rows and null ids
give one row each; further columns are ignored; an empty table gives an empty result. A text is
never cut: a very long one is a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_CHARS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so products modulo 2^64 keep all bits


@dataclass(frozen=True)
class Shape:
    """What counts as a run: at least ``length`` words and ``exponent`` periods (4 or more)."""
    length: int = 6
    exponent: int = 4

    def __post_init__(self):
        if self.exponent < 4 or self.length < self.exponent:
            raise ValueError("a run needs four or more periods, and no fewer words than periods")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


class Neighbours:
    """The word pairs of a group by place, and how often each occurs in a stretch."""

    def __init__(self, kind: np.ndarray):
        self.kind, self.wide = kind, len(kind) + 2
        self.order = np.argsort(kind, kind="stable")
        self.keys = kind[self.order] * self.wide + self.order

    def span(self, place, lo, hi):
        """Where in ``order`` the occurrences of the pair at ``place`` lie that are inside ``lo..hi``."""
        base = self.kind[place] * self.wide
        return np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi - 1)


class Grammar:
    """Re-Pair over a group of documents: rules by round, and the start rule."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        """``words``: ids that differ between documents; ``starts``: first word of each document."""
        n = len(words)
        symbol, begin, end = words, np.arange(n), np.arange(1, n + 1)
        cut = np.zeros(n, bool)  # no pair reaches over the symbol's right edge
        cut[np.append(starts[1:], n) - 1] = True
        self.pairs: Neighbours | None = None
        self.rules: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        final, used = [], int(words.max()) + 1 if n else 0
        while len(symbol) > 1:
            key = symbol[:-1] * used + symbol[1:]
            key[cut[:-1]] = -1
            kinds, kind = np.unique(key, return_inverse=True)
            if self.pairs is None:
                self.pairs = Neighbours(kind)
            # equal neighbouring pairs overlap (a a a): every second one can be replaced
            fresh = np.append(True, kind[1:] != kind[:-1])
            streak = np.cumsum(fresh) - 1
            heads = np.flatnonzero(fresh)
            free = (np.arange(len(kind)) - heads[streak]) % 2 == 0
            n_free = np.bincount(kind[free], minlength=len(kinds))
            repeated = n_free >= 2
            if kinds[0] == -1:
                repeated[0] = False
            chosen = np.flatnonzero(repeated)
            if not len(chosen):
                break
            rank = np.full(len(kinds), -1)
            rank[chosen[np.lexsort((_mixed(kinds[chosen]), n_free[chosen]))]] = np.arange(len(chosen))
            height = np.concatenate(([-1], rank[kind[heads]], [-1]))
            top = (height[1:-1] >= 0) & (height[1:-1] > height[:-2]) & (height[1:-1] > height[2:])
            at = np.flatnonzero(top[streak] & free)
            at = at[np.bincount(kind[at], minlength=len(kinds))[kind[at]] >= 2]
            rule = np.unique(kind[at], return_inverse=True)[1]
            self.rules.append((rule, begin[at], begin[at + 1], end[at + 1]))
            # what no repeated pair touches is final
            live = repeated[kind]
            keep = np.append(live, False) | np.append(False, live)
            gone = ~keep
            final.append(begin[gone])
            cut = np.append(~live, True)
            symbol, end = symbol.copy(), end.copy()
            symbol[at], end[at], cut[at] = used + rule, end[at + 1], cut[at + 1]
            keep[at + 1] = False
            symbol, begin, end, cut = symbol[keep], begin[keep], end[keep], cut[keep]
            used += int(rule.max()) + 1
        final.append(begin)
        self.top = np.sort(np.concatenate(final)) if final else begin


def start_boundaries(top: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lo, boundary, hi`` of the balanced tree over each document's final symbols (``top``: their first words)."""
    doc = np.searchsorted(starts, top, side="right") - 1
    first = np.searchsorted(top, starts)           # a document's first symbol
    after = np.append(first[1:], len(top))[doc]    # and the symbol after its last one
    place = np.arange(len(top))
    j = place - first[doc]
    width = j & -j
    lo, hi = top[place - width], np.append(top, n)[np.minimum(place + width, after)]
    inner = j > 0
    return lo[inner], top[inner], hi[inner]


class RunFinder:
    """Runs of a group of documents."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, shape: Shape):
        self.words, self.starts, self.shape = words, starts, shape
        self.grammar = Grammar(words, starts)
        self._prefix: tuple[np.ndarray, np.ndarray] | None = None

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` words at ``a`` and ``b`` (a < b) have one hash."""
        if self._prefix is None:
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(self.words), _MIX))))
            total = np.cumsum(_mixed(self.words) * power[:-1])
            self._prefix = power, np.concatenate(([np.uint64(0)], total))
        power, total = self._prefix
        return (total[a + size] - total[a]) * power[b - a] == total[b + size] - total[b]

    def crossing(self, lo: int, at: int, hi: int) -> list[tuple[int, int, int]]:
        """``(start, end, period)`` of the runs inside ``lo..hi`` that hold the words ``at - 1`` and ``at``."""
        pairs, words = self.grammar.pairs, self.words
        a, b = pairs.span(at - 1, lo, hi)
        near = pairs.order[a:b]
        # of four periods, two lie right of the boundary or two left of it
        right, left = near[near >= at] - (at - 1), (at - 1) - near[near < at - 1][::-1]
        right, left = right[2 * right <= hi - at], left[2 * left <= at - lo]
        if len(right) > 4:
            right = right[self._equal(np.full(len(right), at), at + right, right)]
        if len(left) > 4:
            left = left[self._equal(at - 2 * left, at - left, left)]
        found: list[tuple[int, int, int]] = []
        while len(right) or len(left):
            q = int(min(right[:1].tolist() + left[:1].tolist()))
            for inside in ([at] if len(right) and right[0] == q else []) + ([at - q - 1] if len(left) and left[0] == q else []):
                differ = words[lo:hi - q] != words[lo + q:hi]
                if differ[inside - lo]:
                    continue
                ahead = differ[inside - lo:]
                e = inside + (int(ahead.argmax()) if ahead.any() else len(ahead)) + q
                back = differ[:inside - lo][::-1]
                s = inside - (int(back.argmax()) if back.any() else len(back))
                if s < at < e and e - s >= max(self.shape.length, self.shape.exponent * q) \
                        and not any((s, e) == (x, y) and q % p == 0 for x, y, p in found):
                    found.append((s, e, q))
                    right = right[(right % q > 0) | (at + right >= e)]  # multiples are the same run
                    left = left[(left % q > 0) | (at - 1 - left < s)]
            right, left = right[right > q], left[left > q]
        return found

    def _worth(self, lo: np.ndarray, at: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Boundaries that a run may cross: its pair of words comes once per period, so three times or more."""
        pick = np.flatnonzero(hi - lo >= self.shape.length)
        a, b = self.grammar.pairs.span(at[pick] - 1, lo[pick], hi[pick])
        return pick[b - a >= self.shape.exponent - 1]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``start, end, period`` of all runs by start, then period; places are those of the group."""
        pieces: list[tuple[np.ndarray, int, int]] = []   # starts, length, period
        if self.grammar.pairs is not None:
            for rule, lo, at, hi in self.grammar.rules:
                _, first = np.unique(rule, return_index=True)
                for r in self._worth(lo[first], at[first], hi[first]).tolist():
                    k = first[r]
                    own = self.crossing(int(lo[k]), int(at[k]), int(hi[k]))
                    if own:
                        places = lo[rule == r]
                        pieces += [(places + (s - lo[k]), e - s, q) for s, e, q in own]
            lo, at, hi = start_boundaries(self.grammar.top, self.starts, len(self.words))
            for k in self._worth(lo, at, hi).tolist():
                pieces += [(np.array([s]), e - s, q) for s, e, q in self.crossing(int(lo[k]), int(at[k]), int(hi[k]))]
        if not pieces:
            return (np.zeros(0, np.int64),) * 3
        sizes = [len(p[0]) for p in pieces]
        start = np.concatenate([p[0] for p in pieces])
        end = start + np.repeat([p[1] for p in pieces], sizes)
        period = np.repeat([p[2] for p in pieces], sizes)
        order = np.lexsort((-end, start, period))
        start, end, period = start[order], end[order], period[order]
        reach = period * (len(self.words) + 1) + end
        whole = np.append(True, reach[1:] > np.maximum.accumulate(reach)[:-1])
        start, end, period = start[whole], end[whole], period[whole]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def word_runs(documents: list[list[bytes]], shape: Shape = Shape()) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Runs of several documents' words: offsets by document, ``(start, length, period)`` rows with places in
    the document, and for every word of the group whether it repeats a run's first period."""
    ids: list[int] = []
    starts, used = [], 0
    for words in documents:
        starts.append(len(ids))
        number = dict(zip(dict.fromkeys(words), count(used)))
        ids.extend(map(number.__getitem__, words))
        used += len(number)
    full = [k for k, words in enumerate(documents) if words]
    start, end, period = RunFinder(np.array(ids, np.int64), np.array(starts, np.int64)[full], shape).runs() if ids else (np.zeros(0, np.int64),) * 3
    edges = np.append(starts, len(ids)).astype(np.int64)
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, end, -1)
    offsets = np.searchsorted(start, edges)
    rows = np.stack([start - edges[np.searchsorted(edges, start, side="right") - 1], end - start, period], axis=1)
    return offsets.tolist(), rows, np.cumsum(step[:-1]) > 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, shape: Shape = Shape(), text_col: str = "text", id_col: str = "doc_id",
              words_of: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    ``runs``: array of (start, length, period) in words, by start, then period; ``collapsed``: the words
    that no run holds after its first period, joined by one space. Words are separated by the six
    ASCII white-space characters. ``words_of(id, words)`` may replace a document's words first.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def group(ids: pa.Array, documents: list[list[bytes]]) -> pa.RecordBatch:
        offsets, rows, again = word_runs(documents, shape)
        out, at = [], 0
        for k, words in enumerate(documents):
            if offsets[k] < offsets[k + 1]:
                words = [w for w, gone in zip(words, again[at:at + len(words)].tolist()) if not gone]
            out.append(b" ".join(words))
            at += len(documents[k])
        struct = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(_RUN))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(w) for w in documents], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct), pa.array(out, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            first, size, documents = 0, 0, []
            for k, (doc_id, text) in enumerate(zip(ids.to_pylist(), b.column("text"))):
                words = (text.as_py() or "").encode().split()
                documents.append(words_of(doc_id, words) if words_of else words)
                size += sum(map(len, words))
                if size >= GROUP_CHARS:
                    yield group(ids.slice(first, k + 1 - first), documents)
                    first, size, documents = k + 1, 0, []
            if documents:
                yield group(ids.slice(first), documents)

    return narrow.mapInArrow(run, f"doc_id {id_type}, n_words long, "
                                  "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest run, and hashes of the runs and of the kept words."""
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
                    F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words"))
