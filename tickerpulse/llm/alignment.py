"""Cross-tokenizer alignment: which tokens of two tokenizers end at the same byte, and how often.

Tokenizer A is a byte-level BPE and reads a space and the text; tokenizer B is a piece model that adds
the space itself. A place where tokens of both end closes a group; the A and B token that end there are
linked. A pair's count is the number of its links in the whole corpus.

1. **First pass.** Every task aligns its documents and adds up its links by pair. Both tokenizers cut
   between a character that is no white space and a space (and around a single line end), so stretches
   between such cuts are aligned by themselves, each different one once, and kept in a bounded memo.
2. **Minimal perfect hash.** The distinct pairs are dealt into parts of bounded size; each part's task
   finds, level by level, the places that only one of its keys hashes to and sets their bits; the others
   go to the next level. A key's number is the rank of its bit over all parts: 0 to n - 1, without gaps.
3. **Tree-summed vectors.** The tasks' sums become dense vectors indexed by the hash, in blocks: several
   tasks' sums per vector, then vectors added by (block, branch), then by block. The key stands beside
   its count, so a pair that the hash does not know is noticed.
4. **Second pass.** The documents are aligned again; counts come from the vectors.

Hash, keys and counts are broadcast while they number at most ``Sizes.broadcast_pairs`` (under 17 bytes a
pair); beyond that the links of the second pass are joined with the counted pairs instead, with the same
results. The vocabularies bound the pairs, but not tightly enough for a broadcast.

Defined results: a text that is null or empty, or whose A or B token bytes do not spell it (for example
one that holds U+2581), has no tokens: zeros and an empty string; such texts count nowhere. Repeated rows
count each time; ids may be null or repeated; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, compress, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import _BYTES, GROUP_CHARS

MEMO_STRETCHES = 500_000
#: A pair is ``a << SHIFT | b``; ids of B are below ``1 << SHIFT``, those of A below ``1 << 31``.
SHIFT = 24
_CUT = re.compile(r"(?<=\S)(?= )(?! \Z)")  # a space alone at the end stays with its word: B adds none to nothing
_LATIN = re.compile("[\\x00-\u024f]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Sizes:
    """``part_keys``: keys of one part of the hash; ``block``: entries of one block of a vector;
    ``merge``: tasks whose sums go into one vector; ``branch``: vectors added at once."""
    broadcast_pairs: int = 4_000_000
    part_keys: int = 50_000
    block: int = 1 << 14
    merge: int = 8
    branch: int = 16


_SEPARATORS = ",|;\n"  # after a token in the groups string; a line end closes a stretch


class Aligner:
    """Alignment of whole texts, by stretches that both tokenizers cut at.

    A stretch's key is its text without the space it begins with; one that begins with a line end, and one
    with white space inside or at its end, is its own key (the latter begin with a space, the former never does).
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        shown = {c: bytes([k]) for k, c in _BYTES.items()}
        self.bytes_a = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values(), default=0) + 1)
        for t, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = b"".join(shown.get(c) or c.encode("latin-1") for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        if len(pieces) > 1 << SHIFT or len(self.bytes_a) > 1 << 31:
            raise ValueError("too many token ids for a pair of 55 bits")
        # A's split pattern ends a token before white space; a piece of B may begin with spaces, but one
        # with a space further on could reach over a cut, and so could one with a line end
        shape = json.loads(self.a.to_str())
        split = shape["pre_tokenizer"] or {}
        byte_level = (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.cuts = byte_level and not any("▁" in p.lstrip("▁") for p in pieces)
        self.lines = self.cuts and not any("\n" in p for p in pieces) and self.b.encode("\n", out_type=str) == ["▁", "<0x0A>"]
        self.fast = self._ranked(shape) if byte_level else None
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.ids = max(len(self.bytes_a), len(pieces))
        self.shown = [f"{i}{c}" for c in _SEPARATORS for i in range(self.ids)]
        self.clear()

    def clear(self) -> None:
        """An empty memo: stretches by number, and what is known of each."""
        self.memo: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((3, 0), np.int64)       # n_a, n_b, n_groups
        self.sizes = self.pairs = np.zeros(0, np.int64)  # pairs of a stretch, and all of them in order
        self.unspelt = np.zeros(0, bool)

    def full(self) -> bool:
        return len(self.memo) > MEMO_STRETCHES

    def _ranked(self, shape: dict):
        """The same byte-level BPE by ranks, which is faster, if its ids follow the order of its merges."""
        import tiktoken
        from public_tokenizers import PATTERN
        vocab = shape["model"]["vocab"]
        merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in shape["model"]["merges"]]
        if shape["normalizer"] or any(a >= b for a, b in zip([255, *merged], merged)):
            return None
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in vocab.values()}, special_tokens={})

    def stretches(self, text: str) -> list[str]:
        """Keys of the text's stretches; some may be no keys (``irregular``): then ``cut_exactly``."""
        if not self.cuts:
            return [" " + text]
        if "  " in text or text[0] in " \n" or text[-1] in " \n" or "\n\n" in text or "\n " in text or " \n" in text:
            return self.cut_exactly(text)
        return (text.replace("\n", " \n") if self.lines else text).split(" ")

    @staticmethod
    def irregular(key: str) -> bool:
        """A piece between two spaces (or a space and a line end) that does not end where both tokenizers cut."""
        return not key or (key[0] != " " and key[-1].isspace())

    def cut_exactly(self, text: str) -> list[str]:
        """Keys of the stretches between a character that is no white space and a space."""
        if not self.cuts:
            return [" " + text]
        return [s if len(s.split()) != 1 or s[1].isspace() or s[-1].isspace() else s[1:] for s in _CUT.split(" " + text)]

    def learn(self, keys: list[str]) -> None:
        """Align stretches that the memo lacks. Plain ones are put together for A, which cuts between them anyway,
        by ranks if their characters are sorted alike by every version of the split pattern."""
        plain, odd = [k for k in keys if k[0] != " "], [k for k in keys if k[0] == " "]
        groups = [(plain, True)]
        if not self.fast or not _LATIN.fullmatch("".join(plain)):
            latin = [bool(self.fast and _LATIN.fullmatch(k)) for k in plain]
            groups = [(list(compress(plain, latin)), True), ([k for k, x in zip(plain, latin) if not x], False)]
        for own, by_rank in groups:
            if own:
                text = "".join([k if k[0] == "\n" else " " + k for k in own])
                self._learn(own, text, self.fast.encode_ordinary(text) if by_rank else self.a.encode(text, add_special_tokens=False).ids)
        if odd:
            coded = self.a.encode_batch_fast(odd, add_special_tokens=False)
            self._learn(odd, "".join(odd), list(chain.from_iterable([c.ids for c in coded])))

    def _learn(self, keys: list[str], joined: str, ids_a: list[int]) -> None:
        """Align stretches that make up ``joined`` and whose A tokens, one stretch after the other, are ``ids_a``."""
        odd = keys[0][0] == " "
        coded = self.b.encode([k[1:] for k in keys] if odd else keys, num_threads=1)
        line = [k[0] == "\n" for k in keys]
        if any(line):
            coded = [c[1:] if x else c for c, x in zip(coded, line)]  # B adds a space where the text has none
        text = joined.encode()
        size = np.array(list(map(len, keys if joined.isascii() else map(str.encode, keys))), np.int64)
        if not odd:
            size += 1 - np.array(line, np.int64)
        a, n_b = np.array(ids_a, np.int64), np.array(list(map(len, coded)), np.int64)
        b = np.fromiter(chain.from_iterable(coded), np.int64, int(n_b.sum()))
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != text:
            raise ValueError("tokenizer A does not spell its text")
        ends, end_a, end_b = np.cumsum(size), np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        bad = _by_owner(self.size_b[b], n_b) != size
        if not bad.any() and b"".join(map(self.bytes_b.__getitem__, b.tolist())) != text:
            bad = np.array([b"".join(map(self.bytes_b.__getitem__, c)) != text[e - n:e] for c, e, n in zip(coded, ends.tolist(), size.tolist())])
        if bad.any():  # the others by themselves
            good = ~bad
            self._note(list(compress(keys, bad)), [""] * int(bad.sum()), np.zeros((3, int(bad.sum())), np.int64), np.zeros(0, np.int64), True)
            if good.any():
                rest = b"".join([text[e - n:e] for e, n, g in zip(ends.tolist(), size.tolist(), good.tolist()) if g]).decode()
                self._learn(list(compress(keys, good)), rest, a[np.repeat(good, size)[end_a - 1]].tolist())
            return
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        # the groups string: A's tokens of a group, B's tokens of it, the next group
        order = np.empty(len(a) + len(b), np.int64)
        before = np.append(0, last_b + 1)[group_a]
        order[np.arange(len(a)) + before] = a + np.where(last_a[group_a] == np.arange(len(a)), self.ids, 0)
        closes = np.where(np.isin(common, ends, assume_unique=True), 3 * self.ids, 2 * self.ids)
        order[np.arange(len(b)) + last_a[group_b] + 1] = b + np.where(last_b[group_b] == np.arange(len(b)), closes[group_b], 0)
        groups = "".join(map(self.shown.__getitem__, order.tolist())).split("\n")[:-1]
        n_a, n_groups = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (end_a, common))
        self._note(keys, groups, np.stack([n_a, n_b, n_groups]), a[last_a] << SHIFT | b[last_b], False)

    def _note(self, keys: list[str], groups: list[str], numbers: np.ndarray, pairs: np.ndarray, unspelt: bool) -> None:
        self.memo.update(zip(keys, count(len(self.memo))))
        self.groups.extend(groups)
        self.numbers = np.hstack([self.numbers, numbers])
        self.sizes, self.pairs = np.append(self.sizes, numbers[2]), np.append(self.pairs, pairs)
        self.unspelt = np.append(self.unspelt, np.full(len(keys), unspelt))


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner, with its memo, kept between tasks."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def _by_owner(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole-number sums of the first ``sizes[0]`` values, the next ``sizes[1]``, and so on."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


class Group:
    """A group of texts: which stretches of the memo each one consists of; unspelt texts are left out."""

    def __init__(self, align: Aligner, texts: list[str | None]):
        cut = [align.stretches(t) if t else [] for t in texts]
        flat, which = self._look_up(align, cut)
        missing = np.flatnonzero(which < 0).tolist()
        own = [flat[i] for i in missing]
        bad = {k for k in dict.fromkeys(own) if align.irregular(k)}
        if bad:
            places = [i for i, k in zip(missing, own) if k in bad]
            again = set((np.searchsorted(self.starts, places, side="right") - 1).tolist())
            cut = [align.cut_exactly(t) if k in again else own for k, (t, own) in enumerate(zip(texts, cut))]
            flat, which = self._look_up(align, cut)
            missing = np.flatnonzero(which < 0).tolist()
            own = [flat[i] for i in missing]
        if missing:
            align.learn(list(dict.fromkeys(own)))
            which[missing] = [align.memo[k] for k in own]
        self.align, self.texts = align, len(texts)
        wrong = _by_owner(align.unspelt[which], np.diff(self.starts))
        self.spelt = wrong == 0
        self.used, self.which = which[np.repeat(self.spelt, np.diff(self.starts))], which

    def _look_up(self, align: Aligner, cut: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """All keys, and their numbers in the memo (-1: not there)."""
        flat = list(chain.from_iterable(cut))
        self.starts = np.concatenate(([0], np.cumsum([len(own) for own in cut], dtype=np.int64)))
        return flat, np.fromiter(map(align.memo.get, flat, repeat(-1)), np.int64, len(flat))

    def sums(self, per_stretch: np.ndarray) -> np.ndarray:
        """``per_stretch`` added up by text."""
        return np.where(self.spelt, _by_owner(per_stretch[self.which], np.diff(self.starts)), 0)

    def times(self) -> np.ndarray:
        """How often each stretch of the memo comes in the group's spelt texts."""
        return np.bincount(self.used, minlength=len(self.align.sizes))

    def strings(self) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        which, starts, groups = self.which.tolist(), self.starts.tolist(), self.align.groups
        return [";".join(map(groups.__getitem__, which[s:e])) if ok else ""
                for s, e, ok in zip(starts, starts[1:], self.spelt.tolist())]


def _grouped(batch: pa.RecordBatch, align: Aligner) -> Iterator[tuple[int, int, Group]]:
    """The batch's texts in groups of bounded size (a longer text is a group of its own)."""
    first, size, texts = 0, 0, []
    for k, t in enumerate(batch.column("text")):
        texts.append(t.as_py())
        size += len(texts[-1] or "")
        if size >= GROUP_CHARS:
            yield first, k + 1, Group(align, texts)
            first, size, texts = k + 1, 0, []
    if texts:
        yield first, first + len(texts), Group(align, texts)


def _added(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and their sums, those above 0."""
    keys, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, sums)
    return keys[total > 0], total[total > 0]


def count_links(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """``pair, n``: links by pair, added up within tasks (a pair may come several times from one task)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        times = np.zeros(0, np.int64)  # by stretch of the memo
        held = [np.zeros(0, np.int64)] * 2

        def flush() -> None:
            nonlocal held
            n = np.repeat(times, align.sizes[:len(times)])
            held = list(_added(np.append(held[0], align.pairs[:len(n)]), np.append(held[1], n)))

        for b in batches:
            for _, _, g in _grouped(b, align):
                own = g.times()
                own[:len(times)] += times
                times = own
                if align.full():
                    flush()
                    align.clear()
                    times = np.zeros(0, np.int64)
                    if len(held[0]) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["pair", "n"])
                        held = [np.zeros(0, np.int64)] * 2
        flush()
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["pair", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pair long, n long")


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def build_part(keys: np.ndarray) -> tuple[list[int], bytes]:
    """Minimal perfect hash of distinct ``keys``: sizes of its levels (multiples of 64) and their bits."""
    sizes, bits = [], []
    while len(keys):
        m = -(-2 * len(keys) // 64) * 64
        place = (_hash(keys, len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(place, minlength=m) == 1
        sizes.append(m)
        bits.append(np.packbits(alone, bitorder="little"))
        keys = keys[~alone[place]]
    return sizes, b"".join(x.tobytes() for x in bits)


class PerfectHash:
    """Numbers 0 to n - 1 of n keys, from the bits of all parts."""

    def __init__(self, n_parts: int, parts: Iterable[tuple[int, list[int], bytes]]):
        own = {p: (sizes, bits) for p, sizes, bits in parts}
        depth = max((len(s) for s, _ in own.values()), default=0)
        self.n_parts = n_parts
        self.size = np.zeros((depth, n_parts), np.int64)
        self.start = np.zeros((depth, n_parts), np.int64)
        at = 0
        for p, (sizes, _) in own.items():
            for level, m in enumerate(sizes):
                self.size[level, p], self.start[level, p] = m, at
                at += m
        self.words = np.frombuffer(b"".join(bits for _, bits in own.values()), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.n = int(ones.sum())

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; an unknown key gets -1 or the number of some other key."""
        out = np.full(len(keys), -1, np.int64)
        left, part = np.arange(len(keys)), keys % self.n_parts
        for level in range(len(self.size)):
            m = self.size[level][part[left]]
            left, m = left[m > 0], m[m > 0]
            place = self.start[level][part[left]] + (_hash(keys[left], level) % m.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[place >> 6] + below)[hit]
            left = left[~hit]
        return out


def perfect_hash(pairs: DataFrame, n: int, sizes: Sizes) -> PerfectHash:
    """The hash of ``n`` distinct ``pair`` s: one task per part finds its bits; some 5 bits a pair reach the driver."""
    n_parts = n // sizes.part_keys * 2 + 1  # odd, as the key's low bits are one tokenizer's id

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("pair").to_numpy()
        levels, bits = build_part(keys)
        return pa.table({"part": pa.array([int(keys[0]) % n_parts], pa.int64()), "sizes": pa.array([levels], pa.list_(pa.int64())),
                         "bits": pa.array([bits], pa.binary())})

    parts = pairs.groupBy((F.col("pair") % n_parts).alias("part")).applyInArrow(build, "part long, sizes array<long>, bits binary")
    return PerfectHash(n_parts, ((r["part"], r["sizes"], bytes(r["bits"])) for r in parts.collect()))


_VECTOR = "branch long, block long, keys binary, counts binary"


def dense_vectors(partial: DataFrame, hashed, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Keys (plus one; 0: none) and corpus-wide counts by hash number; ``hashed``: broadcast ``PerfectHash``."""
    n = hashed.value.n
    size = sizes.block

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(-(-n // size) * size, np.int64), np.zeros(-(-n // size) * size, np.int64)
        for b in batches:
            pair, times = (b.column(c).to_numpy() for c in ("pair", "n"))
            at = hashed.value.number(pair)
            keys[at] = pair + 1
            np.add.at(counts, at, times)
        for k in np.flatnonzero(keys.reshape(-1, size).any(axis=1)).tolist():
            own = slice(k * size, (k + 1) * size)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([k], pa.int64()), pa.array([keys[own].tobytes()]),
                                              pa.array([counts[own].tobytes()])], ["branch", "block", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        """One branch and block: no more than ``Sizes.branch`` vectors' blocks."""
        keys, counts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
            np.maximum(keys, np.frombuffer(k, "<i8"), out=keys)
            counts += np.frombuffer(c, "<i8")
        head = table.slice(0, 1)
        return pa.table({"branch": pa.array([head.column("branch")[0].as_py() // sizes.branch], pa.int64()), "block": head.column("block"),
                         "keys": [keys.tobytes()], "counts": [counts.tobytes()]})

    tasks = max(1, partial.rdd.getNumPartitions() // sizes.merge)
    vectors = partial.coalesce(tasks).mapInArrow(scatter, _VECTOR).withColumn("branch", F.spark_partition_id().cast("long"))
    while tasks > 1:
        tasks = -(-tasks // sizes.branch)
        vectors = vectors.groupBy(F.floor(F.col("branch") / sizes.branch), "block").applyInArrow(add, _VECTOR)
    keys, counts = np.zeros(-(-n // size) * size, np.int64), np.zeros(-(-n // size) * size, np.int64)
    for r in vectors.collect():  # bounded by Sizes.broadcast_pairs
        own = slice(r["block"] * size, (r["block"] + 1) * size)
        keys[own], counts[own] = np.frombuffer(bytes(r["keys"]), "<i8"), np.frombuffer(bytes(r["counts"]), "<i8")
    return keys[:n], counts[:n]


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string"


def align_documents(docs: DataFrame, path_a: str, path_b: str, sizes: Sizes = Sizes(), text_col: str = "text",
                    id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row.

    ``n_best``: links whose pair is the most frequent one of its B token in the corpus (ties count);
    ``count_sum``: the counts of all links added up; ``groups``: ``a1,a2|b1;a3|b2,b3``, empty without tokens.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    partial = checkpointed(count_links(docs, path_a, path_b, text_col))
    distinct = checkpointed(partial.select("pair").distinct())
    n = distinct.count()
    if n > sizes.broadcast_pairs:
        return _aligned_by_join(narrow, partial, path_a, path_b)
    sc = docs.sparkSession.sparkContext
    hashed = sc.broadcast(perfect_hash(distinct, n, sizes))
    vectors = sc.broadcast(dense_vectors(partial, hashed, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, (keys, counts) = aligner(path_a, path_b), vectors.value
        low = (keys - 1) & ((1 << SHIFT) - 1)
        best = np.zeros(int(low.max(initial=0)) + 1, np.int64)
        np.maximum.at(best, low, counts)
        known, per = None, np.zeros((3, 0), np.int64)  # by stretch of the memo: n_best, count_sum, pairs without a count
        for b in batches:
            for first, last, g in _grouped(b, align):
                if known is not align.memo:  # clearing makes a new one
                    known, per = align.memo, np.zeros((3, 0), np.int64)
                if per.shape[1] < len(align.sizes):
                    size = align.sizes[per.shape[1]:]
                    pairs = align.pairs[len(align.pairs) - int(size.sum()):]
                    at = hashed.value.number(pairs)
                    fits = at >= 0
                    fits[fits] = keys[at[fits]] == pairs[fits] + 1
                    count = np.zeros(len(pairs), np.int64)
                    count[fits] = counts[at[fits]]
                    is_best = fits.copy()
                    is_best[fits] = count[fits] == best[pairs[fits] & ((1 << SHIFT) - 1)]
                    per = np.hstack([per, [_by_owner(x, size) for x in (is_best, count, ~fits)]])
                if per[2][g.used].any():
                    raise RuntimeError("the documents changed between the two passes: a pair has no count")
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, last - first), *[pa.array(g.sums(x)) for x in (*align.numbers, align.sizes, *per[:2])],
                     pa.array(g.strings())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
                if align.full():
                    align.clear()

    return narrow.mapInArrow(run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _aligned_by_join(narrow: DataFrame, partial: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The same rows by joins, for any number of pairs: links are added up by (document, pair) before they move."""
    narrow = checkpointed(narrow.withColumn("uid", F.monotonically_increasing_id()))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        for b in batches:
            for first, last, g in _grouped(b, align):
                rows = [b.column(c).slice(first, last - first) for c in ("uid", "doc_id")]
                yield pa.RecordBatch.from_arrays([*rows, *[pa.array(g.sums(x)) for x in (*align.numbers, align.sizes)], pa.array(g.strings())],
                                                 ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
                if align.full():
                    align.clear()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        for b in batches:
            for first, _, g in _grouped(b, align):
                which, size = g.used, align.sizes[g.used]
                begin = np.cumsum(align.sizes) - align.sizes
                place = np.repeat(begin[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                key = np.stack([np.repeat(np.arange(g.texts), g.sums(align.sizes)), align.pairs[place]])
                (doc, pair), times = np.unique(key, axis=1, return_counts=True)
                uid = b.column("uid").to_numpy()[first + doc]
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(pair), pa.array(times, pa.int64())], ["uid", "pair", "times"])
                if align.full():
                    align.clear()

    total = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    low = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    top = F.max("n").over(Window.partitionBy(low))  # a B token's pairs: no more than A has tokens
    total = total.withColumn("is_best", (F.col("n") == top).cast("long"))
    found = (narrow.mapInArrow(links, "uid long, pair long, times long").join(total, "pair").groupBy("uid")
             .agg(F.sum(F.col("times") * F.col("is_best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    zero: Column = F.lit(0).cast("long")
    return (narrow.mapInArrow(aligned, f"uid long, doc_id {id_type}, {_ALIGNED}").join(found, "uid", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups"))


def digest(aligned: DataFrame) -> DataFrame:
    """The rows with the groups' SHA-256 (empty without tokens) instead of the groups."""
    sha = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", sha).drop("groups")
