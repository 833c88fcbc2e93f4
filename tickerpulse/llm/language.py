"""Language of every word in code-switched text: a linear-chain conditional random field.

A word's form is its letters in lower case. Features of a form are its affixes and character n-grams
(hashed to ``Settings.buckets`` weights a language) and its lexicon vector; transitions between
neighbouring words and the weights are learned together by maximum conditional likelihood. Whole texts
are labelled by forward-backward, and a document's language is the one its words with letters have most
posterior mass in.

* **Lexicon.** Words are counted by language over all training rows. A word enters if it makes up
  ``Settings.share`` of the words of some language or more, so a language has no more than 1 / share
  of them, whatever the corpus. Its vector: the log of its share in each language against its mean share.
* **Fitting sample.** Training texts are cut into windows of ``Settings.width`` words; the
  ``Settings.windows`` different windows a language with the smallest hashes are fitted on (a bounded
  sample of labelled rows). Pieces of them are strung together in mixed order, so that changes of
  language are seen. A label is a document's, so some windows of mixed documents are labelled
  wrongly: the model is fitted, windows it gives little mass to their label go, and it is fitted again.
* **Forward-backward** runs over all words of a group of documents at once: products of the step
  matrices inside blocks of words, then from block to block, then inside the blocks again.

Defined results: language ``und`` and score 0 for a null text and a text without a letter, and for every
text if there is no labelled training row; null ids are never trained on and never held out; words
without letters pass messages on but count nowhere; ties go to the language that sorts first; repeated
rows are scored each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import GROUP_CHARS

UNKNOWN = "und"
MEMO_WORDS = 400_000
COUNTED_WORDS = 300_000
GRAMS = (1, 2, 3, 4)
_NO_LETTER = re.compile(r"[^\S\n]|[^\w\n]|[\d_]")
_BLOCK = 256  # words
_SCALE = 16   # steps between scalings


@dataclass(frozen=True)
class Settings:
    windows: int = 300
    width: int = 40
    share: float = 1 / 20_000
    buckets: int = 1 << 16
    rounds: int = 30
    penalty: float = 1e-3
    piece: int = 12      # mean words of a piece between changes of language in the fitting sequences
    doubt: float = 0.3   # windows with less posterior mass on their label leave the second fit


def forms(words: list[str]) -> list[str]:
    """The letters of each word in lower case; words hold no line ends."""
    return _NO_LETTER.sub("", "\n".join(words).lower()).split("\n") if words else []


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each form's n-grams between markers (those with a marker are its affixes) and owners, one entry
    per n-gram; a form without letters has none."""
    text = "".join([f"\x02{w}\x03" if w else "" for w in words])
    size = np.fromiter((len(w) + 2 if w else 0 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found, owners = [], []
    code = np.zeros(len(points), np.uint64)
    for n in GRAMS:
        m = max(0, len(points) - n + 1)
        code = (code[:m] * np.uint64(0x100000001B3) + points[n - 1:]) & np.uint64((1 << 62) - 1)
        inside = np.flatnonzero(owner[:m] == owner[n - 1:])
        mixed = (code[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(40)).astype(np.int64) % buckets)
        owners.append(owner[inside])
    return np.concatenate(found), np.concatenate(owners)


def _by_label(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` added up by owner."""
    return np.stack([np.bincount(owner, weights=values[:, k], minlength=size) for k in range(values.shape[1])], axis=1)


def scaled(emission: np.ndarray) -> np.ndarray:
    """Emission factors of at most 1 from scores by word and label."""
    return np.exp(emission - emission.max(axis=1, keepdims=True))


class Chain:
    """Forward-backward over many sequences laid end to end.

    Words are cut into blocks, and all blocks take their j-th step together: arrays are (step, label, block).
    Messages are scaled now and then; the scale of a word's messages cancels in its results.
    """

    def __init__(self, factors: np.ndarray, first: np.ndarray, transition: np.ndarray):
        """``factors``: by word and label (``scaled``); ``first``: whether a word begins a sequence; ``transition``: scores."""
        self.n, self.k = factors.shape
        blocks = max(1, -(-self.n // _BLOCK))
        fill = blocks * _BLOCK - self.n
        e = np.concatenate([factors, np.ones((fill, self.k))]).reshape(blocks, _BLOCK, self.k)
        self.e = np.ascontiguousarray(e.transpose(1, 2, 0))
        self.first = np.ascontiguousarray(np.append(first, np.ones(fill, bool)).reshape(blocks, _BLOCK).T)
        self.t = np.exp(transition - transition.max())
        self._messages()

    def _messages(self) -> None:
        e, first, t, k = self.e, self.first, self.t, self.k
        blocks = e.shape[2]
        starts = [np.flatnonzero(f) for f in first]
        step = np.broadcast_to(np.eye(k)[:, :, None], (k, k, blocks)).copy()  # (to, from, block)
        for j in range(_BLOCK):  # each block's product of (transition or restart) times emission
            new = (t.T @ step.reshape(k, -1)).reshape(k, k, blocks)
            own = starts[j]
            if len(own):
                new[:, :, own] = step[:, :, own].sum(axis=0) / k
            new *= e[j][:, None, :]
            step = new / new.sum(axis=(0, 1)) if j % _SCALE == 0 else new
        step = np.ascontiguousarray((step / step.sum(axis=(0, 1))).transpose(2, 1, 0))  # (block, from, to)
        into, back = np.empty((blocks, k)), np.empty((blocks, k))
        v = w = np.full(k, 1 / k)
        for b in range(blocks):
            into[b] = v
            v = v @ step[b]
            v = v / v.sum()
        for b in range(blocks - 1, -1, -1):
            back[b] = w
            w = step[b] @ w
            w = w / w.sum()
        self.alpha, self.beta = np.empty_like(e), np.empty_like(e)
        v, w = np.ascontiguousarray(into.T), np.ascontiguousarray(back.T)
        for j in range(_BLOCK):
            new = t.T @ v
            own = starts[j]
            new[:, own] = v[:, own].sum(axis=0) / k
            new *= e[j]
            v = new / new.sum(axis=0) if j % _SCALE == 0 else new
            self.alpha[j] = v
        for j in range(_BLOCK - 1, -1, -1):
            self.beta[j] = w
            after = e[j] * w
            w = t @ after
            own = starts[j]
            w[:, own] = after[:, own].sum(axis=0)
            if j % _SCALE == 0:
                w /= w.sum(axis=0)

    def _by_word(self, x: np.ndarray) -> np.ndarray:
        return x.transpose(2, 0, 1).reshape(-1, self.k)[:self.n]

    def posterior(self) -> np.ndarray:
        p = self.alpha * self.beta
        return self._by_word(p / p.sum(axis=1, keepdims=True))

    def pairs(self) -> np.ndarray:
        """Expected number of each (label, next label) over all neighbours."""
        a, b = self._by_word(self.alpha), self._by_word(self.e * self.beta)
        inner = ~self.first.T.reshape(-1)[1:self.n]
        a, b = a[:-1][inner], b[1:][inner]
        z = ((a @ self.t) * b).sum(axis=1, keepdims=True)
        return (a / z).T @ b * self.t


@dataclass
class Field:
    """The fitted model. ``grams``: weights by bucket and language; ``lexicon``: rows of ``lexicon_vectors`` by
    form (the last row, of zeros, is for all others); ``lexicon_weights``: from vector to language;
    ``transition``: scores by neighbouring languages."""
    languages: list[str]
    grams: np.ndarray
    lexicon: dict[str, int]
    lexicon_vectors: np.ndarray
    lexicon_weights: np.ndarray
    transition: np.ndarray

    def vectors(self, words: list[str]) -> np.ndarray:
        return self.lexicon_vectors[[self.lexicon.get(w, -1) for w in words]].reshape(-1, len(self.languages))

    def emission(self, words: list[str]) -> np.ndarray:
        bucket, owner = grams(words, len(self.grams))
        return _by_label(owner, self.grams[bucket], len(words)) + self.vectors(words) @ self.lexicon_weights


def _sequences(windows: list[tuple[int, list[str]]], s: Settings, rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, labels and sequence starts: pieces of windows in mixed order, as many sequences as windows."""
    pieces = []
    for label, words in windows:
        at = 0
        while at < len(words):
            size = int(rng.geometric(1 / s.piece))
            pieces.append((label, words[at:at + size]))
            at += size
    order = rng.permutation(len(pieces))
    words, labels, first = [], [], []
    per = max(1, -(-len(pieces) // max(1, len(windows))))
    for k, p in enumerate(order.tolist()):
        label, own = pieces[p]
        words += own
        labels += [label] * len(own)
        first += [k % per == 0] + [False] * (len(own) - 1)
    return words, np.array(labels, np.int64), np.array(first, bool)


def fit(windows: list[tuple[int, list[str]]], languages: list[str], lexicon: dict[str, int], vectors: np.ndarray, s: Settings) -> Field:
    """Maximum penalised conditional likelihood by Adam steps over all sequences, twice (see the module's text)."""
    k = len(languages)
    model = Field(languages, np.zeros((s.buckets, k)), lexicon, vectors, np.eye(k) * 0.5, np.zeros((k, k)))
    for again in (False, True):
        words, label, first = _sequences(windows, s, np.random.default_rng(7))
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        which = np.array([known[w] for w in words], np.int64)
        bucket, owner = grams(list(known), s.buckets)
        vector = model.vectors(list(known))
        truth = np.eye(k)[label]
        inner = ~first[1:]
        seen = np.zeros((k, k))
        np.add.at(seen, (label[:-1][inner], label[1:][inner]), 1)
        params = [model.grams, model.lexicon_weights, model.transition]
        moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, s.rounds + 1):
            emission = _by_label(owner, model.grams[bucket], len(known)) + vector @ model.lexicon_weights
            chain = Chain(scaled(emission)[which], first, model.transition)
            rest = _by_label(which, truth - chain.posterior(), len(known)) / len(words)
            slope = [_by_label(bucket, rest[owner], s.buckets), vector.T @ rest, (seen - chain.pairs()) / len(words)]
            for p, g, (m, v) in zip(params, slope, moment):
                g = g - s.penalty * p / len(words)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        if not again:
            mass = posterior_mass(model, [own for _, own in windows])
            kept = [p for p, share in zip(windows, mass) if share[p[0]] >= s.doubt * share.sum()]
            if {p[0] for p in kept} == {p[0] for p in windows}:
                windows = kept
    return model


def posterior_mass(model: Field, texts: list[list[str]]) -> np.ndarray:
    """Posterior mass of each language over each text's forms with letters."""
    flat = [w for t in texts for w in t]
    out = np.zeros((len(texts), len(model.languages)))
    if flat:
        sizes = np.array([len(t) for t in texts])
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        p = Chain(scaled(model.emission(flat)), first, model.transition).posterior()
        p[[not w for w in flat]] = 0
        out = _by_label(np.repeat(np.arange(len(texts)), sizes), p, len(texts))
    return out


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, s: Settings, text_col: str, lang_col: str) -> DataFrame:
    """Rows ``lang, word, n`` (word counts of a task) and ``lang, hash, window`` (its windows with the smallest hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        least: dict[str, list[tuple[int, str]]] = {}  # a heap of (-hash, window) a language

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                by_form: Counter = Counter()
                for f, n in zip(forms(list(own)), own.values()):
                    by_form[f] += n
                del by_form[""]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(by_form), pa.string()), pa.array(list(by_form), pa.string()), pa.array(list(by_form.values()), pa.int64()),
                     pa.nulls(len(by_form), pa.int64()), pa.nulls(len(by_form), pa.string())], ["lang", "word", "n", "hash", "window"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                words = text.as_py().split()
                counts.setdefault(lang, Counter()).update(words)
                heap = least.setdefault(lang, [])
                for at in range(0, len(words), s.width):
                    window = " ".join(words[at:at + s.width])
                    h = zlib.crc32(window.encode())
                    if len(heap) < s.windows or -h >= heap[0][0]:
                        entry = (-h, window)
                        if entry not in heap:
                            heapq.heappush(heap, entry) if len(heap) < s.windows else heapq.heappushpop(heap, entry)
                if sum(map(len, counts.values())) > COUNTED_WORDS:
                    yield from flush()
        yield from flush()
        for lang, heap in least.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(heap), pa.string()), pa.nulls(len(heap), pa.string()), pa.nulls(len(heap), pa.int64()),
                 pa.array([-h for h, _ in heap], pa.int64()), pa.array([w for _, w in heap], pa.string())],
                ["lang", "word", "n", "hash", "window"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, word string, n long, hash long, window string")


def train(docs: DataFrame, s: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> Field | None:
    """The model of all rows with a language; None if there are none."""
    rows = checkpointed(training_rows(docs, s, text_col, lang_col))
    counts = rows.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = rows.where("word IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))  # a row a language: AQE measures it
    by_word = frequent.groupBy("word").agg(F.max("share").alias("most"), F.map_from_entries(F.collect_list(F.struct("lang", "share"))).alias("shares"))
    lexicon = by_word.where(F.col("most") >= s.share).orderBy("word").collect()  # no more than 1 / share words a language
    first = Window.partitionBy("lang").orderBy("hash", "window")  # Settings.windows rows a task and language
    chosen = (rows.where("window IS NOT NULL").select("lang", "hash", "window").distinct().withColumn("place", F.row_number().over(first))
              .where(F.col("place") <= s.windows).orderBy("lang", "place").collect())
    languages = sorted({r["lang"] for r in chosen})
    if not languages:
        return None
    number = {x: k for k, x in enumerate(languages)}
    share = np.array([[r["shares"].get(x, 0.0) for x in languages] for r in lexicon]).reshape(-1, len(languages))
    log = np.log(share + s.share / 100)
    vectors = np.concatenate([log - log.mean(axis=1, keepdims=True), np.zeros((1, len(languages)))])
    windows = [(number[r["lang"]], forms(r["window"].split(" "))) for r in chosen]
    return fit(windows, languages, {r["word"]: k for k, r in enumerate(lexicon)}, vectors, s)


class _Tagger:
    """Labels groups of texts; emissions of words are kept in a bounded memo."""

    def __init__(self, model: Field):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.factors = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, bool)

    def group(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, str]]]]:
        """Posterior mass by text and language, and the spans of one language in each text."""
        if len(self.memo) > MEMO_WORDS:
            self.clear()
        cut = [(t or "").encode().split() for t in texts]
        flat = [w for own in cut for w in own]
        k = len(self.model.languages)
        if not flat:
            return np.zeros((len(texts), k)), [[] for _ in texts]
        which = np.fromiter(map(self.memo.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(which < 0).tolist()
        if new:
            missing = list(dict.fromkeys([flat[i] for i in new]))
            own = forms([w.decode() for w in missing])
            self.memo.update(zip(missing, range(len(self.memo), len(self.memo) + len(missing))))
            which[new] = [self.memo[flat[i]] for i in new]
            self.factors = np.concatenate([self.factors, scaled(self.model.emission(own))])
            self.letters = np.append(self.letters, [bool(w) for w in own])
        sizes = np.array([len(own) for own in cut])
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(len(flat), bool)
        first[starts[sizes > 0]] = True
        p = Chain(self.factors[which], first, self.model.transition).posterior()
        p[~self.letters[which]] = 0
        total = np.concatenate([np.zeros((1, k)), np.cumsum(p, axis=0)])
        mass = np.maximum(total[starts + sizes] - total[starts], 0)
        return mass, self._spans(p, which, starts, sizes)

    def _spans(self, p: np.ndarray, which: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, str]]]:
        """``(first word, words, language)``; a word without letters belongs to the span before it."""
        label = np.where(self.letters[which], p.argmax(axis=1), -1)
        lettered = np.flatnonzero(label >= 0)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        fresh = np.ones(len(lettered), bool)
        fresh[1:] = (label[lettered[1:]] != label[lettered[:-1]]) | (doc[lettered[1:]] != doc[lettered[:-1]])
        out: list[list[tuple[int, int, str]]] = [[] for _ in sizes]
        heads = lettered[fresh].tolist()
        for at, after in zip(heads, [*heads[1:], len(which)]):
            d = int(doc[at])
            end = min(after, int(starts[d] + sizes[d]))
            out[d].append((at - int(starts[d]), end - at, self.model.languages[label[at]]))
        return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())]))


def tag_documents(docs: DataFrame, model: Field | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row; ``spans``: stretches of words of one language."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets, and 1 / share words a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _Tagger(shared.value) if shared.value else None

        def tagged(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            best, score, spans = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            if tagger:
                mass, spans = tagger.group(texts)
                total = mass.sum(axis=1)
                top = mass.argmax(axis=1)
                has = np.array([bool(x) for x in spans], bool)
                score = np.where(has, mass[np.arange(len(texts)), top] / np.maximum(total, 1e-300), 0.0)
                best = [tagger.model.languages[t] if h else UNKNOWN for t, h in zip(top.tolist(), has.tolist())]
            rows = [[{"start": a, "length": n, "lang": x} for a, n, x in own] for own in spans]
            return pa.RecordBatch.from_arrays([ids, pa.array(best, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(rows, _SPANS)],
                                              ["doc_id", "lang_pred", "score", "spans"])

        for b in batches:
            ids, texts, first, size = b.column("doc_id"), [], 0, 0
            for k, t in enumerate(b.column("text")):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= GROUP_CHARS:
                    yield tagged(ids.slice(first, k + 1 - first), texts)
                    texts, first, size = [], k + 1, 0
            if texts:
                yield tagged(ids.slice(first), texts)

    return narrow.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, spans array<struct<start:long,length:long,lang:string>>")


def predict_documents(docs: DataFrame, s: Settings = Settings(), text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang",
                      held_out_fold: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` of every row; languages of the held-out fold are never read."""
    model = train(docs.where(fold(F.col(id_col)) != held_out_fold), s, text_col, lang_col)
    held_out = F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False))
    return tag_documents(docs, model, text_col, id_col).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")
