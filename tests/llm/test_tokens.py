"""Packing, Katz scores and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tickerpulse.llm import katz, packing, quality_model
from tickerpulse.llm.queries import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)


def all_ids(texts):
    coder = Tokenizer.from_file(PATH)
    return [[*coder.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def check_pieces(pieces, want_docs, size=4096):
    """Round trip: the pieces give back each document's ids; sequences are gapless and full."""
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    ids = Counter()
    for group in by_doc.values():  # equal ids: repeated rows
        at = defaultdict(list)
        for p in group:
            at[p["start"]].append(p)
        copies = len(at[0])
        for k in range(copies):
            out, here = [], 0
            while here < group[0]["doc_tokens"]:
                p = at[here][k % len(at[here])] if copies == 1 else at[here].pop()
                out += np.frombuffer(p["ids"], "<u4").tolist()
                here = len(out)
            ids[group[0]["doc_id"], tuple(out)] += 1
    assert ids == want_docs
    for number, parts in by_sequence.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == size or number == max(by_sequence) and end <= size
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing_round_trip_and_mixture(docs, rows, none):
    p = packing.Packing(window_sequences=4)
    plain = docs.where("doc_id IS NOT NULL AND doc_id <> 900005")
    pieces = packing.pack(plain, PATH, p).collect()
    own = [r for r in rows if r[0] is not None and r[0] != 900_005]
    ids = all_ids([t for _, t, _ in own])
    check_pieces(pieces, Counter((i, tuple(x)) for (i, _, _), x in zip(own, ids)))
    length = Counter()
    for (_, _, source), x in zip(own, ids):
        length[source] += len(x)
    total = sum(length.values())
    in_window = Counter()
    for q in pieces:
        in_window[q["window"], q["source"]] += q["length"]
    windows = max(w for w, _ in in_window)
    served = Counter()
    for w in range(1, windows):
        for source, n in length.items():
            served[source] += in_window[w, source]
            # the deficit carried on is below a token (a quantum is kept to 16 bits after the point)
            assert abs(served[source] - n * 4 * 4096 * w / total) <= 1 + w / 65536
    assert packing.pack(none, PATH).count() == 0


def test_repeated_rows_and_null_ids_are_packed(docs, rows):
    pieces = packing.pack(docs, PATH).collect()
    assert sum(q["length"] for q in pieces) == sum(map(len, all_ids([t for _, t, _ in rows])))
    assert sum(q["doc_tokens"] == 3 and q["doc_id"] == 900_005 for q in pieces) == 2
    places = sorted((q["sequence_id"] * 4096 + q["offset"], q["length"]) for q in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def test_targets_steer_the_mixture(spark):
    docs = spark.createDataFrame([(k, "alpha beta gamma " * 200, "ab"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, PATH, packing.Packing(256, 4), {"a": 3.0, "b": 1.0})
    whole = pieces.where("source = 'a'").agg(F.sum("length")).first()[0] // (3 * 256)  # windows before the larger share runs dry
    got = pieces.where(F.col("window") <= whole).groupBy("source").sum("length").collect()
    by = {r[0]: r[1] for r in got}
    assert whole > 50 and by["a"] == pytest.approx(3 * by["b"], rel=0.001)


class PlainKatz:
    """The same model from plain dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs, self.context = Counter(), Counter(), Counter()
        for t in texts:
            seq = [None, *t.encode().lower().split(), b""]
            self.words.update(seq[1:])
            self.pairs.update(zip(seq, seq[1:]))
            self.context.update(seq[:-1])
        self.total = sum(self.words.values())
        n = lambda c: [sum(1 for v in c.values() if v == r) for r in range(1, 7)]
        self.dw, self.dp = katz.discounts(n(self.words)), katz.discounts(n(self.pairs))
        freed = sum((1 - self.d(self.dw, c)) * c for c in self.words.values())
        self.all = self.total + (freed <= 0)
        self.unknown = (freed if freed > 0 else 1) / self.all
        self.after = defaultdict(list)
        for (u, w), c in self.pairs.items():
            self.after[u].append((w, c))

    @staticmethod
    def d(factors, c):
        return factors[min(c, 6)]

    def low(self, w):
        c = self.words.get(w, 0)
        return self.d(self.dw, c) * c / self.all if c else self.unknown

    def p(self, u, w):
        if not self.context.get(u):
            return self.low(w)
        freed = sum((1 - self.d(self.dp, c)) * c for _, c in self.after[u])
        whole = self.context[u] + (freed <= 1e-12)
        c = self.pairs.get((u, w), 0)
        if c:
            return self.d(self.dp, c) * c / whole
        return (freed if freed > 1e-12 else 1) / whole / (1 - sum(self.low(x) for x, _ in self.after[u])) * self.low(w)


def test_katz_equals_plain_dictionaries(docs, rows, none, monkeypatch):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows]
    plain = PlainKatz([t for (_, t, _), h in zip(rows, held) if not h])
    for u in (None, b"the", b"zzz", rows[0][1].encode().lower().split()[0]):  # exactly normalised
        assert sum(plain.p(u, w) for w in plain.words) + plain.p(u, b"never seen") == pytest.approx(1, abs=1e-9)
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 9000)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4))
                  for r in katz.score_documents(docs).collect()), key=str)
    want = []
    for (i, t, _), h in zip(rows, held):
        seq = [None, *t.encode().lower().split(), b""]
        base = sum(math.log10((plain.words[w] + 0.5) / (plain.total + 0.5 * (len(plain.words) + 1))) for w in seq[1:])
        cache = {x: math.log10(plain.p(*x)) for x in set(zip(seq, seq[1:]))}
        want.append((i, h, len(seq) - 1, sum(w in plain.words for w in seq[1:]), plain.total, round(base, 4),
                     round(sum(cache[x] for x in zip(seq, seq[1:])), 4)))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=2e-4)
    assert katz.score_documents(none).count() == 0
    only_held = docs.where(quality_model.fold(docs["doc_id"]) == 1)
    assert {r["score"] for r in katz.score_documents(only_held).collect()} == {0.0}


def test_pipeline_is_its_stages(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, base)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
    assert seen[0] > seen[1] >= seen[2] == seen[3] == seen[4]
    ran = corpus_pipeline.run(spark, base)
    assert Counter(tuple(r) for r in ran.collect()) == Counter(tuple(r) for r in docs.collect())


@pytest.mark.parametrize("targets", [None, {"s1": 0.7, None: 0.1}])
def test_any_number_of_sources_gives_the_pieces_of_the_closed_form(spark, monkeypatch, targets):
    docs = spark.createDataFrame([(k, "alpha beta gamma " * (1 + k * 7 % 40), None if k % 9 == 0 else f"s{min(k % 97, k % 5 * 30)}") for k in range(400)],
                                 "doc_id long, text string, source string").repartition(3, "doc_id")
    p = packing.Packing(64, 4)
    few = Counter(tuple(r) for r in packing.pack(docs, PATH, p, targets).collect())
    monkeypatch.setattr(packing, "CLOSED_FORM_SOURCES", 0)
    many = Counter(tuple(r) for r in packing.pack(docs, PATH, p, targets).collect())
    assert few == many and sum(few.values()) > 400


def test_katz_steps_agree_when_splits_are_planned_anew(spark, tmp_path, monkeypatch):
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(30))) for k in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    names = {"spark.sql.files.maxPartitionBytes": ("1g", "1b"), "spark.sql.files.openCostInBytes": ("0", "0"), "spark.sql.files.minPartitionNum": ("1", "6")}
    score = lambda: {r["doc_id"]: round(r["score"], 6) for r in katz.score_documents(spark.read.parquet(path)).collect()}
    tables = katz.word_tables

    def planned_anew(*args):
        out = tables(*args).persist()
        out.count()
        for name, (_, value) in names.items():
            spark.conf.set(name, value)
        return out

    try:
        for name, (value, _) in names.items():
            spark.conf.set(name, value)
        want = score()
        monkeypatch.setattr(katz, "word_tables", planned_anew)
        assert score() == want and len(want) == 60
    finally:
        for name in names:
            spark.conf.unset(name)


def test_katz_pairs_are_numbered_without_their_keys():
    keys = np.array([7, 3, 7, 1 << 60, 3, 0])
    different, which = katz._distinct(keys)
    assert different.tolist() == [0, 3, 7, 1 << 60] and different[which].tolist() == keys.tolist()
