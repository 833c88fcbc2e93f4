"""The conditional random field against enumeration of all labellings, and on documents."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerpulse.llm import language
from tickerpulse.session import materialize


def test_messages_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(0)
    for _ in range(20):
        k, sizes = int(rng.integers(1, 4)), rng.integers(1, 6, size=rng.integers(1, 60))
        first = np.zeros(sizes.sum(), bool)
        first[np.cumsum(sizes) - sizes] = True
        score, step = rng.normal(size=(len(first), k)) * 2, rng.normal(size=(k, k))
        want, pairs, at = np.zeros((len(first), k)), np.zeros((k, k)), 0
        for m in sizes.tolist():
            paths = list(itertools.product(range(k), repeat=m))
            weight = np.exp([sum(score[at + i, x] for i, x in enumerate(p)) + sum(step[x, y] for x, y in zip(p, p[1:])) for p in paths])
            for p, w in zip(paths, weight / weight.sum()):
                for i, x in enumerate(p):
                    want[at + i, x] += w
                for x, y in zip(p, p[1:]):
                    pairs[x, y] += w
            at += m
        chain = language.Chain(language.scaled(score), first, step)
        assert np.allclose(chain.posterior(), want) and np.allclose(chain.pairs(), pairs)


def test_the_fit_climbs_the_likelihood():
    """The slope that training follows is that of the log-likelihood, here by differences."""
    rng = np.random.default_rng(1)
    k, n = 3, 40
    first = np.arange(n) % 8 == 0
    label = rng.integers(0, k, n)

    def likelihood(score, step):
        total = 0.0
        for at in range(0, n, 8):
            a = score[at]
            for t in range(at + 1, at + 8):
                a = np.log(np.exp(a[:, None] + step).sum(axis=0)) + score[t]
            path = label[at:at + 8]
            total += score[range(at, at + 8), path].sum() + step[path[:-1], path[1:]].sum() - np.log(np.exp(a).sum())
        return total

    score, step = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    chain = language.Chain(language.scaled(score), first, step)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[:-1][~first[1:]], label[1:][~first[1:]]), 1)
    by_step, by_score = seen - chain.pairs(), np.eye(k)[label] - chain.posterior()
    for i, j in itertools.product(range(k), range(k)):
        moved = step.copy()
        moved[i, j] += 1e-6
        assert (likelihood(score, moved) - likelihood(score, step)) / 1e-6 == pytest.approx(by_step[i, j], abs=1e-4)
    moved = score.copy()
    moved[5, 1] += 1e-6
    assert (likelihood(moved, step) - likelihood(score, step)) / 1e-6 == pytest.approx(by_score[5, 1], abs=1e-4)


def test_grams_and_forms():
    assert language.forms(["Don't", "42!", "É_à", "\x1cx\x85"]) == ["dont", "", "éà", "x"]
    bucket, owner = language.grams(["ab", "", "ab", "abc"], 1 << 16)
    per = [bucket[owner == k].tolist() for k in range(4)]
    assert per[0] == per[2] and per[1] == [] and len(per[0]) == 4 + 3 + 2 + 1 and len(per[3]) == 5 + 4 + 3 + 2
    assert len(set(per[0])) == 10


@pytest.fixture(scope="module")
def settings():
    return language.Settings(windows=60, buckets=1 << 14, rounds=25)


@pytest.fixture(scope="module")
def model(spark, settings):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.train(docs.where(language.fold(F.col("doc_id")) != 1), settings)


def test_held_out_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.tag_documents(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.fold(F.col("doc_id")) == 1).collect()
    assert len(got) > 250
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_code_switched_text(spark, model):
    texts = {"en": "The and attion to thanedble the, anea. This inwhing the erti that", "fr": "Étion et en le aianè èètre dans une éoué oueauvi pour les"}
    both = spark.createDataFrame([(1, texts["en"] + " 12 % " + texts["fr"])], "doc_id long, text string")
    spans = language.tag_documents(both, model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "fr"]
    assert abs(spans[0]["length"] - len(texts["en"].split()) - 2) <= 2
    assert sum(s["length"] for s in spans) == len(both.first()["text"].split())


def test_query_edges(spark, docs, none, settings):
    got = materialize(language.predict_documents(docs, settings)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] in (900_001, 900_002, 900_003, 900_010, 900_011):
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "es", "und"}
    assert language.predict_documents(none, settings).count() == 0
    unlabelled = language.predict_documents(docs.withColumn("lang", F.lit(None).cast("string")), settings)
    assert {(r["lang_pred"], r["score"]) for r in unlabelled.collect()} == {("und", 0.0)}
    one = language.predict_documents(docs.withColumn("lang", F.lit("xx")), settings).where("doc_id = 900004").first()
    assert (one["lang_pred"], one["score"]) == ("xx", 1.0)


def test_labels_of_the_held_out_fold_change_nothing(spark, docs, settings):
    held = language.fold(F.col("doc_id")) == 1
    wrong = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    first, second = (sorted(map(str, language.predict_documents(d, settings).collect())) for d in (docs, wrong))
    assert first == second
