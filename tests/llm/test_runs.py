"""Periodic runs against a plain search over all periods."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickerpulse.llm import periodic, queries


def plain_runs(words, length=6, exponent=4):
    """Every period by itself: stretches where words a period apart agree."""
    found, seen = [], {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q) and not any(q % p == 0 for p in seen.get((i, j + q), [])):
                seen.setdefault((i, j + q), []).append(q)
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def check(documents, shape=periodic.Shape()):
    documents = [[str(x).encode() for x in d] for d in documents]
    offsets, rows, again = periodic.word_runs(documents, shape)
    at = 0
    for k, words in enumerate(documents):
        want = plain_runs(words, shape.length, shape.exponent)
        assert [tuple(r) for r in rows[offsets[k]:offsets[k + 1]].tolist()] == want
        gone = np.zeros(len(words), bool)
        for s, n, q in want:
            gone[s + q:s + n] = True
        assert (gone == again[at:at + len(words)]).all()
        at += len(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_small_alphabets(documents):
    check(documents)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(2, 12), st.lists(st.integers(0, 3), max_size=9))
def test_planted_periods(unit, times, around):
    check([around + unit * times + around, unit * times + unit[:1], around])


def test_nested_and_long_periods():
    rnd = random.Random(3)
    inner = [1, 2] * 5 + [3]
    page = [rnd.randrange(50) for _ in range(700)]
    check([inner * 6, page * 5 + page[:300], [7] * 1000, [], [1], [0, 0, 0, 0, 0], page])
    check([inner * 6, [5] * 9], periodic.Shape(length=10, exponent=5))
    thue = [0]
    while len(thue) < 4096:  # overlap-free: a word sequence that polynomial hashes modulo 2^64 confuse
        thue += [1 - x for x in thue]
    check([thue])


def test_rules_are_used_twice_and_give_the_text_back():
    rnd = random.Random(11)
    words = np.array([rnd.randrange(4) for _ in range(400)] * 2 + [9] * 33, np.int64)
    g = periodic.Grammar(words, np.array([0]))
    assert len(g.top) < len(words) / 8
    for rule, lo, at, hi in g.rules:
        assert (np.bincount(rule) >= 2).all()
        for r in range(rule.max() + 1):
            own = np.flatnonzero(rule == r)
            texts = {(words[lo[k]:at[k]].tobytes(), words[at[k]:hi[k]].tobytes()) for k in own}
            assert len(texts) == 1  # all uses of a rule spell the same two halves


def test_long_low_entropy_text_is_not_quadratic():
    rnd = random.Random(1)
    words = [str(rnd.randrange(2)).encode() for _ in range(200_000)]
    offsets, rows, _ = periodic.word_runs([words])
    assert (rows[:, 1] >= 4 * rows[:, 2]).all() and offsets == [0, len(rows)]


def test_query_equals_the_plain_search(docs, rows):
    got = periodic.digest(periodic.find_runs(docs, words_of=queries.planted_period)).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = []
    for doc_id, text, _ in rows:
        words = queries.planted_period(doc_id, text.encode().split())
        if len(words) > 3000:
            continue  # the plain search is quadratic
        runs = plain_runs(words)
        keep = np.ones(len(words), bool)
        for s, n, q in runs:
            keep[s + q:s + n] = False
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
                     digest(b" ".join(w for w, k in zip(words, keep) if k)), len(words)))
    assert len(got) == len(rows)
    assert sorted((tuple(r) for r in got if r["n_words"] <= 3000), key=key) == sorted(want, key=key)
    assert any(r["n_runs"] for r in got)


def test_edges(spark, docs, none):
    assert periodic.digest(periodic.find_runs(none)).count() == 0
    empty = periodic.digest(periodic.find_runs(docs.where("doc_id = 900001"))).first()
    assert (empty["n_runs"], empty["start"], empty["n_words"]) == (0, None, 0)
    assert empty["collapsed_sha256"] == empty["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    found = periodic.find_runs(spark.createDataFrame([(1, "x a\tb a\nb a b a b y"), (1, "x a\tb a\nb a b a b y")], "doc_id int, text string"))
    for r in found.collect():
        assert [tuple(x) for x in r["runs"]] == [(1, 8, 2)] and r["collapsed"] == "x a b y"
    assert found.where(F.size("runs") == 1).count() == 2
    with pytest.raises(ValueError):
        periodic.Shape(exponent=3)
