"""Memoised scoring: each text once, failed batches again, killed runs without a trace."""

import pytest
from pyspark.sql import functions as F

from tickerpulse.operators import scoring
from tickerpulse.session import scratch_path
from tickerpulse.sources import versions


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(k, f"text {k % 5}" if k else None) for k in range(20)], "row int, model_input string").repartition(4)


def scorer(calls, bad=()):
    """A scorer that counts texts and refuses any batch that holds a bad one."""
    def make():
        def run(batch):
            calls.add(len(batch))
            if any(t in bad for t in batch):
                raise RuntimeError("refused")
            return [{"label": "positive", "score": float(len(t)), "p_pos": 1.0, "p_neu": 0.0, "p_neg": 0.0} for t in batch]
        return run
    return make


def test_each_text_is_scored_once_over_all_runs(spark, texts):
    calls, path = spark.sparkContext.accumulator(0), scratch_path(spark, "memo")
    first = scoring.score_memoised(texts, path, "m1", scorer(calls)).collect()
    assert calls.value == 6  # five texts and the null one, as an empty text
    assert len(first) == 20 and {r["m_score"] for r in first} == {0.0, 6.0} and not any(r["m_failed"] for r in first)
    second = scoring.score_memoised(texts, path, "m1", scorer(calls)).collect()
    assert calls.value == 6 and sorted(map(str, first)) == sorted(map(str, second))
    more = texts.unionByName(spark.createDataFrame([(99, "a new text")], texts.schema))
    assert scoring.score_memoised(more, path, "m1", scorer(calls)).count() == 21 and calls.value == 7
    scoring.score_memoised(texts, path, "m2", scorer(calls)).count()  # another model has its own results
    assert calls.value == 13


def test_failed_batches_are_tried_again_in_smaller_ones(spark, texts):
    calls, path = spark.sparkContext.accumulator(0), scratch_path(spark, "memo")
    got = scoring.score_memoised(texts.coalesce(1), path, "m", scorer(calls, bad=("text 3",)), batch_size=64).collect()
    assert {r["model_input"] for r in got if r["m_failed"]} == {"text 3"}
    assert {(r["m_label"], r["m_score"], r["m_p_pos"]) for r in got if r["m_failed"]} == {("neutral", 0.0, None)}
    before = calls.value
    again = scoring.score_memoised(texts, path, "m", scorer(calls)).collect()  # the scorer has been mended
    assert not any(r["m_failed"] for r in again) and calls.value == before + 1


def test_a_killed_run_stores_nothing(spark, texts, monkeypatch):
    calls, path = spark.sparkContext.accumulator(0), scratch_path(spark, "memo")

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions.VersionedTable, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            scoring.score_memoised(texts, path, "m", scorer(calls))
    assert versions.VersionedTable(spark, path).read() is None
    assert scoring.score_memoised(texts, path, "m", scorer(calls)).where(F.col("m_failed")).count() == 0


def test_two_runs_at_once(spark):
    path = scratch_path(spark, "memo")
    table = versions.VersionedTable(spark, path)
    rows = spark.createDataFrame([("k1", "positive", 1.0, 1.0, 0.0, 0.0)], "_key string, " + scoring.SCORE_FIELDS)
    publish, raced = versions.VersionedTable.publish, []

    def late(self, base, schema, parts, marks=None):
        if not raced:  # another run publishes first
            raced.append(1)
            scoring._append(table, rows)
        return publish(self, base, schema, parts, marks)

    versions.VersionedTable.publish = late
    try:
        scoring._append(table, rows)
    finally:
        versions.VersionedTable.publish = publish
    assert len(table.manifest().parts[scoring.SCORED]) == 2 and scoring._stored(table).count() == 1
