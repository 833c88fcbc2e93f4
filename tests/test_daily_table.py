"""The daily table: atomic versions, refreshes that remove vanished days, and the incremental state."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tickerpulse.operators.daily import daily_sentiment_sql
from tickerpulse.operators.daily_state import daily_from_state, merge_state, value_state
from tickerpulse.operators.daily import with_sentiment_date
from tickerpulse.session import scratch_path
from tickerpulse.sources import readers, sinks, versions
from tickerpulse.streaming import incremental

DAY = 86400
START = 1704067200  # 2024-01-01
SCHEMA = "ticker string, created_utc long, final_sentiment_score double, normalized_upvotes double, final_sentiment_label string"


def frame(spark, rows):
    return spark.createDataFrame([(t, c, s, u, "positive" if (s or 0) > 0 else "negative") for t, c, s, u in rows], SCHEMA)


def whole(df):
    """The rows of the daily table by plain Python, from the raw rows."""
    by = {}
    for t, c, s, u, label in df.collect():
        by.setdefault((t, None if c is None else date.fromordinal(719163 + c // DAY)), []).append((s, u, label))
    out = {}
    for key, rows in by.items():
        scores = sorted(s for s, _, _ in rows if s is not None)
        ups = [u for _, u, _ in rows if u is not None]
        n = len(scores)
        mean = sum(scores) / n if n else None
        median = (scores[(n - 1) // 2] + scores[n // 2]) / 2 if n else None
        std = None if not n else 0.0 if n == 1 else (sum((s - mean) ** 2 for s in scores) / (n - 1)) ** 0.5
        weighted = sum(s * u for s, u, _ in rows if s is not None and u is not None) / sum(ups) if ups and sum(ups) else None
        if not any(s is not None and u is not None for s, u, _ in rows):
            weighted = None
        out[key] = (mean, median, std, len(rows), sum(ups) if ups else None, sum(ups) / len(ups) if ups else None, weighted,
                    *(sum(x == label for _, _, x in rows) for label in ("positive", "neutral", "negative")))
    return out


def table_of(df):
    names = ["sentiment_mean", "sentiment_median", "sentiment_std", "mentions", "total_upvotes", "avg_upvotes", "weighted_sentiment",
             "positive_count", "neutral_count", "negative_count"]
    rows = df.collect()
    out = {(r["ticker"], r["sentiment_date"]): tuple(r[c] for c in names) for r in rows}
    assert len(out) == len(rows)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert [x is None for x in got[key]] == [x is None for x in row], key
        assert [x or 0 for x in got[key]] == pytest.approx([x or 0 for x in row], rel=1e-9, abs=1e-9), key


@pytest.fixture(scope="module")
def results(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["A", "A", "A", "B", "C", None]), rnd.choice([None, *[START + rnd.randrange(70 * DAY)] * 20]),
             rnd.choice([None, round(rnd.uniform(-1, 1), 1), rnd.uniform(-1, 1)]), rnd.choice([None, 0.0, 1.0, 2.5])) for _ in range(900)]
    return frame(spark, rows + [("Z", START, 0.3, 0.0)] * 3 + [("Y", START, None, None)]).persist()


def test_daily_rows_from_counts(results):
    same(table_of(daily_sentiment_sql(results)), whole(results))


def test_counts_of_batches_merge(spark, results):
    parts = [value_state(with_sentiment_date(results.where(F.pmod(F.hash("created_utc", "final_sentiment_score"), F.lit(3)) == k))) for k in range(3)]
    state = parts[0].unionByName(parts[1]).unionByName(parts[2])
    same(table_of(daily_from_state(state)), whole(results))
    same(table_of(daily_from_state(merge_state(state), merged=True)), whole(results))


def test_a_whole_refresh_removes_vanished_days(spark):
    path = scratch_path(spark, "vanished")
    rows = [("A", START, 0.1, 1.0), ("A", START + DAY, 0.2, 1.0), ("B", START + 40 * DAY, 0.3, 1.0)]
    sinks.refresh_daily(frame(spark, rows), path)
    sinks.refresh_daily(frame(spark, rows[1:2]), path)
    assert list(table_of(readers.load_daily(spark, path))) == [("A", date(2024, 1, 2))]


def test_a_range_refresh_replaces_its_days_only(spark):
    path = scratch_path(spark, "range")
    rows = [("A", START + k * DAY, 0.1, 1.0) for k in range(70)] + [("N", None, 0.5, 1.0)]
    first = sinks.refresh_daily(frame(spark, rows), path)
    changed = [("A", START + 9 * DAY, 0.9, 1.0), ("B", START + 10 * DAY, 0.9, 1.0)]
    second = sinks.refresh_daily(frame(spark, changed), path, "2024-01-09", "2024-01-20")
    got = table_of(readers.load_daily(spark, path))
    days = {d for t, d in got if t == "A"}
    assert date(2024, 1, 10) in days and not days & {date(2024, 1, k) for k in (9, 11, 12, 20)} and {date(2024, 1, 8), date(2024, 1, 21)} <= days
    assert got["A", date(2024, 1, 10)][0] == 0.9 and ("B", date(2024, 1, 11)) in got and ("N", None) in got
    assert first.parts["2024-02"] == second.parts["2024-02"] and first.parts["2024-01"] != second.parts["2024-01"]
    assert table_of(readers.load_daily(spark, path, ticker="A", start_date="2024-03-01")).keys() == {("A", date(2024, 3, k)) for k in range(1, 11)}


def test_a_killed_refresh_leaves_the_old_table(spark, monkeypatch):
    path = scratch_path(spark, "killed")
    rows = [("A", START, 0.1, 1.0)]
    sinks.refresh_daily(frame(spark, rows), path)

    def killed(self, *args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions.VersionedTable, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            sinks.refresh_daily(frame(spark, [("B", START, 0.1, 1.0)]), path)
    assert list(table_of(readers.load_daily(spark, path))) == [("A", date(2024, 1, 1))]


def test_two_writers_cannot_publish_one_version(spark):
    table = versions.VersionedTable(spark, scratch_path(spark, "two"))
    df = spark.range(3)
    table.replace(df)
    base = table.manifest()
    table.publish(base, df.schema, table.write(df))
    with pytest.raises(versions.ConcurrentPublish):
        table.publish(base, df.schema, table.write(df))
    assert table.versions() == [1, 2] and table.read().count() == 3


def test_old_versions_can_be_read_until_they_are_vacuumed(spark):
    table = versions.VersionedTable(spark, scratch_path(spark, "old"))
    for n in (1, 2, 3, 4):
        table.replace(spark.range(n))
    assert [table.read(version=v).count() for v in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert table.vacuum(keep=2) == 0  # too young: a writer could still be at work on them
    assert table.versions() == [3, 4]
    assert table.vacuum(keep=2, older_than_seconds=-1) == 2
    assert table.read().count() == 4 and table.read(version=3).count() == 3 and table.read(version=1) is None
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, table.path + "-absent")


def test_batches_read_only_new_rows_and_count_once(spark, results, monkeypatch):
    table = versions.VersionedTable(spark, scratch_path(spark, "state"))
    monkeypatch.setattr(incremental, "MAX_DELTAS", 2)
    for k in range(4):
        batch = results.where(F.pmod(F.hash("created_utc", "final_sentiment_score"), F.lit(4)) == k)
        assert incremental.apply_batch(table, batch, k, "stream")
        assert not incremental.apply_batch(table, batch, k, "stream")  # run again after a failure
    same(table_of(readers.load_daily(spark, table.path)), whole(results))
    assert all(len(f) <= 2 for p, f in table.manifest().parts.items() if p.startswith(incremental.STATE))
    with pytest.raises(ValueError):
        sinks.refresh_daily(results, table.path)


def test_the_stream_keeps_late_rows_and_rows_without_a_time(spark, results):
    base = scratch_path(spark, "stream")
    for k in range(3):
        incremental.land(results.where(F.pmod(F.hash("created_utc", "final_sentiment_score"), F.lit(3)) == k), f"{base}/source")
        incremental.start_daily_refresh(spark, f"{base}/source", f"{base}/daily", f"{base}/_checkpoint", max_files_per_trigger=2).awaitTermination()
    got = table_of(readers.load_daily(spark, f"{base}/daily"))
    same(got, whole(results))
    assert any(d is None for _, d in got)
