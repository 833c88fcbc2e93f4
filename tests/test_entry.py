"""The driver's contract: entry, queries and SQL."""

import __spark_entry__ as spark_entry


def test_entry_gives_signals_with_a_stable_schema(spark):
    out = spark_entry.entry(spark)
    assert {"ticker", "signal_date", "signal_type", "z_score"} <= set(out.columns)
    assert out.schema == spark_entry.entry(spark).schema
    assert out.count() > 0


def test_every_sql_twin_belongs_to_a_query():
    found = spark_entry.queries()
    assert set(spark_entry.oracle_sql()) <= set(found)
    assert all(callable(q) for q in found.values())
    assert len(found) >= 72
