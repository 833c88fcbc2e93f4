"""Medians of groups whose key is null."""

from datetime import date

from tickerpulse.operators.daily import daily_sentiment_sql
from tickerpulse.operators.quantiles import grouped_quantiles


def test_null_keys_are_groups(spark):
    rows = [(None, date(2024, 1, 1), 1.0), (None, date(2024, 1, 1), 2.0), ("A", None, 3.0), ("A", None, 7.0), ("A", None, 8.0),
            (None, None, 4.0), ("A", date(2024, 1, 1), 5.0), ("B", None, None)]
    df = spark.createDataFrame(rows, "ticker string, day date, score double")
    got = {(r["ticker"], r["day"]): r["q"] for r in grouped_quantiles(df, ["ticker", "day"], "score", [0.5]).collect()}
    assert got == {(None, date(2024, 1, 1)): [1.5], ("A", None): [7.0], (None, None): [4.0], ("A", date(2024, 1, 1)): [5.0]}


def test_daily_sentiment_has_medians_for_null_ticker_and_day(spark):
    rows = [(None, 1704067200, 0.25), (None, 1704067200, 0.75), ("A", None, 0.5), ("A", 1704067200, 0.1)]
    df = spark.createDataFrame([(t, c, s, "neutral", 1.0) for t, c, s in rows], "ticker string, created_utc long, "
                               "final_sentiment_score double, final_sentiment_label string, normalized_upvotes double")
    got = {(r["ticker"], r["sentiment_date"]): r["sentiment_median"] for r in daily_sentiment_sql(df).collect()}
    assert got == {(None, date(2024, 1, 1)): 0.5, ("A", None): 0.5, ("A", date(2024, 1, 1)): 0.1}
