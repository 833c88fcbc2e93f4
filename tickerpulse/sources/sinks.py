"""Sinks (S8-S11, S13): text exports, and typed tables that are replaced atomically.

A load stages its rows and publishes them as the table's next version (``versions.py``): readers see the old
table until then, and a load that is killed leaves it. The daily table is split by month; a refresh of
a date range replaces the rows of its days, those that have vanished included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from ..operators.daily import daily_sentiment_sql
from ..schemas import FILTERED_SIGNAL_COLUMNS, SIGNAL_COLUMNS
from .versions import Manifest, VersionedTable

# Stored column types of the signal tables.
SIGNAL_TYPES = {
    "signal_date": T.DateType(), "ticker": T.StringType(),
    "sentiment_mean": T.DecimalType(15, 6), "total_upvotes": T.DecimalType(15, 6),
    "window_sentiment": T.DecimalType(15, 6), "window_mentions": T.DecimalType(15, 6),
    "baseline_mean": T.DecimalType(15, 6), "baseline_std": T.DecimalType(15, 6),
    "z_score": T.DecimalType(15, 6), "signal_type": T.StringType(),
    "signal_direction": T.DecimalType(3, 0), "signal_score": T.DecimalType(15, 6),
}
FILTERED_EXTRA_TYPES = {
    "target_date": T.StringType(), "pct_change_3d": T.DecimalType(15, 4), "pct_3d_z": T.DecimalType(15, 4),
    "ret_z": T.DecimalType(15, 4), "vol_z": T.DecimalType(15, 4), "vol_expansion": T.DecimalType(15, 4),
    "atr_14": T.DecimalType(15, 4), "atr_move": T.DecimalType(15, 4), "market_moved_flag": T.DecimalType(1, 0),
}

DAILY_SCHEMA = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("sentiment_date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("sentiment_mean", "sentiment_median", "sentiment_std")]
    + [T.StructField("mentions", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("total_upvotes", "avg_upvotes", "weighted_sentiment")]
    + [T.StructField(c, T.LongType()) for c in ("positive_count", "neutral_count", "negative_count")]
    + [T.StructField("created_at", T.TimestampType())])


def month_of(day: Column) -> Column:
    """``yyyy-MM``: the part of the daily table that a day belongs to."""
    return F.date_format(day, "yyyy-MM")


def to_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Header CSV; list columns are joined with ',' first."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out = out.withColumn(f.name, F.array_join(F.col(f.name), ","))
    out.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def typed(df: DataFrame, types: dict) -> DataFrame:
    """NaN / +-inf -> NULL, then cast each column to its stored type.

    A value beyond a column's precision is an error (ANSI cast), never a silent NULL.
    """
    cols = []
    for name, t in types.items():
        c = F.col(name)
        if isinstance(t, T.DecimalType):
            # through three more places, so that a tie is not decided by a double's last bit
            c = nan_to_null(c.cast("double")).cast(T.DecimalType(38, t.scale + 3)).cast(t)
        else:
            c = c.cast(t)
        cols.append(c.alias(name))
    return df.select(*cols)


def load_signals(df: DataFrame, path: str) -> DataFrame:
    """Keep BUY/SELL rows, typed columns, replace the table; returns the typed frame."""
    out = typed(df.filter(F.col("signal_type").isin("BUY", "SELL")).select(*SIGNAL_COLUMNS), SIGNAL_TYPES)
    VersionedTable(df.sparkSession, path).replace(out)
    return out


def load_filtered_signals(df: DataFrame, path: str) -> DataFrame:
    """The filtered-signal table, 21 typed columns, replaced."""
    out = typed(df.select(*FILTERED_SIGNAL_COLUMNS), {**SIGNAL_TYPES, **FILTERED_EXTRA_TYPES})
    VersionedTable(df.sparkSession, path).replace(out)
    return out


def load_preprocessed(df: DataFrame, path: str) -> None:
    """Truncate-and-load of preprocessed_data (``date`` stored as ``date_col``)."""
    VersionedTable(df.sparkSession, path).replace(df.withColumnRenamed("date", "date_col"))


def refresh_daily(results: DataFrame, path: str, start_date: str | None = None, end_date: str | None = None) -> Manifest:
    """(re)compute the daily table (A1), whole or for the days from ``start_date`` to ``end_date``.

    A whole refresh replaces every row. One of a range replaces the rows of its days (a day without results
    has none afterwards) and keeps all other days, of which only those in the range's months are read.
    """
    table = VersionedTable(results.sparkSession, path)
    base = table.manifest()
    if base and base.marks:
        raise ValueError(f"{path} is kept up by a stream, whose state a refresh would not know")
    fresh = daily_sentiment_sql(results, start_date, end_date).withColumn("created_at", F.current_timestamp())
    fresh = fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DAILY_SCHEMA])
    parts: dict[str, list[str]] = {}
    if base and (start_date is not None or end_date is not None):
        first, last = (start_date or "")[:7], (end_date or "9999-99")[:7]
        # a part that is no month holds the rows without a day, which no range reaches
        hit = [m for m in base.parts if m[:1].isdigit() and first <= m <= last]
        parts = {m: f for m, f in base.parts.items() if m not in hit}
        day = F.col("sentiment_date")
        inside = F.lit(True)
        for bound, test in ((start_date, day >= F.to_date(F.lit(start_date))), (end_date, day <= F.to_date(F.lit(end_date)))):
            inside = inside & test if bound is not None else inside
        fresh = fresh.unionByName(table.rows(base, hit).filter(~inside))
    return table.publish(base, DAILY_SCHEMA, parts | table.write(fresh.withColumn("month", month_of(F.col("sentiment_date"))), "month"))
