"""Quality gates and audits on signal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..schemas import REQUIRED_SIGNAL_COLUMNS

GATES = ("gate1_signal_date", "gate2_window_mentions", "gate3_z_score", "gate4_signal_type")


def first_failed_gate(min_mentions: float = 5) -> Column:
    """Name of the first gate a row fails, in order, or NULL if it passes all four."""
    return (F.when(F.col("signal_date").isNull(), GATES[0])
             .when(~F.coalesce(F.col("window_mentions") >= min_mentions, F.lit(False)), GATES[1])
             .when(~is_finite("z_score"), GATES[2])
             .when(~F.coalesce(F.col("signal_type").isin("BUY", "SELL"), F.lit(False)), GATES[3]))


def dedupe_keep_first(df: DataFrame, keys=("ticker", "signal_date", "signal_type"),
                      order: list | None = None) -> DataFrame:
    """P12 (gate 5): one row per key; the first by an explicit total order."""
    order = order or [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def apply_quality_gates(df: DataFrame, min_mentions: float = 5) -> DataFrame:
    """Gates 1-5: rows passing gates 1-4, then de-duplicated on (ticker, date, type)."""
    passed = df.filter(first_failed_gate(min_mentions).isNull())
    return dedupe_keep_first(passed)


def gate_report(df: DataFrame, min_mentions: float = 5) -> DataFrame:
    """Removed rows per gate (all five) in one pass: gate, removed.

    Gate 5 counts the rows beyond the first of each (ticker, date, type) among
    rows that pass gates 1-4.
    """
    counts = (df.withColumn("_gate", first_failed_gate(min_mentions))
                .groupBy("_gate", "ticker", "signal_date", "signal_type")
                .agg(F.count(F.lit(1)).alias("n")))
    per_gate = counts.select(
        F.when(F.col("_gate").isNull(), F.lit("gate5_duplicates")).otherwise(F.col("_gate")).alias("gate"),
        F.when(F.col("_gate").isNull(), F.col("n") - 1).otherwise(F.col("n")).alias("removed"))
    spine = df.sparkSession.createDataFrame([(g,) for g in GATES + ("gate5_duplicates",)], "gate string")
    agg = per_gate.groupBy("gate").agg(F.sum("removed").alias("removed"))
    return (spine.join(agg, "gate", "left")
                 .select("gate", F.coalesce(F.col("removed"), F.lit(0)).cast("bigint").alias("removed")))


def zscore_consistency(df: DataFrame, tol: float = 0.01) -> DataFrame:
    """Recompute (window - mean) / std and classify each row.

    status: 'not_checkable' (NULL inputs or std <= 0), 'mismatch' (|diff| > tol), 'ok'.
    """
    rec = F.try_divide(F.col("window_sentiment") - F.col("baseline_mean"), F.col("baseline_std"))
    checkable = (F.col("window_sentiment").isNotNull() & F.col("baseline_mean").isNotNull()
                 & F.col("baseline_std").isNotNull() & (F.col("baseline_std") > 0)
                 & F.col("z_score").isNotNull())
    diff = F.abs(F.col("z_score") - rec)
    status = F.when(~checkable, "not_checkable").when(diff > tol, "mismatch").otherwise("ok")
    return df.withColumn("z_recomputed", F.when(checkable, rec)).withColumn(
        "z_abs_diff", F.when(checkable, diff)).withColumn("z_status", status)


def null_metric_audit(df: DataFrame, cols=("window_sentiment", "z_score", "baseline_mean")) -> DataFrame:
    """Total rows and NULL count of each metric column (one row)."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def missing_columns(df: DataFrame, required=REQUIRED_SIGNAL_COLUMNS) -> list[str]:
    """Required columns absent from ``df`` (a schema check, no data is read)."""
    have = {c.lower() for c in df.columns}
    return [c for c in required if c.lower() not in have]
