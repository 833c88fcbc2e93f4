"""Incremental daily refresh (S13) as a Structured Streaming job.

New ``sentiment_results`` files arrive in a landing folder that is partitioned by month (``land``). The
job keeps two things in one versioned table (``sources.versions``): the mergeable state of every ticker and day
(``operators.daily_state``) and the daily rows (A1). A micro-batch reads only its new rows:

1. its rows are counted and staged as one more delta of the state of each month it touches;
2. the (ticker, day) s it touches are merged from the deltas of these months, and give new daily rows;
   the other daily rows of these months are carried over (at most one row per ticker and day);
3. deltas and daily folders are published in one manifest, together with the batch's number.

A batch that is run again after a failure finds its number in the manifest and does nothing; one that
failed before publishing left only unlisted folders behind. So every row counts exactly once, late rows
and rows without a time included. A month with more than ``MAX_DELTAS`` deltas is merged into one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import epoch_to_date
from ..operators.daily import with_sentiment_date
from ..operators.daily_state import KEYS, STATE_SCHEMA, daily_from_state, merge_state, same_key, value_state
from ..session import materialize
from ..sources.sinks import DAILY_SCHEMA, month_of
from ..sources.versions import NO_VALUE, VersionedTable

RESULTS_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("created_utc", T.LongType()),
    T.StructField("final_sentiment_score", T.DoubleType()), T.StructField("normalized_upvotes", T.DoubleType()),
    T.StructField("final_sentiment_label", T.StringType()), T.StructField("source_model", T.StringType()),
    T.StructField("tw_confidence", T.DoubleType()), T.StructField("subreddit", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("text_length", T.IntegerType()),
    T.StructField("word_count", T.IntegerType()), T.StructField("month", T.StringType()),
])
MAX_DELTAS = 8
#: Parts of the state carry this prefix; parts of the daily rows are plain months, as ``refresh_daily`` writes them.
STATE = "state/"


def land(results: DataFrame, source_path: str) -> None:
    """Append scored mentions to the landing folder, partitioned by the month of their UTC day (``none`` without
    a time). A month with many rows is written by several tasks."""
    month = F.coalesce(month_of(epoch_to_date("created_utc")), F.lit(NO_VALUE))
    (results.withColumn("month", month).hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(source_path))


def _months() -> Column:
    return F.coalesce(month_of(F.col("sentiment_date")), F.lit(NO_VALUE))


def apply_batch(table: VersionedTable, batch: DataFrame, number: int, source: str) -> bool:
    """Merge one micro-batch into the table; False if the manifest says that it has been applied."""
    base = table.manifest()
    marks = dict(base.marks) if base else {}
    if marks.get(source, -1) >= number:
        return False
    parts = dict(base.parts) if base else {}
    delta = table.write(value_state(with_sentiment_date(batch)).withColumn("month", _months()), "month")
    months = sorted(delta)  # at most the calendar's months
    if months:
        new = table.folders([f for m in months for f in delta[m]], STATE_SCHEMA)
        touched = materialize(new.select(*KEYS).distinct())  # no more than a row per ticker and day of the batch
        for m in months:
            parts[STATE + m] = parts.get(STATE + m, []) + delta[m]
        state = table.folders([f for m in months for f in parts[STATE + m]], STATE_SCHEMA)
        fresh = daily_from_state(state.join(touched, same_key(state, touched), "left_semi"))
        old = table.folders([f for m in months for f in parts.get(m, [])], DAILY_SCHEMA)
        kept = old.join(touched, same_key(old, touched), "left_anti")
        stamped = fresh.withColumn("created_at", F.current_timestamp()).select(*DAILY_SCHEMA.fieldNames())
        parts |= table.write(kept.unionByName(stamped).withColumn("month", _months()), "month")
        long = [m for m in months if len(parts[STATE + m]) > MAX_DELTAS]
        if long:
            whole = merge_state(table.folders([f for m in long for f in parts[STATE + m]], STATE_SCHEMA))
            parts |= {STATE + m: own for m, own in table.write(whole.withColumn("month", _months()), "month").items()}
    table.publish(base, DAILY_SCHEMA, parts, marks | {source: number})
    return True


def _stream_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The stream's own id, which its checkpoint keeps over restarts."""
    meta = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_location}/metadata")
    stream = meta.getFileSystem(spark._jsc.hadoopConfiguration()).open(meta)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["id"]
    finally:
        stream.close()


def start_daily_refresh(spark: SparkSession, source_path: str, table_path: str, checkpoint_location: str,
                        max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the stream; returns the StreamingQuery (``available_now`` drains and stops).

    The daily rows are read by ``readers.load_daily(spark, table_path)``.
    """
    reader = spark.readStream.schema(RESULTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        own = batch.sparkSession
        apply_batch(VersionedTable(own, table_path), batch, epoch_id, _stream_id(own, checkpoint_location))

    w = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
