"""Exact quantiles without gathering a group in one buffer.

Values are counted first (combined before the shuffle), then dealt out by ranges of (key, value), so
a key that holds most rows is spread over many tasks. Each range's total gives the ranks it covers, and
only the two values around each wanted rank are picked and interpolated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """``keys`` and ``q``: array of the interpolated quantiles of the non-null ``value`` s per key; null keys are groups too."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))  # one row per key and range
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"),
                         F.sum("_size").over(Window.partitionBy(*keys)).alias("_all"))
    running = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), "_base", "_all")
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    placed = dealt.withColumn("_upto", F.sum("_n").over(running)).join(parts, same)
    last = F.col("_base") + F.col("_upto") - 1   # rank (from 0) of the value's last copy
    first = last - F.col("_n") + 1
    wanted = [F.lit(p) * (F.col("_all") - 1) for p in probs]
    picks = []
    for w in wanted:
        for rank in (F.floor(w), F.ceil(w)):
            picks.append(F.max(F.when(rank.between(first, last), F.col("_v"))))
    near = placed.groupBy(*keys).agg(F.max("_all").alias("_all"), *[p.alias(f"_p{k}") for k, p in enumerate(picks)])
    out = []
    for k, w in enumerate(wanted):
        lo, hi = F.col(f"_p{2 * k}"), F.col(f"_p{2 * k + 1}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (w - F.floor(w)) * (hi - lo)))
    return near.select(*keys, F.array(*out).alias("q"))
