from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF01
from tickerpulse.operators import gates, market, shock, trades
from tickerpulse.sources import fixtures as fx


def test_gate_counts_add_up_and_trades_do_not_overlap(spark):
    bars = fx.price_bars(spark, SF01).cache()
    unmoved = market.filter_unmoved(shock.shock_signals(fx.sentiment_results(spark, SF01)), bars).cache()
    kept = gates.apply_quality_gates(unmoved)
    removed = gates.gate_report(unmoved).agg(F.sum("removed")).first()[0]
    assert removed + kept.count() == unmoved.count()

    lo, hi = bars.agg(F.min("date"), F.max("date")).first()
    p = trades.BacktestParams(start=str(lo), end=str(hi))
    t = trades.trade_table(kept, bars, p)
    w = Window.partitionBy("ticker").orderBy("signal_date")
    prev = t.withColumn("prev_exit", F.lag("exit_date").over(w)).withColumn(
        "prev_reason", F.lag("exit_reason").over(w))
    # a new position opens only on or after the previous exit; end_of_period never closes
    assert prev.filter(F.col("prev_exit").isNotNull()
                       & ((F.col("signal_date") < F.col("prev_exit"))
                          | (F.col("prev_reason") == "end_of_period"))).count() == 0
    assert t.filter(F.col("entry_date") <= F.col("signal_date")).count() == 0
    assert t.filter(F.col("exit_date") < F.col("entry_date")).count() == 0
