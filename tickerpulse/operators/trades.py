"""Trade analytics (T1-T7, J6-J8, M10, M11): the reference's day-loop simulator
re-aimed as set operations with a fixed notional per trade.

* Every candidate trade is derived from its own signal independently: entry =
  next bar's open (J6), exit = first barrier hit on the Mon-Fri calendar (J7),
  so all of it runs as partitioned joins/windows.
* The only sequential rule, "one open position per ticker" (T5), is a fold
  over one ticker's candidates ordered by date. A ticker has at most one
  signal per day, so the fold's input is bounded by the calendar, not by the
  mention volume.
* The cash ledger that couples tickers (size = share of current cash, skip
  when < 100) is not rebuilt: each trade's notional is ``capital * share``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_between
from ..session import materialize

FAR_FUTURE = "9999-12-31"


def as_date(v) -> Column:
    """A date literal, or a date-valued Column (e.g. a scalar subquery over the bars)."""
    return v if isinstance(v, Column) else F.lit(v).cast("date")


@dataclass(frozen=True)
class BacktestParams:
    start: object   # 'YYYY-MM-DD' or a date Column
    end: object
    capital: float = 10000.0
    max_position: float = 0.10
    stop_loss: float = 0.07
    take_profit: float = 0.10
    max_holding_days: int = 5
    long_only: bool = False
    sizing: str = "composite"      # "composite" (M10/M11) or "flat" (= max_position)
    trade_weekends: bool = False   # Q9: weekend signals never meet the business-day loop
    # every field but start, end and capital may also be a Column of the signals
    keys: tuple[str, ...] = ()     # columns that tell apart independent backtests (sweep points)


def _pcol(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# ------------------------------------------------------------------ sizing

def composite_score(columns=None) -> Column:
    """0.35 sentiment quality + 0.25 strength + 0.20 entry timing + 0.20 volatility.

    NULL (or absent, when ``columns`` is given) inputs default to 0, except
    window_mentions (5) and vol_expansion (1.0).
    """
    def _nz(c: str, default: float) -> Column:
        if columns is not None and c not in columns:
            return F.lit(default)
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)

    sq = (0.4 * F.least(F.abs(_nz("window_sentiment", 0.0)) * 2, F.lit(1.0))
          + 0.4 * F.least(F.abs(_nz("z_score", 0.0)) / 3.0, F.lit(1.0))
          + 0.2 * F.least(_nz("window_mentions", 5.0) / 20.0, F.lit(1.0)))
    z_avg = (F.abs(_nz("pct_3d_z", 0.0)) + F.abs(_nz("ret_z", 0.0)) + F.abs(_nz("vol_z", 0.0))) / 3
    entry = F.greatest(F.lit(0.0), 1.0 - z_avg / 2.0)
    ve = _nz("vol_expansion", 1.0)
    vol_score = (F.when(ve < 1.0, ve).when(ve <= 1.75, F.lit(1.0))
                  .otherwise(F.greatest(F.lit(0.0), 1.0 - (ve - 1.75) / 2)))
    atr = F.abs(_nz("atr_move", 0.0))
    atr_score = F.when(atr < 2.0, F.least(atr / 1.5, F.lit(1.0))).otherwise(
        F.greatest(F.lit(0.0), 1.0 - (atr - 2.0) / 2))
    volatility = 0.5 * vol_score + 0.5 * atr_score
    strength = F.least(F.abs(_nz("signal_score", 0.0)) / 3.0, F.lit(1.0))
    return 0.35 * sq + 0.25 * strength + 0.20 * entry + 0.20 * volatility


def position_share(composite: Column, max_position, sizing="composite") -> Column:
    """min(0.03 + 0.07 * composite, max_position); the flat variant is max_position.

    The constants are fixed values.
    """
    cap = _pcol(max_position).cast("double")
    return F.when(_pcol(sizing) == "flat", cap).otherwise(F.least(0.03 + 0.07 * composite, cap))


# ------------------------------------------------------- signals and entry

def direction() -> Column:
    """+1 long / -1 short from signal_type or signal_direction; NULL if neither."""
    t, d = F.col("signal_type"), F.col("signal_direction")
    buy = F.coalesce(t == "BUY", F.lit(False)) | F.coalesce(d == 1, F.lit(False))
    sell = F.coalesce(t == "SELL", F.lit(False)) | F.coalesce(d == -1, F.lit(False))
    return F.when(buy, 1).when(sell, -1)


def long_only(signals: DataFrame) -> DataFrame:
    """BUY or direction +1."""
    return signals.filter(F.coalesce(F.col("signal_type") == "BUY", F.lit(False))
                          | F.coalesce(F.col("signal_direction") == 1, F.lit(False)))


def tradable_signals(signals: DataFrame, p: BacktestParams) -> DataFrame:
    """Known direction, date inside [start, end] and (unless trade_weekends) Mon-Fri."""
    s = signals.withColumn("dir", direction()).filter(F.col("dir").isNotNull())
    s = s.filter(~_pcol(p.long_only) | (F.col("dir") == 1))  # a row that is BUY or +1 has direction +1
    s = s.filter(F.col("signal_date").between(as_date(p.start), as_date(p.end)))
    return s.filter(_pcol(p.trade_weekends) | (F.weekday("signal_date") < 5))


def next_bar(events: DataFrame, bars: DataFrame, date_col: str, inclusive: bool = False,
             fields=("open", "close"), prefix: str = "nb_") -> DataFrame:
    """For each event row, the first bar of its ticker with date > ``date_col``
    (``>=`` when ``inclusive``); adds ``{prefix}date`` and ``{prefix}<field>``.

    An as-of join without a range join: events and bars are unioned per
    ticker and scanned once in descending date order; ``last(bar, ignorenulls)``
    over the rows before the current one is the nearest later bar. Cost is a
    sort of (events + bars) per ticker, never events x bars.
    """
    bar_struct = F.struct(F.col("date").alias("date"), *[F.col(f).alias(f) for f in fields])
    b = bars.select(F.col("ticker"), F.col("date").alias("_d"), F.lit(0).alias("_kind"), bar_struct.alias("_bar"))
    keys = (events.select(F.col("ticker"), F.col(date_col).alias("_d")).distinct()
                  .select("ticker", "_d", F.lit(1).alias("_kind"),
                          F.lit(None).cast(b.schema["_bar"].dataType).alias("_bar")))
    # strict: at equal dates the event precedes the bar in the descending scan
    kind_order = F.col("_kind").asc() if inclusive else F.col("_kind").desc()
    w = (Window.partitionBy("ticker").orderBy(F.col("_d").desc(), kind_order)
         .rowsBetween(Window.unboundedPreceding, -1))
    found = (b.unionByName(keys)
              .withColumn("_nb", F.last("_bar", ignorenulls=True).over(w))
              .filter(F.col("_kind") == 1)
              .select("ticker", F.col("_d").alias("_k"), "_nb"))
    out = events.join(found, (events["ticker"] == found["ticker"]) & (events[date_col] == found["_k"]), "left")
    sel = [events[c] for c in events.columns] + [F.col("_nb.date").alias(prefix + "date")]
    sel += [F.col(f"_nb.{f}").alias(prefix + f) for f in fields]
    return out.select(*sel)


# ------------------------------------------------------------------- exits

def _signed_return(price: Column) -> Column:
    """T4: long (x - e)/e, short (e - x)/e."""
    e = F.col("entry_price")
    return F.when(F.col("dir") == 1, (price - e) / e).otherwise((e - price) / e)


def candidate_trades(signals: DataFrame, bars: DataFrame, p: BacktestParams) -> DataFrame:
    """T1 + T2 + T3 + T4 for every tradable signal, independent of other signals.

    Exit rule on each Mon-Fri bar date >= entry (and <= end), close vs entry:
    return <= -stop -> stop_loss; >= take -> take_profit; calendar days held
    >= max_holding -> max_holding. No hit -> the last bar <= end, 'end_of_period'.
    The barrier search joins each trade with the bars of its first
    ``max_holding`` calendar days on (ticker, date) - a bounded expansion,
    no range join - and takes the first checked bar at or after
    entry + max_holding with one more as-of lookup.
    """
    start, end = as_date(p.start), as_date(p.end)
    # exit parameters travel as columns, so a sweep can vary them per row
    sig = (tradable_signals(signals, p)
           .withColumn("_stop", _pcol(p.stop_loss).cast("double"))
           .withColumn("_take", _pcol(p.take_profit).cast("double"))
           .withColumn("_mh", _pcol(p.max_holding_days).cast("int")))
    bars_in = bars.filter(F.col("date") <= end)
    ent = next_bar(sig, bars_in, "signal_date", inclusive=False, fields=("open",), prefix="entry_")
    ent = (ent.filter(F.col("entry_date").isNotNull())
              .withColumnRenamed("entry_open", "entry_price")
              .withColumn("trade_id", F.concat_ws("|", *p.keys, "ticker", F.col("signal_date").cast("string"),
                                                  "signal_type")))
    ent = materialize(ent)  # small (one row a signal); four branches below would each repeat the as-of pass
    checked = bars_in.filter((F.weekday("date") < 5) & (F.col("date") >= start)).select("ticker", "date", "close")
    stop, take, mh = F.col("_stop"), F.col("_take"), F.col("_mh")

    # (a) stop / take inside the first max_holding calendar days
    early = (ent.select("trade_id", "ticker", "entry_date", "entry_price", "dir", "_stop", "_take",
                        F.explode(F.when(mh > 0, F.sequence(F.col("entry_date"),
                                                            F.date_add("entry_date", mh - 1)))).alias("date"))
                .join(checked, ["ticker", "date"])
                .withColumn("ret", _signed_return(F.col("close")))
                .filter((F.col("ret") <= -stop) | (F.col("ret") >= take))
                .groupBy("trade_id")
                .agg(F.min_by(F.struct("date", "close", "ret"), "date").alias("_a")))
    # (b) first checked bar on or after entry + max_holding
    late_key = ent.select("trade_id", "ticker", F.date_add("entry_date", F.col("_mh")).alias("_late"))
    late = (next_bar(late_key, checked, "_late", inclusive=True, fields=("close",), prefix="late_")
            .select("trade_id", "late_date", "late_close"))
    # (c) last bar <= end
    last = bars_in.groupBy("ticker").agg(F.max_by(F.struct("date", "close"), "date").alias("_c"))

    t = ent.join(late, "trade_id", "left").join(last, "ticker", "left").join(early, "trade_id", "left")
    late_ret = _signed_return(F.col("late_close"))
    late_reason = (F.when(late_ret <= -F.col("_stop"), "stop_loss")
                    .when(late_ret >= F.col("_take"), "take_profit").otherwise("max_holding"))
    a_reason = F.when(F.col("_a.ret") <= -F.col("_stop"), "stop_loss").otherwise("take_profit")
    t = (t.withColumn("exit_date", F.coalesce(F.col("_a.date"), F.col("late_date"), F.col("_c.date")))
          .withColumn("exit_price", F.coalesce(F.col("_a.close"), F.col("late_close"), F.col("_c.close")))
          .withColumn("exit_reason", F.when(F.col("_a").isNotNull(), a_reason)
                      .when(F.col("late_date").isNotNull(), late_reason).otherwise(F.lit("end_of_period")))
          .withColumn("ret", _signed_return(F.col("exit_price")))
          .drop("_a", "late_date", "late_close", "_c", "_stop", "_take", "_mh"))
    return t


def one_position_per_ticker(cands: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """T5: accept a candidate only if no accepted trade of its ticker is still open
    on its signal date; a trade closes at the start of its exit day (so a signal
    on that day is accepted) and an end_of_period trade never closes.
    """
    key = F.when(F.col("exit_reason") == "end_of_period", F.lit(FAR_FUTURE).cast("date")).otherwise(
        F.col("exit_date"))
    items = F.struct(F.col("signal_date").alias("s"), F.col("signal_type").alias("t"),
                     F.col("trade_id").alias("id"), key.alias("x"))
    init = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<string>").alias("ids"))
    acc = (cands.groupBy(*keys, "ticker")
                .agg(F.aggregate(F.array_sort(F.collect_list(items)), init,
                                 lambda a, v: F.when(a["last"].isNull() | (v["s"] >= a["last"]),
                                                     F.struct(v["x"].alias("last"),
                                                              F.array_append(a["ids"], v["id"]).alias("ids")))
                                 .otherwise(a)).alias("_acc"))
                .select(F.explode("_acc.ids").alias("trade_id")))
    return cands.join(acc, "trade_id", "left_semi")


def trade_table(signals: DataFrame, bars: DataFrame, p: BacktestParams) -> DataFrame:
    """Accepted trades with notional, P&L and exit reason."""
    return sized(one_position_per_ticker(candidate_trades(signals, bars, p), p.keys), p)


def sized(t: DataFrame, p: BacktestParams) -> DataFrame:
    """Notional and P&L (M10, M11, T4) of accepted candidates."""
    comp = composite_score(t.columns)
    share = position_share(comp, p.max_position, p.sizing)
    return t.select(
        *p.keys, "trade_id", "ticker", "signal_date", "signal_type", "entry_date", "exit_date",
        F.when(F.col("dir") == 1, "long").otherwise("short").alias("direction"),
        "entry_price", "exit_price", days_between("exit_date", "entry_date").alias("days_held"),
        (F.lit(p.capital) * share).alias("position_size"),
        comp.alias("signal_score"),
        (F.lit(p.capital) * share * F.col("ret")).alias("pnl"),
        (F.col("ret") * 100).alias("pnl_pct"),
        "exit_reason")


def calendar(spark, start, end) -> DataFrame:
    """The Mon-Fri dates of [start, end]."""
    days = spark.range(1).select(F.explode(F.sequence(as_date(start), as_date(end))).alias("date"))
    return days.filter(F.weekday("date") < 5)  # a filter, because bounds may be scalar subqueries


def held_returns(trades: DataFrame, bars: DataFrame, p: BacktestParams) -> DataFrame:
    """A row per trade and business day it is held (entry <= day < exit; end_of_period trades stay held until
    ``p.end``), with ``unit``: the trade's return at the day's close, null when the ticker has no bar."""
    end = as_date(p.end)
    last_held = F.when(F.col("exit_reason") == "end_of_period", end).otherwise(F.date_sub("exit_date", 1))
    # sequence() counts down when stop < start: no held day then
    days = F.explode(F.when(F.least(last_held, end) >= F.col("entry_date"), F.sequence(F.col("entry_date"), F.least(last_held, end))))
    held = trades.withColumn("date", days).filter(F.weekday("date") < 5)
    return (held.join(bars.select("ticker", "date", "close"), ["ticker", "date"], "left")
            .withColumn("unit", _signed_return(F.col("close"))).drop("close"))


def equity_curve(trades: DataFrame, bars: DataFrame | None, p: BacktestParams, spark=None,
                 key: str | None = None, keys: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """T7 (+J8): portfolio value on every business day of [start, end].

    value = capital + realised P&L of trades closed on or before the day
            + mark-to-market of trades held that day (entry <= day < exit;
              end_of_period trades stay held), size * return at the day's close,
              0 when the ticker has no bar that day.
    Each trade is expanded to its held days only (bounded by its holding
    period), then everything is aggregated to one row per day before the
    single, calendar-sized running sum.

    With ``key`` (a column of ``trades``) there is one curve per key value;
    ``keys`` lists all of them (a curve without trades stays at capital).
    ``marks``: the sums by key and day (``_open``, ``n_positions``), if they are known already.
    """
    spark = spark or trades.sparkSession
    end = as_date(p.end)
    kc = [key] if key else []
    if key:
        days = keys.select(key, F.explode(F.sequence(as_date(p.start), end)).alias("date"))
        cal = days.filter(F.weekday("date") < 5)
    else:
        cal = calendar(spark, p.start, p.end)
    closed = (trades.filter(F.col("exit_reason") != "end_of_period")
                    .groupBy(*kc, F.col("exit_date").alias("date")).agg(F.sum("pnl").alias("_realised")))
    if marks is None:
        sides = trades.select(*kc, "ticker", "entry_date", "exit_date", "exit_reason", "entry_price", "position_size",
                              F.when(F.col("direction") == "long", 1).otherwise(-1).alias("dir"))
        marks = (held_returns(sides, bars, p)
                 .withColumn("_m", F.coalesce(F.col("position_size") * F.col("unit"), F.lit(0.0)))
                 .groupBy(*kc, "date").agg(F.sum("_m").alias("_open"), F.count(F.lit(1)).alias("n_positions")))
    w = Window.partitionBy(*kc).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (cal.join(closed, kc + ["date"], "left").join(marks, kc + ["date"], "left")
               .withColumn("realised_pnl", F.sum(F.coalesce(F.col("_realised"), F.lit(0.0))).over(w))
               .withColumn("open_pnl", F.coalesce(F.col("_open"), F.lit(0.0)))
               .withColumn("portfolio_value", F.lit(p.capital) + F.col("realised_pnl") + F.col("open_pnl"))
               .withColumn("n_positions", F.coalesce(F.col("n_positions"), F.lit(0)).cast("long"))
               .select(*kc, "date", "portfolio_value", "realised_pnl", "open_pnl", "n_positions"))
