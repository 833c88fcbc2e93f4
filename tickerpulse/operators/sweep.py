"""Parameter sweep.

The grid is a table of points. What few parameters share is computed once (see :func:`shared_stages`): signals and
moved bars per set of their parameters, exits and marks once per (signal, exit parameters). A point then picks
its signals and exits by equi-joins. :func:`sweep` runs a grid as one plan, :func:`sweep_in_shards` a large
one (the reference's three groups make 31,104 points) in shards of points that survive an interruption.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SIGNAL_COLUMNS
from ..session import materialize
from ..sources.versions import VersionedTable
from . import market, metrics, shock, trades

# The two-phase grid of the reference's sweep.
PHASE1_SIGNAL_GRID = {"min_mentions": [3, 5], "base_z_threshold": [1.8, 2.0]}
PHASE1_FILTER_GRID = {"z_threshold": [2.0, 2.5]}
PHASE1_BACKTEST = {"stop_loss": 0.07, "take_profit": 0.10, "max_holding_days": 7, "max_position": 0.10,
                   "long_only": False}
PHASE2_BACKTEST_GRID = {"stop_loss": [0.05, 0.07, 0.10], "take_profit": [0.08, 0.10, 0.12],
                        "max_holding_days": [5, 7, 10]}
# The three parameter groups of the reference's full grid (72 x 27 x 16 points).
FULL_SIGNAL_GRID = {"window_days": [3, 5], "baseline_days": [21, 30], "min_mentions": [3, 5], "base_z_threshold": [1.5, 1.8, 2.0],
                    "bullish_bias": [0.0, 0.3, 0.5]}
FULL_FILTER_GRID = {"z_threshold": [1.5, 2.0, 2.5], "vol_expansion_threshold": [1.5, 1.75, 2.0], "atr_move_threshold": [1.5, 2.0, 2.5]}
FULL_BACKTEST_GRID = {"stop_loss": [0.05, 0.07], "take_profit": [0.10, 0.15], "max_holding_days": [5, 10], "long_only": [True, False]}


def grid(spec: dict[str, list]) -> list[dict]:
    """The cartesian product of a dict of lists (a small, fixed parameter set)."""
    keys = list(spec)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[spec[k] for k in keys])]


SIGNAL_FIELDS = tuple(f.name for f in fields(shock.ShockParams))
FILTER_FIELDS = tuple(f.name for f in fields(market.MarketParams))
TRADE_FIELDS = ("max_position", "stop_loss", "take_profit", "max_holding_days", "long_only", "sizing", "trade_weekends")
WINDOW_FIELDS = ("window_days", "baseline_days", "min_baseline_days")  # these shape the shock windows
BAR_FIELDS = ("lookback", "atr_days", "recent_days", "min_history")     # these shape the market metrics
# grid names of the market filter that mean a field of the same object
MAXIMA = {"pct_3d_z": "z_threshold", "ret_z": "z_threshold", "vol_z": "z_threshold",
          "vol_expansion": "vol_expansion_threshold", "atr_move": "atr_move_threshold"}


def resolve(points: list[dict], base_sp: shock.ShockParams, base_mp: market.MarketParams,
            base_bp: trades.BacktestParams) -> list[dict]:
    """Every point with all its fields; a name that is no field of any stage is an error."""
    known = {*SIGNAL_FIELDS, *FILTER_FIELDS, *TRADE_FIELDS}
    out = []
    for k, point in enumerate(points):
        unknown = set(point) - known
        if unknown:
            raise ValueError(f"sweep point {k}: unknown parameters {sorted(unknown)}")
        full = {f: getattr(base_sp, f) for f in SIGNAL_FIELDS} | {f: getattr(base_mp, f) for f in FILTER_FIELDS}
        full |= {f: getattr(base_bp, f) for f in TRADE_FIELDS}
        out.append({"point_id": f"p{k:05d}", **full, **point})
    return out


def full_grid() -> list[dict]:
    """All combinations of the three groups, exits varying fastest, so that neighbours share their signals."""
    return grid(FULL_SIGNAL_GRID | FULL_FILTER_GRID | FULL_BACKTEST_GRID)


def _params(spark, points: list[dict]) -> DataFrame:
    """The grid as a table: one row per point, one typed column per parameter."""
    kinds = {bool: "boolean", str: "string", int: "double", float: "double"}
    names = list(points[0])
    schema = ", ".join(f"{n} {kinds[type(points[0][n])]}" for n in names)
    return spark.createDataFrame([tuple(float(v) if kinds[type(v)] == "double" else v for v in p.values()) for p in points], schema)


EXIT_FIELDS = ("stop_loss", "take_profit", "max_holding_days")


def _set_of(names) -> Column:
    return F.concat_ws("|", *[F.col(n).cast("string") for n in names])


def _point_table(spark, full: list[dict]) -> DataFrame:
    """One row per point, with the names of the parameter sets it belongs to."""
    sets = {"window_set": WINDOW_FIELDS, "bar_set": BAR_FIELDS, "signal_set": SIGNAL_FIELDS, "filter_set": FILTER_FIELDS,
            "exit_set": EXIT_FIELDS}
    params = _params(spark, full)
    return params.select("*", *[_set_of(names).alias(k) for k, names in sets.items()])


@dataclass(frozen=True)
class Shared:
    """What all points of a grid share: unmoved signals by (signal set, filter set); the exits of every different signal
    by exit set; and the marks of these trades: their return at each day's close while held."""
    kept: DataFrame
    exits: DataFrame
    marks: DataFrame


def shared_stages(daily: DataFrame, bars: DataFrame, full: list[dict], base_sp: shock.ShockParams,
                  base_mp: market.MarketParams, base_bp: trades.BacktestParams) -> Shared:
    """The stages below the points, for resolved points ``full``; no input is copied per point.

    * Shock windows are computed once per different set of window lengths, market metrics once per
      different set of bar lengths (usually one each).
    * A day of a ticker can only be a signal if it passes the loosest thresholds of the grid; those few rows
      meet the signal sets (different signal parameters) in an equi-join on the window set.
    * "Moved in the last bars" is a comparison of rolling maxima, so each bar has its maxima once, and
      a signal compares them with its filter set's thresholds.
    * An exit follows from the signal's ticker, day and direction and from the exit parameters, so the barriers are
      searched once for each of these, however many points use them; likewise the marks while a trade is held.
    """
    params = _point_table(daily.sparkSession, full)
    windows = []
    for lengths in sorted({tuple(p[f] for f in WINDOW_FIELDS) for p in full}):
        sp = replace(base_sp, **dict(zip(WINDOW_FIELDS, lengths)))
        name = "|".join(str(float(x)) for x in lengths)
        windows.append(shock.shock_windows(daily, sp).withColumn("window_set", F.lit(name)))
    loose = {f: min(p[f] for p in full) for f in ("min_mentions", "min_abs_sent_change")}
    able = _union(windows).filter(F.col("baseline_std").isNotNull() & (F.col("baseline_std") > 0) & F.col("window_sentiment").isNotNull()
                                  & (F.col("window_mentions") >= loose["min_mentions"])
                                  & (F.col("abs_sent_change") >= loose["min_abs_sent_change"])).drop("z_threshold")
    signal_sets = params.select("signal_set", "window_set", *[f for f in SIGNAL_FIELDS if f not in WINDOW_FIELDS]).distinct()
    tried = able.join(signal_sets, "window_set")
    tried = tried.withColumn("z_threshold", F.col("base_z_threshold") / (
        1 + F.col("mention_sensitivity") * F.log1p(F.greatest(F.col("window_mentions"), F.lit(1.0)))))
    rule = replace(base_sp, **{c: F.col(c) for c in ("min_mentions", "min_abs_sent_change", "bullish_bias")})
    signals = (shock.with_signals(tried, rule).filter(F.col("signal_type") != "NONE")
               .withColumnRenamed("date", "signal_date").select("signal_set", *SIGNAL_COLUMNS))

    states = []
    for lengths in sorted({tuple(p[f] for f in BAR_FIELDS) for p in full}):
        mp = replace(base_mp, **dict(zip(BAR_FIELDS, lengths)))
        name = "|".join(str(float(x)) for x in lengths)
        recent = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(mp.recent_days - 1), 0)
        tops = [F.max(F.abs(c) if c.endswith("_z") else F.col(c)).over(recent).alias(f"top_{c}") for c in MAXIMA]
        metrics_of = market.market_metrics(bars, mp).select("ticker", F.col("date").alias("signal_date"), "bar_n", *tops)
        states.append(metrics_of.filter(F.col("bar_n") >= mp.min_history).withColumn("bar_set", F.lit(name)))
    pairs = params.select("signal_set", "filter_set", "bar_set", *set(MAXIMA.values())).distinct()
    moved = F.lit(False)
    for metric, threshold in MAXIMA.items():
        moved = moved | F.coalesce(F.col(f"top_{metric}") >= F.col(threshold), F.lit(False))
    kept = materialize(signals.join(pairs, "signal_set").join(_union(states), ["ticker", "signal_date", "bar_set"]).filter(~moved)
                       .select("signal_set", "filter_set", *SIGNAL_COLUMNS))

    exit_sets = sorted({tuple(float(p[f]) for f in EXIT_FIELDS) for p in full})
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(EXIT_FIELDS, e)]) for e in exit_sets]))
    asked = kept.select("ticker", "signal_date", "signal_type", "signal_direction").distinct().withColumn("_e", each)
    asked = asked.select("*", *[F.col(f"_e.{f}").alias(f) for f in EXIT_FIELDS]).withColumn("exit_set", _set_of(EXIT_FIELDS)).drop("_e")
    bp = replace(base_bp, keys=("exit_set",), long_only=False, trade_weekends=True, **{f: F.col(f) for f in EXIT_FIELDS})
    exits = materialize(trades.candidate_trades(asked, bars, bp).drop("trade_id", "signal_direction", *EXIT_FIELDS))
    return Shared(kept, exits, materialize(trades.held_returns(exits, bars, base_bp).select(*EXIT_KEYS, "date", "unit")))


EXIT_KEYS = ["exit_set", "ticker", "signal_date", "signal_type"]


def board(shared: Shared, spark, full: list[dict], base_bp: trades.BacktestParams) -> DataFrame:
    """One leaderboard row per point of ``full``: trades, equity and metrics keyed by the point.

    Signals meet the points of their (signal set, filter set), and the exits and marks of their exit set, in
    equi-joins; only "one open position per ticker" and the sums per day are a point's own work.
    """
    params = materialize(_point_table(spark, full))
    chosen = shared.kept.join(params.select("point_id", "signal_set", "filter_set", "exit_set", "max_position", "long_only", "sizing",
                                            "trade_weekends"), ["signal_set", "filter_set"])
    cands = chosen.join(shared.exits, EXIT_KEYS).filter((~F.col("long_only") | (F.col("dir") == 1))
                                                        & (F.col("trade_weekends") | (F.weekday("signal_date") < 5)))
    cands = cands.withColumn("trade_id", F.concat_ws("|", "point_id", "ticker", F.col("signal_date").cast("string"), "signal_type"))
    taken = trades.one_position_per_ticker(cands, ("point_id",))
    bp = replace(base_bp, keys=("point_id", "exit_set"), max_position=F.col("max_position"), sizing=F.col("sizing"))
    tt = materialize(trades.sized(taken, bp))
    marks = (tt.join(shared.marks, EXIT_KEYS).groupBy("point_id", "date")
             .agg(F.sum(F.coalesce(F.col("position_size") * F.col("unit"), F.lit(0.0))).alias("_open"), F.count(F.lit(1)).alias("n_positions")))
    curve = trades.equity_curve(tt, None, base_bp, key="point_id", keys=params, marks=marks)
    perf = metrics.performance(curve, base_bp.capital, key="point_id")
    n_sig = shared.kept.groupBy("signal_set", "filter_set").agg(F.count_if(F.col("signal_type") == "BUY").alias("n_buy_signals"),
                                                                F.count_if(F.col("signal_type") == "SELL").alias("n_sell_signals"))
    n_tr = tt.groupBy("point_id").agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("pnl") > 0).alias("_wins"))
    j = params.join(perf, "point_id", "left").join(n_sig, ["signal_set", "filter_set"], "left").join(n_tr, "point_id", "left")
    n_trades = F.coalesce(F.col("n_trades"), F.lit(0))
    has = n_trades > 0
    return j.select(
        "point_id", "min_mentions", "base_z_threshold", "z_threshold", "stop_loss", "take_profit",
        F.col("max_holding_days").cast("int").alias("max_holding_days"), "window_days", "baseline_days", "bullish_bias",
        "long_only", "max_position", "total_return", "final_value",
        n_trades.alias("n_trades"),
        F.coalesce(F.col("n_buy_signals"), F.lit(0)).alias("n_buy_signals"),
        F.coalesce(F.col("n_sell_signals"), F.lit(0)).alias("n_sell_signals"),
        F.when(has, F.col("_wins") / n_trades * 100).otherwise(F.lit(0.0)).alias("win_rate"),
        F.when(has, F.col("sharpe")).otherwise(F.lit(0.0)).alias("sharpe"),
        F.when(has, F.col("max_drawdown")).otherwise(F.lit(0.0)).alias("max_drawdown"),
        "vol_expansion_threshold", "atr_move_threshold")


def sweep(daily: DataFrame, bars: DataFrame, points: list[dict], base_sp: shock.ShockParams,
          base_mp: market.MarketParams, base_bp: trades.BacktestParams) -> DataFrame:
    """One leaderboard row per grid point (dicts overriding fields of the base parameters)."""
    full = resolve(points, base_sp, base_mp, base_bp)
    shared = shared_stages(daily, bars, full, base_sp, base_mp, base_bp)
    return board(shared, daily.sparkSession, full, base_bp).drop("vol_expansion_threshold", "atr_move_threshold")


def sweep_in_shards(daily: DataFrame, bars: DataFrame, points: list[dict], base_sp: shock.ShockParams, base_mp: market.MarketParams,
                    base_bp: trades.BacktestParams, path: str, shard_points: int = 1024) -> DataFrame:
    """T9 for large grids: the rows of :func:`sweep` and the two other filter thresholds, kept in the versioned table at ``path``.

    Points are run ``shard_points`` at a time; a finished shard is published as a part of the table, named by
    a hash of its points and of the base parameters. A run that was interrupted finds its finished shards
    there and computes the others only. Parts of other grids in the table are kept, and not returned.
    """
    spark = daily.sparkSession
    full = resolve(points, base_sp, base_mp, base_bp)
    fixed = json.dumps([repr(asdict(base_sp)), repr(asdict(base_mp)), base_bp.capital])
    shards = {}
    for k in range(0, len(full), shard_points):
        own = full[k:k + shard_points]
        shards["shard-" + hashlib.sha256((fixed + json.dumps(own, sort_keys=True)).encode()).hexdigest()[:24]] = own
    table = VersionedTable(spark, path)
    m = table.manifest()
    open_shards = {name: own for name, own in shards.items() if not m or name not in m.parts}
    if open_shards:
        shared = shared_stages(daily, bars, full, base_sp, base_mp, base_bp)
        for name, own in open_shards.items():
            rows = board(shared, spark, own, base_bp)
            (folders,) = table.write(rows).values()
            m = table.publish(m, rows.schema, (dict(m.parts) if m else {}) | {name: folders})
    return table.rows(m, list(shards))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def leaderboard(results: DataFrame, metric: str = "sharpe", n: int = 10) -> DataFrame:
    """The top ``n`` points by ``metric`` (ties by point id)."""
    return results.orderBy(F.col(metric).desc(), "point_id").limit(n)


def impact_by_parameter(results: DataFrame, params: list[str], metric: str = "total_return") -> DataFrame:
    """Mean / max / std / min of ``metric`` for each value of each parameter (long form)."""
    parts = []
    for p in params:
        parts.append(results.groupBy(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("value"))
                            .agg(F.avg(metric).alias("mean"), F.max(metric).alias("max"),
                                 F.stddev_samp(metric).alias("std"), F.min(metric).alias("min")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def pivot_mean(results: DataFrame, index: str, columns: str, metric: str = "total_return",
               values: list | None = None) -> DataFrame:
    """Mean ``metric`` with ``index`` rows and ``columns`` columns."""
    return results.groupBy(index).pivot(columns, values).agg(F.avg(metric))
