"""Large grids: shards of points that survive an interruption, and what they share."""

import pytest

from paths import SF001
from tickerpulse.operators import daily, market, shock, sweep, trades
from tickerpulse.session import materialize, scratch_path
from tickerpulse.sources import fixtures as fx

POINTS = sweep.grid({"bullish_bias": [0.0, 0.5], "z_threshold": [1.5, 3.5], "stop_loss": [0.02, 0.07], "long_only": [True, False]})


@pytest.fixture(scope="module")
def inputs(spark):
    bars = materialize(fx.price_bars(spark, SF001))
    days = bars.agg({"date": "min"}).first()[0], bars.agg({"date": "max"}).first()[0]
    table = materialize(daily.daily_sentiment_weighted(fx.sentiment_results(spark, SF001)))
    bp = trades.BacktestParams(start=str(days[0]), end=str(days[1]), sizing="flat", max_holding_days=7)
    return table, bars, shock.ShockParams(min_mentions=1), market.MarketParams(), bp


def rows(df):
    names = [c for c in df.columns if not c.endswith("_threshold") or c == "base_z_threshold"]
    return {r["point_id"]: {c: round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names} for r in df.collect()}


def test_full_grid_has_the_three_groups():
    points = sweep.full_grid()
    assert len(points) == 31_104 and len({tuple(p.items()) for p in points}) == 31_104


def test_an_interrupted_sweep_goes_on_with_the_open_shards(spark, inputs, monkeypatch):
    table, bars, sp, mp, bp = inputs
    path = scratch_path(spark, "shards")
    board, calls = sweep.board, []

    def failing(shared, spark, own, base):
        calls.append([p["point_id"] for p in own])
        if len(calls) == 3:
            raise KeyboardInterrupt
        return board(shared, spark, own, base)

    monkeypatch.setattr(sweep, "board", failing)
    with pytest.raises(KeyboardInterrupt):
        sweep.sweep_in_shards(table, bars, POINTS, sp, mp, bp, path, 4)
    got = sweep.sweep_in_shards(table, bars, POINTS, sp, mp, bp, path, 4)
    assert [c[0] for c in calls] == ["p00000", "p00004", "p00008", "p00008", "p00012"]  # the first two shards ran once
    monkeypatch.setattr(sweep, "shared_stages", None)  # nothing is left to do
    again = sweep.sweep_in_shards(table, bars, POINTS, sp, mp, bp, path, 4)
    monkeypatch.undo()
    assert rows(got) == rows(again)
    whole = rows(sweep.sweep(table, bars, POINTS, sp, mp, bp))
    assert rows(got) == whole and len(whole) == 16 and any(r["n_trades"] for r in whole.values())


def test_exits_are_searched_once_per_signal_and_exit_set(inputs):
    table, bars, sp, mp, bp = inputs
    full = sweep.resolve(POINTS, sp, mp, bp)
    shared = sweep.shared_stages(table, bars, full, sp, mp, bp)
    n = shared.exits.count()
    assert n == shared.exits.select(*sweep.EXIT_KEYS).distinct().count()
    signals = shared.kept.select("ticker", "signal_date", "signal_type").distinct().count()
    assert 0 < n <= 2 * signals  # two stops, however many points
