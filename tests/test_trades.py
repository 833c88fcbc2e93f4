import datetime as dt

import pytest

from tickerpulse.operators import market, metrics, shock, sweep, trades


def test_signal_on_exit_date_is_accepted_and_eop_blocks(spark):
    d = dt.date
    bars = spark.createDataFrame(
        [("X", d(2024, 1, i), 100.0, 100.0 + (20 if i == 3 else 0)) for i in range(1, 11)],
        "ticker string, date date, open double, close double")
    sig = spark.createDataFrame(
        [("X", d(2024, 1, 1), "BUY", 1), ("X", d(2024, 1, 2), "BUY", 1), ("X", d(2024, 1, 3), "BUY", 1),
         ("X", d(2024, 1, 8), "SELL", -1)],
        "ticker string, signal_date date, signal_type string, signal_direction int")
    p = trades.BacktestParams(start="2024-01-01", end="2024-01-10", sizing="flat", max_holding_days=5)
    t = {r["signal_date"].day: r for r in trades.trade_table(sig, bars, p).collect()}
    # Jan 1 enters Jan 2, take-profit Jan 3; the Jan 3 signal is accepted (exit runs first)
    assert t[1]["exit_date"] == d(2024, 1, 3) and t[1]["exit_reason"] == "take_profit"
    assert 2 not in t and 3 in t
    assert t[3]["entry_date"] == d(2024, 1, 4) and t[3]["exit_reason"] == "max_holding"
    assert t[3]["exit_date"] == d(2024, 1, 9)
    assert 8 not in t  # position from Jan 3 still open on Jan 8


def test_composite_and_position_share(spark):
    rows = [(0.25, 1.5, 10.0, 1.0, 1.0, 1.0, 1.0, 1.5, -1.5), (None,) * 9, (9.0, -9.0, 99.0, 9.0, 9.0, 9.0, 2.75, 3.0, 9.0)]
    names = ["window_sentiment", "z_score", "window_mentions", "pct_3d_z", "ret_z", "vol_z", "vol_expansion", "atr_move", "signal_score"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    comp = trades.composite_score(df.columns)
    got = df.select(comp, trades.position_share(comp, 0.05), trades.position_share(comp, 0.05, "flat")).collect()
    # quality 0.2 + 0.2 + 0.1, strength 0.5, entry 1 - 1/2, volatility 0.5 + 0.5
    assert got[0][0] == pytest.approx(0.35 * 0.5 + 0.25 * 0.5 + 0.2 * 0.5 + 0.2 * 1.0)
    # defaults: five mentions (0.2 * 0.25), calm market (entry 1), expansion 1 and no move (0.5)
    assert got[1][0] == pytest.approx(0.35 * 0.05 + 0.2 * 1.0 + 0.2 * 0.5)
    # all quality, all strength, no entry, expansion 2.75 gives 0.5 and a move of 3 gives 0.5
    assert got[2][0] == pytest.approx(0.35 + 0.25 + 0.2 * 0.5)
    assert got[0][1] == pytest.approx(0.05) and got[1][1] == pytest.approx(0.05) and got[2][2] == pytest.approx(0.05)
    assert df.select(trades.position_share(comp, 1.0)).collect()[1][0] == pytest.approx(0.03 + 0.07 * 0.3175)


def test_metrics_of_a_curve_that_is_lost(spark):
    d = dt.date
    curve = spark.createDataFrame([("s", d(2024, 1, k + 1), v) for k, v in enumerate([100.0, 50.0, -10.0, 20.0])],
                                  "name string, date date, portfolio_value double")
    got = metrics.performance(curve.filter("portfolio_value <> 20"), 100.0).first()
    assert got["annualized_return"] == -100.0 and got["total_return"] == pytest.approx(-110.0) and got["max_drawdown"] == pytest.approx(-110.0)
    steps = {r["date"].day: r["daily_return"] for r in metrics.with_returns(curve).collect()}
    assert steps[1] is None and steps[2] == -0.5 and steps[3] == pytest.approx(-1.2) and steps[4] is None


def test_statistics_of_no_trades(spark):
    none = spark.createDataFrame([], "pnl double, pnl_pct double, signal_score double")
    got = metrics.trade_stats(none).first().asDict()
    assert (got["trades"], got["wins"], got["losses"], got["profit_factor"]) == (0, 0, 0, 0.0)
    assert got["win_rate"] is None and got["loss_rate"] is None and got["total_pnl"] is None
    assert metrics.score_relationship(none).first().asDict() == {"correlation": None, "slope": None, "intercept": None}


def test_relationship_of_few_trades(spark):
    kind = "signal_score double, pnl_pct double"
    same_score = metrics.score_relationship(spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], kind)).first()
    same_return = metrics.score_relationship(spark.createDataFrame([(3.0, 1.0), (4.0, 1.0)], kind)).first()
    assert same_score["correlation"] is None and same_score["slope"] is None
    assert same_return["correlation"] is None and same_return["slope"] == 0.0
    got = metrics.score_relationship(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 6.0), (None, 9.0), (7.0, None)], kind)).first()
    assert got["correlation"] == pytest.approx(4 / (2 * 14) ** 0.5)


def test_sweep_rejects_unknown_parameters():
    base = shock.ShockParams(), market.MarketParams(), trades.BacktestParams(start="2024-01-01", end="2024-02-01")
    with pytest.raises(ValueError, match="stop_los"):
        sweep.resolve([{"stop_los": 0.1}], *base)
    full = sweep.resolve([{"long_only": True}, {"window_days": 5}], *base)
    assert full[0]["long_only"] is True and full[1]["window_days"] == 5 and full[1]["long_only"] is False
