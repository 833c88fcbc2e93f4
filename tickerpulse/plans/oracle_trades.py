"""DuckDB SQL twins of the trade, metrics and sweep queries.

Written from the rules, not from the Spark plans: an exit is the first bar that meets any barrier
(one range join), "one open position" is a recursion over each ticker's candidates, a sweep is the same
chain with one row per grid point. CTE names start with ``t_`` or ``s_`` so that a chain can be repeated
under a suffix.
"""

from __future__ import annotations

import re

from . import oracle as O

_NZ = "(CASE WHEN {c} IS NULL OR isnan({c}) THEN {d} ELSE {c} END)"


def _nz(c: str, default: float) -> str:
    return _NZ.format(c=f"CAST({c} AS DOUBLE)", d=f"CAST({default} AS DOUBLE)")


def _composite() -> str:
    quality = (f"(0.4 * least(abs({_nz('window_sentiment', 0)}) * 2, 1.0) + 0.4 * least(abs({_nz('z_score', 0)}) / 3.0, 1.0) "
               f"+ 0.2 * least({_nz('window_mentions', 5)} / 20.0, 1.0))")
    entry = f"greatest(0.0, 1.0 - ((abs({_nz('pct_3d_z', 0)}) + abs({_nz('ret_z', 0)}) + abs({_nz('vol_z', 0)})) / 3) / 2.0)"
    v, a = _nz("vol_expansion", 1), f"abs({_nz('atr_move', 0)})"
    calm = f"(CASE WHEN {v} < 1.0 THEN {v} WHEN {v} <= 1.75 THEN 1.0 ELSE greatest(0.0, 1.0 - ({v} - 1.75) / 2) END)"
    move = f"(CASE WHEN {a} < 2.0 THEN least({a} / 1.5, 1.0) ELSE greatest(0.0, 1.0 - ({a} - 2.0) / 2) END)"
    strength = f"least(abs({_nz('signal_score', 0)}) / 3.0, 1.0)"
    return f"(0.35 * {quality} + 0.25 * {strength} + 0.20 * {entry} + 0.20 * (0.5 * {calm} + 0.5 * {move}))"


def _ret(price: str) -> str:
    return f"(CASE WHEN dir = 1 THEN ({price} - entry_price) / entry_price ELSE (entry_price - {price}) / entry_price END)"


#: Needs ``bars`` and ``t_in`` (signals with pid, stop_loss, take_profit, max_holding_days, max_position, long_only, sizing).
TRADES = [
    "t_range AS (SELECT min(date) AS lo, max(date) AS hi FROM bars)",
    """t_able AS (SELECT * FROM (
        SELECT *, CASE WHEN signal_type = 'BUY' OR signal_direction = 1 THEN 1
                       WHEN signal_type = 'SELL' OR signal_direction = -1 THEN -1 END AS dir
        FROM t_in, t_range WHERE isodow(signal_date) < 6 AND signal_date BETWEEN lo AND hi)
      WHERE dir IS NOT NULL AND (NOT long_only OR dir = 1))""",
    """t_entry AS (SELECT t.*, b.date AS entry_date, b.open AS entry_price
                    FROM t_able t ASOF JOIN bars b ON t.ticker = b.ticker AND t.signal_date < b.date)""",
    f"""t_hit AS (SELECT e.pid, e.ticker, e.signal_date, min(b.date) AS hit_date, arg_min(b.close, b.date) AS hit_close
                  FROM t_entry e JOIN bars b ON b.ticker = e.ticker AND b.date >= e.entry_date AND isodow(b.date) < 6
                   AND ({_ret('b.close')} <= -stop_loss OR {_ret('b.close')} >= take_profit
                        OR b.date - e.entry_date >= max_holding_days)
                  GROUP BY ALL)""",
    "t_last AS (SELECT ticker, max(date) AS last_date, arg_max(close, date) AS last_close FROM bars GROUP BY ticker)",
    f"""t_exit AS (SELECT e.*, coalesce(hit_date, last_date) AS exit_date, coalesce(hit_close, last_close) AS exit_price,
                          hit_date IS NULL AS open_end
                   FROM t_entry e LEFT JOIN t_hit h USING (pid, ticker, signal_date) JOIN t_last l USING (ticker))""",
    f"""t_cand AS MATERIALIZED (SELECT *, {_ret('exit_price')} AS ret,
          CASE WHEN open_end THEN 'end_of_period' WHEN {_ret('exit_price')} <= -stop_loss THEN 'stop_loss'
               WHEN {_ret('exit_price')} >= take_profit THEN 'take_profit' ELSE 'max_holding' END AS exit_reason,
          row_number() OVER (PARTITION BY pid, ticker ORDER BY signal_date, signal_type) AS rn
        FROM t_exit)""",
    """t_next AS MATERIALIZED (SELECT a.pid, a.ticker, a.rn, min(b.rn) AS next_rn
        FROM t_cand a JOIN t_cand b ON b.pid = a.pid AND b.ticker = a.ticker AND b.rn > a.rn AND b.signal_date >= a.exit_date
        WHERE NOT a.open_end GROUP BY ALL)""",
    """t_taken AS (SELECT DISTINCT pid, ticker, CAST(1 AS BIGINT) AS rn FROM t_cand
        UNION ALL SELECT n.pid, n.ticker, n.next_rn FROM t_taken k JOIN t_next n USING (pid, ticker, rn))""",
]


def table(composite: bool = True) -> list[str]:
    score = _composite() if composite else "CAST(NULL AS DOUBLE)"
    return [f"""t_table AS MATERIALIZED (SELECT pid, ticker, signal_date, signal_type, entry_date, exit_date,
          CASE WHEN dir = 1 THEN 'long' ELSE 'short' END AS direction, entry_price, exit_price,
          exit_date - entry_date AS days_held, 10000.0 * share AS position_size, score AS signal_score,
          10000.0 * share * ret AS pnl, ret * 100 AS pnl_pct, exit_reason, dir
        FROM (SELECT *, CASE WHEN sizing = 'flat' THEN max_position ELSE least(0.03 + 0.07 * score, max_position) END AS share
              FROM (SELECT c.*, {score} AS score FROM t_cand c JOIN t_taken USING (pid, ticker, rn))))"""]


CURVE = [
    """t_days AS (SELECT date FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM t_range)
                  WHERE isodow(date) < 6)""",
    "t_closed AS (SELECT pid, exit_date AS date, sum(pnl) AS gain FROM t_table WHERE exit_reason <> 'end_of_period' GROUP BY ALL)",
    f"""t_marks AS (SELECT t.pid, d.date, count(*) AS n, sum(coalesce(position_size * {_ret('b.close')}, 0)) AS mark
        FROM t_table t JOIN t_days d ON d.date >= t.entry_date AND (d.date < t.exit_date OR t.exit_reason = 'end_of_period')
        LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = d.date GROUP BY ALL)""",
    """t_curve AS MATERIALIZED (SELECT p.pid, d.date, sum(coalesce(c.gain, 0)) OVER (PARTITION BY p.pid ORDER BY d.date) AS realised_pnl,
          coalesce(m.mark, 0) AS open_pnl, coalesce(m.n, 0) AS n_positions
        FROM t_points p CROSS JOIN t_days d LEFT JOIN t_closed c ON c.pid = p.pid AND c.date = d.date
        LEFT JOIN t_marks m ON m.pid = p.pid AND m.date = d.date)""",
    "t_named AS (SELECT pid AS name, date, 10000.0 + realised_pnl + open_pnl AS portfolio_value FROM t_curve)",
]
BENCH = ["""t_bench AS (SELECT ticker AS name, date, close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) * 10000.0
                        AS portfolio_value FROM bars WHERE ticker IN ('S0', 'S1', 'S2'))""",
         "t_curves AS (SELECT * FROM t_named UNION ALL SELECT * FROM t_bench)"]
STATS = ["""t_steps AS (SELECT *, CASE WHEN before > 0 THEN portfolio_value / before - 1 END AS r, (portfolio_value - top) / top AS fall
            FROM (SELECT *, lag(portfolio_value) OVER w AS before, max(portfolio_value) OVER w AS top
                  FROM t_curves WINDOW w AS (PARTITION BY name ORDER BY date)))""",
         """t_sum AS (SELECT name, arg_max(portfolio_value, date) AS last, count(*) AS n_days, avg(r) AS m, stddev_samp(r) AS s,
              stddev_samp(r) FILTER (WHERE r < -1e-12) AS ds, coalesce(min(fall), 0) AS mdd FROM t_steps GROUP BY name)""",
         """t_perf AS (SELECT name, (last / 10000.0 - 1) * 100 AS total_return,
              CASE WHEN last > 0 THEN (pow(last / 10000.0, 252.0 / n_days) - 1) * 100 ELSE -100.0 END AS annualized_return,
              s * sqrt(252.0) * 100 AS volatility, CASE WHEN s > 0 THEN m / s * sqrt(252.0) ELSE 0.0 END AS sharpe,
              CASE WHEN ds > 0 THEN m / ds * sqrt(252.0) ELSE 0.0 END AS sortino,
              CASE WHEN ds > 0 THEN m / ds ELSE 0.0 END AS sortino_reference, mdd * 100 AS max_drawdown, last AS final_value, n_days
            FROM t_sum)"""]

PERF_DOUBLES = ["total_return", "annualized_return", "volatility", "sharpe", "sortino", "sortino_reference", "max_drawdown", "final_value"]
TRADE_DOUBLES = ["entry_price", "exit_price", "position_size", "signal_score", "pnl", "pnl_pct"]


def recursive(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def backtest(body: str, *more: str, long_only: bool = False, curve: bool = False) -> str:
    """The single backtest of the filtered signals with the default parameters."""
    point = (f"t_points AS (SELECT 'strategy' AS pid, 0.07 AS stop_loss, 0.10 AS take_profit, 5 AS max_holding_days, "
             f"0.10 AS max_position, {str(long_only).lower()} AS long_only, 'composite' AS sizing)")
    chain = [*O.filtered_chain(), point, "t_in AS (SELECT * FROM filtered, t_points)", *TRADES, *table()]
    return recursive([*chain, *(CURVE if curve else []), *more], body)


# ---------------------------------------------------------------- sweep

def suffixed(ctes: list[str], suffix: str) -> list[str]:
    names = [re.match(r"\s*(\w+) AS", c)[1] for c in ctes]
    pattern = re.compile(r"\b(" + "|".join(names) + r")\b")
    return [pattern.sub(lambda m: m[1] + suffix, c) for c in ctes]


def windows(lengths: list[tuple[int, int]]) -> list[str]:
    """``s_base``: shock windows for each (window_days, baseline_days)."""
    out, parts = [], []
    for w, b in lengths:
        own = [c for c in O.shock_ctes(window_days=w, baseline_days=b) if re.match(r"\s*(span|cal|filled|win|win2|base) AS", c)]
        own = [re.sub(r"\b(span|cal|filled|win|win2|base)\b(?=( AS \(|\n| c\b| d\b|\s*$|\)| GROUP|$))", rf"s_\1_{w}_{b}", c) for c in own]
        out += own
        parts.append(f"SELECT *, {w} AS window_days, {b} AS baseline_days FROM s_base_{w}_{b}")
    return [*out, "s_base AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"]


POINT_COLUMNS = ("pid, min_mentions, base_z_threshold, z_threshold, stop_loss, take_profit, max_holding_days, window_days, baseline_days, "
                 "bullish_bias, long_only, max_position, sizing, vol_expansion_threshold, atr_move_threshold")


def values(points: list[dict]) -> str:
    """``t_points`` from dicts over the reference's sweep defaults."""
    base = {"min_mentions": 5, "base_z_threshold": 2.0, "z_threshold": 2.0, "stop_loss": 0.07, "take_profit": 0.10, "max_holding_days": 7,
            "window_days": 3, "baseline_days": 30, "bullish_bias": 0.0, "long_only": False, "max_position": 0.10, "sizing": "'flat'",
            "vol_expansion_threshold": 1.75, "atr_move_threshold": 2.0}
    rows = []
    for k, point in enumerate(points):
        full = base | point
        rows.append("(" + ", ".join([f"'p{k:05d}'", *(str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) or c in (
            "min_mentions", "window_days", "baseline_days") else str(v) for c, v in full.items())]) + ")")
    return f"t_points AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v({POINT_COLUMNS}))"


#: Needs daily, bars, m4 (market metrics), s_base and t_points.
SWEEP = [
    """s_sig AS (SELECT p.*, b.date AS signal_date, b.ticker, b.signal_type, b.signal_direction, z AS z_score
        FROM (SELECT *, CASE WHEN ok AND z >= thr - bullish_bias AND window_sentiment > 0 THEN 'BUY'
                             WHEN ok AND z <= -(thr + bullish_bias) AND window_sentiment < 0 THEN 'SELL' END AS signal_type,
                        CASE WHEN window_sentiment > 0 THEN 1 ELSE -1 END AS signal_direction
              FROM (SELECT x.*, q.pid, q.bullish_bias, (window_sentiment - baseline_mean) / nullif(baseline_std, 0) AS z,
                           q.base_z_threshold / (1 + 0.2 * ln(1 + greatest(window_mentions, 1.0))) AS thr,
                           baseline_std > 0 AND window_sentiment IS NOT NULL AND window_mentions >= q.min_mentions
                             AND abs(window_sentiment - baseline_mean) >= 0.1 AS ok
                    FROM s_base x JOIN t_points q ON q.window_days = x.window_days AND q.baseline_days = x.baseline_days)) b
        JOIN t_points p ON p.pid = b.pid WHERE b.signal_type IS NOT NULL)""",
    """s_moved AS (SELECT ticker, date, bar_n, z_threshold, vol_expansion_threshold, atr_move_threshold,
                       max(hit) OVER (PARTITION BY z_threshold, vol_expansion_threshold, atr_move_threshold, ticker ORDER BY date
                                      ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS moved
        FROM (SELECT m.*, d.*, CASE WHEN abs(pct_3d_z) >= z_threshold OR abs(ret_z) >= z_threshold OR abs(vol_z) >= z_threshold
                                               OR vol_expansion >= vol_expansion_threshold OR atr_move >= atr_move_threshold THEN 1 ELSE 0 END AS hit
              FROM m4 m CROSS JOIN (SELECT DISTINCT z_threshold, vol_expansion_threshold, atr_move_threshold FROM t_points) d))""",
    """t_in AS MATERIALIZED (SELECT s.* FROM s_sig s JOIN s_moved m ON m.ticker = s.ticker AND m.date = s.signal_date
                              AND m.z_threshold = s.z_threshold AND m.vol_expansion_threshold = s.vol_expansion_threshold
                              AND m.atr_move_threshold = s.atr_move_threshold WHERE m.bar_n >= 20 AND m.moved = 0)""",
    *TRADES, *table(composite=False), *CURVE, "t_curves AS (SELECT * FROM t_named)", *STATS,
    """s_board AS MATERIALIZED (SELECT p.pid AS point_id, CAST(min_mentions AS DOUBLE) AS min_mentions,
          CAST(base_z_threshold AS DOUBLE) AS base_z_threshold, CAST(z_threshold AS DOUBLE) AS z_threshold,
          CAST(stop_loss AS DOUBLE) AS stop_loss, CAST(take_profit AS DOUBLE) AS take_profit,
          CAST(max_holding_days AS INTEGER) AS max_holding_days, CAST(window_days AS DOUBLE) AS window_days,
          CAST(baseline_days AS DOUBLE) AS baseline_days, CAST(bullish_bias AS DOUBLE) AS bullish_bias, long_only,
          CAST(max_position AS DOUBLE) AS max_position, total_return, final_value, coalesce(n, 0) AS n_trades,
          coalesce(buys, 0) AS n_buy_signals, coalesce(sells, 0) AS n_sell_signals,
          CASE WHEN n > 0 THEN wins / n * 100 ELSE 0.0 END AS win_rate, CASE WHEN n > 0 THEN sharpe ELSE 0.0 END AS sharpe,
          CASE WHEN n > 0 THEN max_drawdown ELSE 0.0 END AS max_drawdown
        FROM t_points p LEFT JOIN t_perf f ON f.name = p.pid
        LEFT JOIN (SELECT pid, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins FROM t_table GROUP BY pid) t ON t.pid = p.pid
        LEFT JOIN (SELECT pid, count(*) FILTER (WHERE signal_type = 'BUY') AS buys, count(*) FILTER (WHERE signal_type = 'SELL') AS sells
                   FROM t_in GROUP BY pid) g ON g.pid = p.pid)""",
]
BOARD_DOUBLES = ["total_return", "final_value", "win_rate", "sharpe", "max_drawdown"]


def _inputs(lengths: list[tuple[int, int]]) -> list[str]:
    return [O.F2_SENTIMENT_RESULTS, O.DAILY_WEIGHTED, O.F3_PRICE_BARS.replace("bars AS (", "bars AS MATERIALIZED ("),
            *O.market_ctes()[:-1], *windows(lengths)]


def sweep(points: list[dict], body: str, *more: str) -> str:
    lengths = sorted({(p.get("window_days", 3), p.get("baseline_days", 30)) for p in points})
    return recursive([*_inputs(lengths), values(points), *SWEEP, *more], body)


def two_phases(first: list[dict], second: list[dict], body: str) -> str:
    """``s_board_b`` of the second phase: the exit grid on the best point of the first by Sharpe."""
    best = "s_best AS (SELECT * FROM s_board ORDER BY sharpe DESC, point_id LIMIT 1)"
    grid = values(second).replace("t_points AS (SELECT * FROM", "s_grid AS (SELECT * FROM")
    points = """t_points AS (SELECT g.* REPLACE (b.min_mentions AS min_mentions, b.base_z_threshold AS base_z_threshold,
                                                b.z_threshold AS z_threshold) FROM s_grid g, s_best b)"""
    return recursive([*_inputs([(3, 30)]), values(first), *SWEEP, best, grid, *suffixed([points, *SWEEP], "_b")], body)


# ---------------------------------------------------------------- charting window
def charting() -> str:
    numbered = [
        "t_num AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars)",
        """t_anchor AS (SELECT DISTINCT f.ticker, CAST(f.target_date AS DATE) AS target_date, b.n
                        FROM filtered f JOIN t_num b ON b.ticker = f.ticker AND b.date = CAST(f.target_date AS DATE))""",
        """t_slice AS (SELECT a.ticker || '|' || CAST(a.target_date AS VARCHAR) AS ticker, a.ticker AS symbol, a.target_date, b.date,
                              b.open, b.high, b.low, b.close, b.volume
                       FROM t_anchor a JOIN t_num b ON b.ticker = a.ticker AND b.n BETWEEN a.n - 39 AND a.n)"""]
    own = [re.sub(r"\b(m[1-4]|mkt)\b(?= AS \(|\b)", r"\1_c", c).replace("FROM bars", "FROM t_slice") for c in O.market_ctes()[:-1]]
    body = """SELECT symbol AS ticker, target_date, date, bar_n, pct_3d_z, ret_z, vol_z, vol_expansion, atr_move, is_recent,
        is_recent AND abs(pct_3d_z) >= 2.0 AS trig_pct_3d_z, is_recent AND abs(ret_z) >= 2.0 AS trig_ret_z,
        is_recent AND abs(vol_z) >= 2.0 AS trig_vol_z, is_recent AND vol_expansion >= 1.75 AS trig_vol_expansion,
        is_recent AND atr_move >= 2.0 AS trig_atr_move
      FROM (SELECT *, bar_n > max(bar_n) OVER (PARTITION BY ticker) - 5 AS is_recent FROM m4_c)"""
    return O.rounded(O.with_ctes(*O.filtered_chain(), *numbered, *own, body=body),
                     ["pct_3d_z", "ret_z", "vol_z", "vol_expansion", "atr_move"])
