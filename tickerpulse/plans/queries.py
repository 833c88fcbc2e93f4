"""The registered queries: one per inventory id (or small group of ids).

Every query reads the test tables under ``sf_dir`` through the fixture
builders, runs the library's operators over the whole tables and returns a
DataFrame whose column names equal the oracle SQL's.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import daily as daily_ops
from ..functions import text as tx
from ..functions import scores as sc
from ..operators import clean, gates, market, metrics, profile, report, scoring, sweep, tickers, trades
from ..operators import shock
from ..sources import fixtures as fx
from . import oracle as O
from . import oracle_text as OX
from . import oracle_trades as OT
from . import pipelines
from .registry import register
from ..session import materialize, scratch_path
from ..sources import readers, sinks, versions

# ------------------------------------------------------------------ flagship


@register("shock_signals", O.rounded(O.with_ctes(O.F2_SENTIMENT_RESULTS, O.DAILY_WEIGHTED,
                                                 *O.shock_ctes(), body="SELECT * FROM signals"),
                                     O.SIGNAL_DOUBLES))
def q_shock_signals(spark, sf_dir):
    """A2 -> J4 -> W2 -> W3 -> W4 -> M1 -> M2 on F2: the sentiment_signals table."""
    return shock.shock_signals(fx.sentiment_results(spark, sf_dir))


def _filtered(spark, sf_dir):
    sig = shock.shock_signals(fx.sentiment_results(spark, sf_dir))
    return gates.apply_quality_gates(market.filter_unmoved(sig, fx.price_bars(spark, sf_dir)))


_A1_SQL = O.with_ctes(O.F2_SENTIMENT_RESULTS, body=f"""
SELECT ticker, {O.EPOCH_DAY} AS sentiment_date,
       avg(final_sentiment_score) AS sentiment_mean,
       median(final_sentiment_score) AS sentiment_median,
       CASE WHEN count(final_sentiment_score) = 1 THEN 0.0 ELSE stddev_samp(final_sentiment_score) END
         AS sentiment_std,
       count(*) AS mentions,
       sum(normalized_upvotes) AS total_upvotes,
       avg(normalized_upvotes) AS avg_upvotes,
       sum(final_sentiment_score * normalized_upvotes) / nullif(sum(normalized_upvotes), 0)
         AS weighted_sentiment,
       count(*) FILTER (WHERE final_sentiment_label = 'positive') AS positive_count,
       count(*) FILTER (WHERE final_sentiment_label = 'neutral') AS neutral_count,
       count(*) FILTER (WHERE final_sentiment_label = 'negative') AS negative_count
FROM sentiment_results GROUP BY 1, 2""")


@register("daily_sentiment", O.rounded(_A1_SQL, ["sentiment_mean", "sentiment_median", "sentiment_std",
                                                "total_upvotes", "avg_upvotes", "weighted_sentiment"]))
def q_daily_sentiment(spark, sf_dir):
    """A1: canonical sentiment_daily table (AVG, MEDIAN, STDDEV(1 row = 0), counts) on F2."""
    return daily_ops.daily_sentiment_sql(fx.sentiment_results(spark, sf_dir))


@register("daily_weighted_sparse", O.rounded(O.with_ctes(O.F4_SPARSE_MENTIONS, O.DAILY_WEIGHTED,
                                                         body="SELECT * FROM daily"),
                                             ["sentiment_mean", "total_upvotes", "sentiment_median"]))
def q_daily_weighted_sparse(spark, sf_dir):
    """A2 on the sparse F4 stream: weighted mean, zero-upvote days fall back to the median."""
    return daily_ops.daily_sentiment_weighted(fx.sparse_mentions(spark, sf_dir))


@register("shock_signals_sparse", O.rounded(O.with_ctes(O.F4_SPARSE_MENTIONS, O.DAILY_WEIGHTED,
                                                        *O.shock_ctes(), body="SELECT * FROM signals"),
                                            O.SIGNAL_DOUBLES))
def q_shock_signals_sparse(spark, sf_dir):
    """Flagship rule on the sparse F4 stream (gap days exercise the calendar fill)."""
    return shock.shock_signals(fx.sparse_mentions(spark, sf_dir))


_MKT_OUT = ["returns", "pct_change_3d", "pct_3d_z", "ret_z", "vol_z", "vol_expansion", "atr_14", "atr_move", "tr"]


@register("market_metrics", O.rounded(O.with_ctes(O.F3_PRICE_BARS, *O.market_ctes(), body=f"""
SELECT ticker, date, bar_n, {', '.join(_MKT_OUT)}, market_moved_flag FROM mkt"""), _MKT_OUT))
def q_market_metrics(spark, sf_dir):
    """W7-W14 on every F3 bar: returns, 3-bar change and z, return z, volume z,
    volatility expansion, true range, ATR-14, ATR move, moved-in-last-5 flag."""
    st = market.market_state(fx.price_bars(spark, sf_dir))
    return st.select("ticker", "date", F.col("bar_n").cast("bigint").alias("bar_n"), *_MKT_OUT,
                     F.col("market_moved_flag").cast("int").alias("market_moved_flag"))


@register("filtered_signals", O.rounded(O.with_ctes(
        O.F2_SENTIMENT_RESULTS, O.DAILY_WEIGHTED, *O.shock_ctes(), O.F3_PRICE_BARS, *O.market_ctes(),
        O.FILTERED_CTE, body="SELECT * FROM filtered"), O.SIGNAL_DOUBLES))
def q_filtered_signals(spark, sf_dir):
    """D4 + J5 + P11 + P12: signals whose market had not moved, after the five quality gates."""
    return _filtered(spark, sf_dir)


@register("gate_counts", O.with_ctes(
        O.F2_SENTIMENT_RESULTS, O.DAILY_WEIGHTED, *O.shock_ctes(), O.F3_PRICE_BARS, *O.market_ctes(), f"""
unmoved AS (SELECT s.* FROM signals s JOIN mkt m ON m.ticker = s.ticker AND m.date = {O.TRADING_DAY}
            WHERE m.bar_n >= 20 AND m.market_moved_flag = 0)""", """
tagged AS (SELECT *, CASE WHEN signal_date IS NULL THEN 'gate1_signal_date'
                          WHEN NOT coalesce(window_mentions >= 5, false) THEN 'gate2_window_mentions'
                          WHEN z_score IS NULL OR NOT isfinite(z_score) THEN 'gate3_z_score'
                          WHEN NOT coalesce(signal_type IN ('BUY', 'SELL'), false) THEN 'gate4_signal_type'
                     END AS g FROM unmoved)""", """
counted AS (SELECT coalesce(g, 'gate5_duplicates') AS gate,
                   CASE WHEN g IS NULL THEN count(*) - 1 ELSE count(*) END AS n
            FROM tagged GROUP BY g, ticker, signal_date, signal_type)""", """
spine AS (SELECT unnest(['gate1_signal_date', 'gate2_window_mentions', 'gate3_z_score',
                         'gate4_signal_type', 'gate5_duplicates']) AS gate)""",
        body="""SELECT s.gate, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS removed
                FROM spine s LEFT JOIN counted c ON c.gate = s.gate GROUP BY s.gate"""))
def q_gate_counts(spark, sf_dir):
    """Rows removed by each of the five gates, from one grouped pass."""
    sig = shock.shock_signals(fx.sentiment_results(spark, sf_dir))
    unmoved = market.filter_unmoved(sig, fx.price_bars(spark, sf_dir))
    return gates.gate_report(unmoved)


@register("zscore_check", O.with_ctes(
        O.F2_SENTIMENT_RESULTS, O.DAILY_WEIGHTED, *O.shock_ctes(), O.F3_PRICE_BARS, *O.market_ctes(),
        O.FILTERED_CTE, body="""
SELECT CASE WHEN window_sentiment IS NULL OR baseline_mean IS NULL OR baseline_std IS NULL
                 OR baseline_std <= 0 OR z_score IS NULL THEN 'not_checkable'
            WHEN abs(z_score - (window_sentiment - baseline_mean) / baseline_std) > 0.01 THEN 'mismatch'
            ELSE 'ok' END AS z_status,
       count(*) AS n
FROM filtered GROUP BY 1"""))
def q_zscore_check(spark, sf_dir):
    """Recomputed z vs stored z on the filtered signals (tolerance 0.01), counted by status."""
    return gates.zscore_consistency(_filtered(spark, sf_dir)).groupBy("z_status").agg(
        F.count(F.lit(1)).alias("n"))


@register("null_audit", O.with_ctes(
        O.F2_SENTIMENT_RESULTS, O.DAILY_WEIGHTED, *O.shock_ctes(), O.F3_PRICE_BARS, *O.market_ctes(),
        O.FILTERED_CTE, body="""
SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE window_sentiment IS NULL) AS null_window_sentiment,
       count(*) FILTER (WHERE z_score IS NULL) AS null_z_score,
       count(*) FILTER (WHERE baseline_mean IS NULL) AS null_baseline_mean
FROM filtered"""))
def q_null_audit(spark, sf_dir):
    """NULL counts of window_sentiment, z_score, baseline_mean on the filtered signals."""
    return gates.null_metric_audit(_filtered(spark, sf_dir))


# --------------------------------------------------------- preprocessing (F1)

def _f1_clean(spark, sf_dir):
    u = clean.harmonize(clean.scan_posts(fx.raw_posts(spark, sf_dir)),
                        clean.scan_comments(fx.raw_comments(spark, sf_dir)))
    u = clean.merge_title(clean.blank_and_drop_placeholders(u))
    u = clean.dedupe_by_id(clean.drop_invalid_texts(clean.coerce_types(u)))
    u = clean.add_features(clean.drop_columns(u))
    return clean.minmax_by_group(u, "score", "subreddit", "normalized_upvotes")


def _f1_tickers(spark, sf_dir):
    u = tickers.detect_tickers(_f1_clean(spark, sf_dir), fx.ticker_dim(spark), fx.ticker_stoplist(spark))
    return tickers.inherit_parent_tickers(u.withColumn("own_tickers", F.col("mentioned_tickers")))


_F1_CLEAN_OUT = f"""
SELECT id, type, subreddit, created_utc, text, CAST(length(text) AS INTEGER) AS text_length,
       CAST(len(list_filter(regexp_split_to_array(text, '{O.WS_RE}'), lambda x: x <> '')) AS INTEGER) AS word_count,
       CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(month(ts) AS INTEGER) AS month, isodow(ts) >= 6 AS is_weekend, normalized_upvotes
FROM clean"""


@register("preprocess_clean", O.rounded(O.with_ctes(O.F1_RAW, O.F1_CLEAN, body=_F1_CLEAN_OUT),
                                        ["normalized_upvotes"]))
def q_preprocess_clean(spark, sf_dir):
    """S1/S2 + P1/U1 + P4 + X1 + P7 + P5 + P6 + P8 + D2/D3 + X8 + W1 on F1 posts and comments."""
    u = _f1_clean(spark, sf_dir)
    return u.select("id", "type", "subreddit", F.unix_timestamp("created_utc").alias("created_utc"), "text",
                    "text_length", "word_count", "date", "hour",
                    F.weekday("created_utc").alias("day_of_week"), "month", "is_weekend", "normalized_upvotes")


@register("mention_tickers", O.with_ctes(O.F1_RAW, O.F1_CLEAN, O.f1_tickers_sql(), body="""
SELECT id, type, array_to_string(own_tickers, ',') AS own_tickers,
       array_to_string(mentioned_tickers, ',') AS mentioned_tickers,
       CAST(len(mentioned_tickers) AS INTEGER) AS n_tickers
FROM inherited"""))
def q_mention_tickers(spark, sf_dir):
    """X2-X5 + J1 + J2 + J3 + U3: detected symbols, stop-list removal, inheritance from the parent post."""
    u = _f1_tickers(spark, sf_dir)
    return u.select("id", "type", tx.ticker_csv("own_tickers").alias("own_tickers"),
                    tx.ticker_csv("mentioned_tickers").alias("mentioned_tickers"), "n_tickers")


@register("placeholder_report", O.with_ctes(O.F1_RAW, body=f"""
SELECT type, count(*) AS rows,
       count(*) FILTER (WHERE (type = 'post' AND coalesce(lower({O.strip('title')})
                                                      IN ('', '[deleted]', '[removed]', 'nan'), true)
                               AND coalesce(lower({O.strip('body')})
                                            IN ('', '[deleted]', '[removed]', 'nan'), true))
                           OR (type = 'comment' AND coalesce(lower({O.strip('body')})
                                                            IN ('', '[deleted]', '[removed]', 'nan'), true)))
         AS placeholder_only
FROM raw GROUP BY type"""))
def q_placeholder_report(spark, sf_dir):
    """P2 + P3: placeholder-only rows by type on the harmonised F1 input."""
    u = clean.harmonize(clean.scan_posts(fx.raw_posts(spark, sf_dir)),
                        clean.scan_comments(fx.raw_comments(spark, sf_dir)))
    return clean.placeholder_report(u)


@register("preprocessed_mentions", OX.preprocessed("date"))
def q_preprocessed_mentions(spark, sf_dir):
    """Full preprocessing (all steps above + X6 normalisation + P9 + R5 + D3) -> preprocessed_data."""
    pp = pipelines.preprocess(fx.raw_posts(spark, sf_dir), fx.raw_comments(spark, sf_dir),
                              fx.ticker_dim(spark), fx.ticker_stoplist(spark))
    return pipelines.preprocessed_table(pp)


@register("document_tickers", O.with_ctes(
        "clean AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents)",
        O.f1_tickers_sql().split("detected AS")[0].rstrip().rstrip(","), body="""
SELECT c.id, coalesce(array_to_string(o.t, ','), '') AS mentioned_tickers,
       CAST(coalesce(len(o.t), 0) AS INTEGER) AS n_tickers
FROM clean c LEFT JOIN own o USING (id)"""))
def q_document_tickers(spark, sf_dir):
    """X5 + J1 + J2 over the whole text of every ``documents`` row (scale variant of F1)."""
    d = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    out = tickers.detect_tickers(d, fx.ticker_dim(spark), fx.ticker_stoplist(spark))
    return out.select("id", tx.ticker_csv("mentioned_tickers").alias("mentioned_tickers"), "n_tickers")


# ------------------------------------------------------------- scoring

def _f5_scored(spark, sf_dir):
    df = fx.class_probabilities(spark, sf_dir)
    return scoring.with_model_scores(df, "m0_p_neg", "m0_p_neu", "m0_p_pos", prefix="tw_")


def _m5_sql(j):
    n, u, p = f"m{j}_p_neg", f"m{j}_p_neu", f"m{j}_p_pos"
    best = f"greatest({n}, {u}, {p})"
    return f"(CASE WHEN {n} = {best} THEN 'negative' WHEN {u} = {best} THEN 'neutral' ELSE 'positive' END)"


_ENS = [O.m4(j)["score"] for j in range(4)]


def _fold_sum(terms):
    acc = "0.0"
    for t in terms:
        acc = f"({acc} + {t})"
    return acc


_ENS_MEAN = f"({_fold_sum(_ENS)} / 4)"
_ENS_VAR = f"({_fold_sum(f'({x} - {_ENS_MEAN}) * ({x} - {_ENS_MEAN})' for x in _ENS)} / 3)"
_M4 = O.m4(0)


@register("class_scores", O.rounded(O.with_ctes(O.f5_cte(), body=f"""
SELECT vec_id, {_M4['score']} AS tw_score, {_M4['label']} AS tw_label, {_M4['confidence']} AS tw_confidence,
       {', '.join(f"{_m5_sql(j)} AS m{j}_label" for j in range(4))},
       {_ENS_MEAN} AS ens_mean, {_ENS_VAR} AS ens_variance, sqrt({_ENS_VAR}) AS ens_std,
       CASE WHEN {_M4['confidence']} < 0.5 THEN 'drop' WHEN {_M4['confidence']} < 0.65 THEN 'second'
            ELSE 'keep' END AS route,
       CASE WHEN {_M4['confidence']} < 0.5 THEN 'second' ELSE 'keep' END AS route_no_drop
FROM f5"""), ["tw_score", "tw_confidence", "ens_mean", "ens_variance", "ens_std"]))
def q_class_scores(spark, sf_dir):
    """M4 (score/label/confidence), M5 (first-max label per model), M6 (ensemble mean/var/std), P10 route."""
    df = _f5_scored(spark, sf_dir)
    ens = sc.ensemble_stats([F.col(f"m{j}_p_pos") - F.col(f"m{j}_p_neg") for j in range(4)])
    labels = [sc.label_first_max([("negative", f"m{j}_p_neg"), ("neutral", f"m{j}_p_neu"),
                                  ("positive", f"m{j}_p_pos")]).alias(f"m{j}_label") for j in range(4)]
    return df.select("vec_id", "tw_score", "tw_label", "tw_confidence", *labels,
                     ens["mean"].alias("ens_mean"), ens["variance"].alias("ens_variance"),
                     ens["std"].alias("ens_std"),
                     sc.route_by_confidence("tw_confidence").alias("route"),
                     sc.route_by_confidence("tw_confidence", None, 0.5).alias("route_no_drop"))


_K1 = O.k1()
_K1C = O.k1(clamp=True)


@register("model_response_parse", O.rounded(O.with_ctes(O.f5_cte(), body=f"""
SELECT vec_id, {_K1['label']} AS label, {_K1['score']} AS score, {_K1['route']} AS route,
       {_K1C['label']} AS label_clamped, {_K1C['score']} AS score_clamped
FROM f5"""), ["score", "score_clamped"]))
def q_model_response_parse(spark, sf_dir):
    """K1: JSON-or-regex parse of generative answers, both variants (plain and clamped)."""
    df = fx.class_probabilities(spark, sf_dir)
    a, b = sc.parse_model_response("response"), sc.parse_model_response("response", clamp=True)
    return df.select("vec_id", a["label"].alias("label"), a["score"].alias("score"), a["route"].alias("route"),
                     b["label"].alias("label_clamped"), b["score"].alias("score_clamped"))


@register("hybrid_sentiment", O.rounded(O.with_ctes(O.f5_cte(), body=f"""
SELECT vec_id, ticker, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) + vec_id AS created_utc,
       CASE WHEN {_M4['confidence']} < 0.65 THEN {_K1['score']} ELSE {_M4['score']} END AS final_sentiment_score,
       CASE WHEN {_M4['confidence']} < 0.65 THEN {_K1['label']} ELSE {_M4['label']} END AS final_sentiment_label,
       CASE WHEN {_M4['confidence']} < 0.65 THEN 'LLM' ELSE 'RoBERTa' END AS source_model,
       {_M4['confidence']} AS tw_confidence
FROM f5 WHERE {_M4['confidence']} >= 0.5"""), ["final_sentiment_score", "tw_confidence"]))
def q_hybrid_sentiment(spark, sf_dir):
    """P10 + K1 + J9: drop < 0.50, second model for [0.50, 0.65), overwrite by row key, source_model."""
    df = _f5_scored(spark, sf_dir)
    p = sc.parse_model_response("response")
    routed = df.filter(sc.route_by_confidence("tw_confidence") == "second")  # only these are sent to the second model
    second = routed.select(F.col("vec_id").alias("row_id"), p["label"].alias("label"), p["score"].alias("score"))
    out = scoring.hybrid_results(df.withColumnRenamed("vec_id", "row_id"), second, key="row_id")
    return out.select(F.col("row_id").alias("vec_id"), "ticker", "created_utc", "final_sentiment_score",
                      "final_sentiment_label", "source_model", "tw_confidence")


@register("hybrid_source_counts", O.with_ctes(O.f5_cte(), body=f"""
SELECT source_model, label, count(*) AS n FROM (
  SELECT CASE WHEN {_M4['confidence']} < 0.65 THEN 'LLM' ELSE 'RoBERTa' END AS source_model,
         CASE WHEN {_M4['confidence']} < 0.65 THEN {_K1['label']} ELSE {_M4['label']} END AS label
  FROM f5 WHERE {_M4['confidence']} >= 0.5) GROUP BY 1, 2"""))
def q_hybrid_source_counts(spark, sf_dir):
    """Value counts of (source_model, final label) after the hybrid overwrite."""
    return (q_hybrid_sentiment(spark, sf_dir).groupBy("source_model", F.col("final_sentiment_label").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


_SCORER_SQL = O.rounded(O.with_ctes(O.f5_cte(), body=f"""
SELECT vec_id, {_m5_sql(0)} AS m_label, {_M4['score']} AS m_score,
       m0_p_pos AS m_p_pos, m0_p_neu AS m_p_neu, m0_p_neg AS m_p_neg, false AS m_failed
FROM f5"""), ["m_score", "m_p_pos", "m_p_neu", "m_p_neg"])


@register("batch_scorer_hook", _SCORER_SQL)
def q_batch_scorer_hook(spark, sf_dir):
    """the mapInPandas batch hook (64 texts per call) over every embeddings row
    with the stand-in softmax scorer; compared with the same rule in SQL."""
    df = fx.class_probabilities(spark, sf_dir).select("vec_id", F.col("raw_text").alias("model_input"))
    out = scoring.score_batches(df, fx.make_fixture_scorer, "model_input", batch_size=64, prefix="m_")
    return out.select("vec_id", "m_label", "m_score", "m_p_pos", "m_p_neu", "m_p_neg", "m_failed")


@register("memoised_scorer", _SCORER_SQL)
def q_memoised_scorer(spark, sf_dir):
    """F4 + J9: the same scores from a table that keeps each text's result: half of the rows are scored in a first
    run, a second run over all rows scores the texts that are new to it only."""
    df = fx.class_probabilities(spark, sf_dir).select("vec_id", F.col("raw_text").alias("model_input"))
    path = scratch_path(spark, "scores")
    scoring.score_memoised(df.where(F.pmod(F.hash("vec_id"), F.lit(2)) == 0), path, "softmax", fx.make_fixture_scorer)
    out = scoring.score_memoised(df, path, "softmax", fx.make_fixture_scorer)
    return out.select("vec_id", "m_label", "m_score", "m_p_pos", "m_p_neu", "m_p_neg", "m_failed")


@register("exploded_mentions", O.with_ctes(O.F1_RAW, O.F1_CLEAN, O.f1_tickers_sql(), f"""
csv AS (SELECT id, text, array_to_string(mentioned_tickers, ',') AS tickers_csv FROM inherited)""", f"""
lst AS (SELECT id, text, list_filter(list_transform(string_split(regexp_replace(tickers_csv, '[\\[\\]''"]', '', 'g'),
                                                                 ','), lambda x: trim(x)), lambda x: x <> '') AS l
        FROM csv)""", body=f"""
SELECT id, ticker, CAST(len(l) AS INTEGER) AS n_tickers, ticker || ': ' || text AS model_input,
       printf('{scoring.DEFAULT_PROMPT.replace("'", "''").replace('{ticker}', '%s').replace('{text}', '%s')}',
              ticker, text) AS prompt
FROM lst, unnest(l) AS u(ticker)"""))
def q_exploded_mentions(spark, sf_dir):
    """R5 -> R1 -> R2 + R3 -> X9 + X10: CSV ticker list parsed back, one row per
    (mention, ticker), classifier input and prompt (whole text)."""
    u = _f1_tickers(spark, sf_dir).withColumn("tickers_csv", tx.ticker_csv("mentioned_tickers"))
    ex = scoring.explode_tickers(u.select("id", "text", "tickers_csv"), "tickers_csv")
    return ex.select("id", "ticker", F.col("n_tickers").cast("int").alias("n_tickers"),
                     scoring.model_input("ticker", "text").alias("model_input"),
                     scoring.prompt_text("ticker", "text").alias("prompt"))


# ------------------------------------------------------------- trades (T, M)

def _bt_params(bars, **kw):
    """Backtest window = the bars' own date range (scalar subqueries, no driver action)."""
    return trades.BacktestParams(start=bars.agg(F.min("date")).scalar(), end=bars.agg(F.max("date")).scalar(), **kw)


def _stage_inputs(spark, sf_dir):
    """Bars and filtered signals, each checkpointed once: both feed several branches."""
    bars = materialize(fx.price_bars(spark, sf_dir))
    sig = shock.shock_signals(fx.sentiment_results(spark, sf_dir))
    filt = materialize(gates.apply_quality_gates(market.filter_unmoved(sig, bars)))
    return bars, filt


def _trades(spark, sf_dir, **kw):
    bars, filt = _stage_inputs(spark, sf_dir)
    p = _bt_params(bars, **kw)
    return materialize(trades.trade_table(filt, bars, p)), bars, p


_TRADE_COLS = ["ticker", "signal_date", "signal_type", "entry_date", "exit_date", "direction", "entry_price",
               "exit_price", "days_held", "position_size", "signal_score", "pnl", "pnl_pct", "exit_reason"]


@register("candidate_trades", O.rounded(OT.backtest("""
SELECT ticker, signal_date, signal_type, entry_date, entry_price, exit_date, exit_price, exit_reason, ret FROM t_cand"""),
    ["entry_price", "exit_price", "ret"]))
def q_candidate_trades(spark, sf_dir):
    """T1 + T2/J6 + T3/J7 + T4: entry and first-barrier exit of every tradable filtered signal."""
    bars, filt = _stage_inputs(spark, sf_dir)
    c = trades.candidate_trades(filt, bars, _bt_params(bars))
    return c.select("ticker", "signal_date", "signal_type", "entry_date", "entry_price", "exit_date",
                    "exit_price", "exit_reason", "ret")


@register("backtest_trades", O.rounded(OT.backtest("SELECT * EXCLUDE (pid, dir) FROM t_table"), OT.TRADE_DOUBLES))
def q_backtest_trades(spark, sf_dir):
    """T5 + T6 + M10 + M11: accepted trades (one open position per ticker), sized by composite score."""
    t, _, _ = _trades(spark, sf_dir)
    return t.select(*_TRADE_COLS)


@register("equity_curve", O.rounded(OT.backtest("""
SELECT date, 10000.0 + realised_pnl + open_pnl AS portfolio_value, realised_pnl, open_pnl, n_positions FROM t_curve""", curve=True),
    ["portfolio_value", "realised_pnl", "open_pnl"]))
def q_equity_curve(spark, sf_dir):
    """T7 + J8 + D5: daily portfolio value over the business-day calendar."""
    t, bars, p = _trades(spark, sf_dir)
    return trades.equity_curve(t, bars, p)


@register("performance_report", O.rounded(OT.backtest("SELECT * FROM t_perf", *OT.BENCH, *OT.STATS, curve=True), OT.PERF_DOUBLES))
def q_performance_report(spark, sf_dir):
    """T8 + M12 + W16 + W17: metrics of the strategy curve and the three benchmark curves."""
    t, bars, p = _trades(spark, sf_dir)
    curve = trades.equity_curve(t, bars, p).select(F.lit("strategy").alias("name"), "date", "portfolio_value")
    # the benchmark symbols' bars come from the already checkpointed bar table
    bench_bars = bars.filter(F.col("ticker").isin(*fx.BENCHMARK_SYMBOLS))
    bench = metrics.benchmark_curves(bench_bars, p.capital, p.start, p.end)
    return metrics.performance(curve.unionByName(bench), p.capital)


@register("benchmark_comparison", O.rounded(OT.backtest("""
SELECT b.name AS benchmark, s.total_return AS strategy_return, b.total_return AS benchmark_return,
       s.total_return - b.total_return AS difference,
       CASE WHEN s.total_return > b.total_return THEN 'outperformed' ELSE 'underperformed' END AS status
FROM t_perf b, t_perf s WHERE s.name = 'strategy' AND b.name <> 'strategy'""", *OT.BENCH, *OT.STATS, curve=True),
    ["strategy_return", "benchmark_return", "difference"]))
def q_benchmark_comparison(spark, sf_dir):
    """J12 + O5: strategy vs each benchmark (difference, status)."""
    return metrics.compare_to_benchmarks(q_performance_report(spark, sf_dir))


@register("best_performers", OT.backtest("""
SELECT arg_max(name, total_return) AS best_return, arg_max(name, sharpe) AS best_sharpe, arg_max(name, max_drawdown) AS best_drawdown
FROM t_perf""", *OT.BENCH, *OT.STATS, curve=True))
def q_best_performers(spark, sf_dir):
    """Best curve by total return, Sharpe and drawdown."""
    return metrics.best_by(q_performance_report(spark, sf_dir))


@register("trade_statistics", O.rounded(OT.backtest("""
SELECT count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses,
       count(*) FILTER (WHERE pnl > 0) / count(*) * 100 AS win_rate, count(*) FILTER (WHERE pnl < 0) / count(*) * 100 AS loss_rate,
       avg(pnl) AS avg_pnl, avg(pnl) FILTER (WHERE pnl > 0) AS avg_win, avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss,
       sum(pnl) AS total_pnl, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / coalesce(abs(sum(pnl) FILTER (WHERE pnl < 0)), 1.0) AS profit_factor,
       corr(signal_score, pnl_pct) AS correlation, regr_slope(pnl_pct, signal_score) AS slope,
       regr_intercept(pnl_pct, signal_score) AS intercept FROM t_table"""),
    ["win_rate", "loss_rate", "avg_pnl", "avg_win", "avg_loss", "total_pnl", "profit_factor", "correlation", "slope", "intercept"]))
def q_trade_statistics(spark, sf_dir):
    """A6 + A7 + M8 + M9: trade counts, rates, means, total, profit factor, score-vs-return fit."""
    t, _, _ = _trades(spark, sf_dir)
    st = metrics.trade_stats(t)
    rel = metrics.score_relationship(t)
    return st.select("*", *[rel.select(c).scalar().alias(c) for c in rel.columns])


@register("trade_value_counts", OT.backtest("""
SELECT 'exit_reason=' || exit_reason AS value, count(*) AS count FROM t_table GROUP BY 1
UNION ALL SELECT 'direction=' || direction, count(*) FROM t_table GROUP BY 1
UNION ALL SELECT 'signal_type=' || signal_type, count(*) FROM filtered GROUP BY 1
UNION ALL SELECT 'signal_direction=' || CAST(signal_direction AS VARCHAR), count(*) FROM filtered GROUP BY 1"""))
def q_trade_value_counts(spark, sf_dir):
    """Value counts of exit_reason and direction of the trades, signal_type and direction of the signals."""
    bars, filt = _stage_inputs(spark, sf_dir)
    t = materialize(trades.trade_table(filt, bars, _bt_params(bars)))
    a = metrics.value_counts(t, F.concat(F.lit("exit_reason="), F.col("exit_reason")).alias("value"))
    b = metrics.value_counts(t, F.concat(F.lit("direction="), F.col("direction")).alias("value"))
    c = metrics.value_counts(filt, F.concat(F.lit("signal_type="), F.col("signal_type")).alias("value"))
    d = metrics.value_counts(filt, F.concat(F.lit("signal_direction="), F.col("signal_direction").cast("string")).alias("value"))
    return a.unionByName(b).unionByName(c).unionByName(d)


@register("quartile_performance", O.rounded(OT.backtest("""
SELECT CAST(CASE WHEN signal_score <= q[1] THEN 1 WHEN signal_score <= q[2] THEN 2 WHEN signal_score <= q[3] THEN 3 ELSE 4 END AS INTEGER)
         AS quartile, avg(pnl) AS avg_pnl, sum(pnl) AS total_pnl, count(*) AS trades, avg(pnl_pct) AS avg_pnl_pct,
       avg(position_size) AS avg_position, count(*) FILTER (WHERE pnl > 0) / count(*) * 100 AS win_rate
FROM t_table, (SELECT quantile_cont(signal_score, [0.25, 0.5, 0.75]) AS q FROM t_table) GROUP BY 1"""),
    ["avg_pnl", "total_pnl", "avg_pnl_pct", "avg_position", "win_rate"]))
def q_quartile_performance(spark, sf_dir):
    """M7 + A9: performance by signal-score quartile (qcut edges, right-closed)."""
    t, _, _ = _trades(spark, sf_dir)
    return metrics.quartile_performance(t)


@register("top_trades", O.rounded(OT.backtest("""
SELECT * EXCLUDE (pid, dir), count(*) FILTER (WHERE direction = 'long') OVER () AS top_long, sum(pnl) OVER () AS top_total,
       sum(pnl) OVER () / (SELECT sum(pnl) FROM t_table) * 100 AS top_share
FROM (SELECT *, CAST(row_number() OVER (ORDER BY pnl DESC, ticker, entry_date) AS INTEGER) AS rank FROM t_table) WHERE rank <= 20"""),
    OT.TRADE_DOUBLES + ["top_total", "top_share"]))
def q_top_trades(spark, sf_dir):
    """O2: top 20 trades by P&L with long count, total and share of all profit."""
    t, _, _ = _trades(spark, sf_dir)
    return metrics.top_trades(t.select(*_TRADE_COLS), 20)


@register("monthly_returns", O.rounded(OT.backtest("""
SELECT name, CAST(date_trunc('month', date) AS DATE) AS month,
       (arg_max(portfolio_value, date) / arg_min(portfolio_value, date) - 1) * 100 AS monthly_return
FROM t_named GROUP BY ALL""", curve=True), ["monthly_return"]))
def q_monthly_returns(spark, sf_dir):
    """Monthly return of the strategy curve."""
    t, bars, p = _trades(spark, sf_dir)
    curve = trades.equity_curve(t, bars, p).select(F.lit("strategy").alias("name"), "date", "portfolio_value")
    return metrics.monthly_returns(curve)


# ---------------------------------------------------------------- sweep

PHASE1_POINTS = [dict(**a, **b) for a in sweep.grid(sweep.PHASE1_SIGNAL_GRID) for b in sweep.grid(sweep.PHASE1_FILTER_GRID)]


def _sweep_inputs(spark, sf_dir):
    """Parameter-free parts, computed once: the daily table and the bars."""
    bars = materialize(fx.price_bars(spark, sf_dir))
    return materialize(daily_ops.daily_sentiment_weighted(fx.sentiment_results(spark, sf_dir))), bars


def _phase1(spark, sf_dir):
    daily_t, bars = _sweep_inputs(spark, sf_dir)
    bp = _bt_params(bars, sizing="flat", **sweep.PHASE1_BACKTEST)
    res = sweep.sweep(daily_t, bars, PHASE1_POINTS, shock.ShockParams(), market.MarketParams(), bp)
    return res, (daily_t, bars, bp)


@register("sweep_phase1", O.rounded(OT.sweep(PHASE1_POINTS, "SELECT * FROM s_board"), OT.BOARD_DOUBLES))
def q_sweep_phase1(spark, sf_dir):
    """T9 phase 1 + J11 + A28: 2 x 2 signal thresholds x 2 market-filter thresholds, fixed exits."""
    return _phase1(spark, sf_dir)[0]


@register("sweep_leaderboard", O.rounded(OT.sweep(PHASE1_POINTS, "SELECT * FROM s_board ORDER BY sharpe DESC, point_id LIMIT 10"), OT.BOARD_DOUBLES))
def q_sweep_leaderboard(spark, sf_dir):
    """Top 10 phase-1 points by Sharpe."""
    return sweep.leaderboard(_phase1(spark, sf_dir)[0], "sharpe", 10)


@register("sweep_impact", O.rounded(OT.sweep(PHASE1_POINTS, " UNION ALL ".join(
    f"SELECT '{p}' AS parameter, {p} AS value, avg(total_return) AS mean, max(total_return) AS max, "
    f"stddev_samp(total_return) AS std, min(total_return) AS min FROM s_board GROUP BY {p}"
    for p in ("min_mentions", "base_z_threshold", "z_threshold"))), ["mean", "max", "std", "min"]))
def q_sweep_impact(spark, sf_dir):
    """mean/max/std/min total return by each phase-1 parameter."""
    return sweep.impact_by_parameter(_phase1(spark, sf_dir)[0], ["min_mentions", "base_z_threshold", "z_threshold"])


def _phase2(spark, sf_dir):
    res1, (daily_t, bars, bp) = _phase1(spark, sf_dir)
    best = sweep.leaderboard(materialize(res1), "sharpe", 1).first()  # one row picks phase 2's base
    sp = shock.ShockParams(min_mentions=best["min_mentions"], base_z_threshold=best["base_z_threshold"])
    mp = market.MarketParams(z_threshold=best["z_threshold"])
    return sweep.sweep(daily_t, bars, sweep.grid(sweep.PHASE2_BACKTEST_GRID), sp, mp, bp)


@register("sweep_phase2", O.rounded(OT.two_phases(PHASE1_POINTS, sweep.grid(sweep.PHASE2_BACKTEST_GRID), "SELECT * FROM s_board_b"),
                                  OT.BOARD_DOUBLES))
def q_sweep_phase2(spark, sf_dir):
    """T9 phase 2: 3 x 3 x 3 exit grid on the best phase-1 signal/filter point."""
    return _phase2(spark, sf_dir)


@register("sweep_stop_take_pivot", O.rounded(OT.two_phases(PHASE1_POINTS, sweep.grid(sweep.PHASE2_BACKTEST_GRID), """
SELECT stop_loss, avg(total_return) FILTER (WHERE take_profit = 0.08) AS take_0_08,
       avg(total_return) FILTER (WHERE take_profit = 0.10) AS take_0_1, avg(total_return) FILTER (WHERE take_profit = 0.12) AS take_0_12
FROM s_board_b GROUP BY stop_loss"""), ["take_0_08", "take_0_1", "take_0_12"]))
def q_sweep_stop_take_pivot(spark, sf_dir):
    """Mean total return, stop-loss rows x take-profit columns (phase 2)."""
    res = _phase2(spark, sf_dir)
    piv = sweep.pivot_mean(res, "stop_loss", "take_profit", "total_return",
                           values=sweep.PHASE2_BACKTEST_GRID["take_profit"])
    return piv.toDF(*[c if c == "stop_loss" else "take_" + c.replace(".", "_") for c in piv.columns])


GRID_POINTS = [{"window_days": 3}, {"window_days": 5}, {"baseline_days": 20}, {"bullish_bias": 0.3}, {"long_only": True},
               {"max_position": 0.02}, {"window_days": 5, "baseline_days": 20, "bullish_bias": 0.3, "long_only": True}]


@register("sweep_grid", O.rounded(OT.sweep(GRID_POINTS, "SELECT * FROM s_board"), OT.BOARD_DOUBLES))
def q_sweep_grid(spark, sf_dir):
    """T9 + M3 + J11: window and baseline lengths, bullish bias, long-only and position cap as grid parameters."""
    daily_t, bars = _sweep_inputs(spark, sf_dir)
    bp = _bt_params(bars, sizing="flat", **sweep.PHASE1_BACKTEST)
    return sweep.sweep(daily_t, bars, GRID_POINTS, shock.ShockParams(), market.MarketParams(), bp)


#: Two values of five parameters out of all three groups of the full grid, the others as in phase 1.
THREE_GROUPS = sweep.grid({"window_days": [3, 5], "z_threshold": [1.5, 2.5], "atr_move_threshold": [1.5, 2.5], "max_holding_days": [5, 10],
                           "long_only": [True, False]})


@register("sweep_three_groups", O.rounded(OT.sweep(THREE_GROUPS, """
SELECT b.*, p.vol_expansion_threshold, p.atr_move_threshold FROM s_board b JOIN t_points p ON p.pid = b.point_id"""), OT.BOARD_DOUBLES))
def q_sweep_three_groups(spark, sf_dir):
    """T9 + J11 over all three parameter groups at once, in two shards of points that are published one by one;
    the 31,104 points of ``sweep.full_grid()`` take the same way."""
    daily_t, bars = _sweep_inputs(spark, sf_dir)
    bp = _bt_params(bars, sizing="flat", **sweep.PHASE1_BACKTEST)
    return sweep.sweep_in_shards(daily_t, bars, THREE_GROUPS, shock.ShockParams(), market.MarketParams(), bp, scratch_path(spark, "sweep"), 16)


@register("top_trades_by_score", O.rounded(OT.backtest("""
SELECT * EXCLUDE (pid, dir) FROM t_table ORDER BY signal_score DESC, ticker, entry_date LIMIT 10"""), OT.TRADE_DOUBLES))
def q_top_trades_by_score(spark, sf_dir):
    """The ten trades with the highest signal score (ties by ticker, entry date)."""
    t, _, _ = _trades(spark, sf_dir)
    return t.select(*_TRADE_COLS).orderBy(F.col("signal_score").desc(), "ticker", "entry_date").limit(10)


# ------------------------------------------------------------ report (demo)

def _anchors(filt):
    return filt.select("ticker", F.col("signal_date").alias("end_date"))


def _history(spark, sf_dir):
    filt = _filtered(spark, sf_dir)
    return report.sentiment_history(fx.sentiment_results(spark, sf_dir), _anchors(filt), filt)


_HIST_D = ["sentiment_mean", "total_upvotes", "sentiment_stddev", "weighted_sentiment", "window_sentiment",
           "baseline_mean", "baseline_std", "z_score"]


@register("report_dates", O.with_ctes(*O.filtered_chain(), body="""
SELECT signal_date, CAST(row_number() OVER (ORDER BY signal_date DESC) AS INTEGER) AS place
FROM (SELECT DISTINCT signal_date FROM filtered)"""))
def q_report_dates(spark, sf_dir):
    """Distinct signal days of the filtered signals, the latest first (``place`` 1)."""
    days = report.available_dates(_filtered(spark, sf_dir))
    return days.withColumn("place", F.row_number().over(Window.orderBy(F.col("signal_date").desc())))


@register("report_signals_latest", O.rounded(O.with_ctes(*O.filtered_chain(), body="""
SELECT signal_date, ticker, signal_type, window_sentiment, z_score,
       CAST(row_number() OVER (ORDER BY ticker) AS INTEGER) AS place
FROM filtered WHERE signal_date = (SELECT max(signal_date) FROM filtered)"""), ["window_sentiment", "z_score"]))
def q_report_signals_latest(spark, sf_dir):
    """The signal rows of a chosen date (here the latest), ordered by ticker."""
    filt = materialize(_filtered(spark, sf_dir))
    rows = filt.filter(F.col("signal_date") == filt.agg(F.max("signal_date")).scalar())
    return rows.select("signal_date", "ticker", "signal_type", "window_sentiment", "z_score",
                       F.row_number().over(Window.orderBy("ticker")).alias("place"))


@register("report_signals_by_date", O.with_ctes(*O.filtered_chain(), body="""
SELECT signal_date, count(*) FILTER (WHERE signal_type = 'BUY') AS n_buy,
       count(*) FILTER (WHERE signal_type = 'SELL') AS n_sell, count(*) AS n_signals,
       string_agg(ticker, ',' ORDER BY ticker) AS tickers
FROM filtered GROUP BY signal_date"""))
def q_report_signals_by_date(spark, sf_dir):
    """P14 for every date: BUY / SELL counts and the tickers in order."""
    return report.signals_by_date(_filtered(spark, sf_dir))


@register("report_history", O.rounded(O.with_ctes(*O.filtered_chain(), O.REPORT_HISTORY,
                                                  body="SELECT * FROM hist"), _HIST_D))
def q_report_history(spark, sf_dir):
    """A3 + W5 + J10 for every filtered signal: 31-day daily history, 3-row window, signal markers."""
    return _history(spark, sf_dir)


@register("report_bands", O.rounded(O.with_ctes(*O.filtered_chain(), O.REPORT_HISTORY, """
b AS (SELECT *, CASE WHEN count(window_sentiment) OVER w30 >= 15 THEN avg(window_sentiment) OVER w30 END
                  AS baseline_mean_computed,
                CASE WHEN count(window_sentiment) OVER w30 >= 15 THEN stddev_samp(window_sentiment) OVER w30 END
                  AS baseline_std_computed
      FROM hist WINDOW w30 AS (PARTITION BY ticker, end_date ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""",
        """t AS (SELECT *, sum(mentions) OVER w3 AS mention_factor FROM b
      WHERE baseline_mean_computed IS NOT NULL AND baseline_std_computed IS NOT NULL
      WINDOW w3 AS (PARTITION BY ticker, end_date ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
        body="""SELECT *, 2.0 / (1 + 0.2 * ln(1 + greatest(CAST(mention_factor AS DOUBLE), 1.0))) AS z_threshold,
       baseline_mean_computed + (2.0 / (1 + 0.2 * ln(1 + greatest(CAST(mention_factor AS DOUBLE), 1.0))))
         * baseline_std_computed AS upper_band,
       baseline_mean_computed - (2.0 / (1 + 0.2 * ln(1 + greatest(CAST(mention_factor AS DOUBLE), 1.0))))
         * baseline_std_computed AS lower_band
FROM t"""), _HIST_D + ["baseline_mean_computed", "baseline_std_computed", "z_threshold", "upper_band",
                       "lower_band"]))
def q_report_bands(spark, sf_dir):
    """Baseline (30 rows, >= 15) over each history slice, then the dynamic bands."""
    return report.history_bands(_history(spark, sf_dir))


@register("report_summary", O.with_ctes(*O.filtered_chain(), O.REPORT_HISTORY, body=f"""
SELECT ticker, end_date, {O.rnd('avg(sentiment_mean)', 3)} AS avg_sentiment, sum(mentions) AS total_mentions,
       {O.rnd('avg(window_sentiment)', 3)} AS window_sentiment,
       CASE WHEN count(*) > 1 THEN {O.rnd('stddev_samp(sentiment_mean)', 3)} ELSE 0.0 END AS sentiment_volatility,
       count(*) AS total_days, count(z_score) AS signal_days,
       count(*) FILTER (WHERE z_score > 0) AS buy_signals, count(*) FILTER (WHERE z_score < 0) AS sell_signals,
       {O.rnd('avg(z_score)', 2)} AS avg_z_score
FROM hist GROUP BY ticker, end_date"""))
def q_report_summary(spark, sf_dir):
    """A4: history summary per filtered signal."""
    return report.history_summary(_history(spark, sf_dir))


_PANEL_SQL = """
anchors AS (SELECT DISTINCT ticker, signal_date AS end_date FROM filtered),
panel AS (SELECT a.ticker, a.end_date, b.date, b.open, b.high, b.low, b.close, b.volume,
                 (b.close / lag(b.close) OVER w - 1) * 100 AS pct_change,
                 CASE WHEN count(b.close) OVER w3 >= 3 THEN avg(b.close) OVER w3 END AS ma_3
          FROM anchors a JOIN bars b ON b.ticker = a.ticker AND b.date BETWEEN a.end_date - 30 AND a.end_date
          WINDOW w AS (PARTITION BY a.ticker, a.end_date ORDER BY b.date),
                 w3 AS (PARTITION BY a.ticker, a.end_date ORDER BY b.date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@register("report_price_panel", O.rounded(O.with_ctes(*O.filtered_chain(), _PANEL_SQL, body="SELECT * FROM panel"),
                                          ["open", "high", "low", "close", "volume", "pct_change", "ma_3"]))
def q_report_price_panel(spark, sf_dir):
    """W7 + W15 per filtered signal: 31-day bars, daily % change, 3-bar average."""
    filt = _filtered(spark, sf_dir)
    return report.price_panel(fx.price_bars(spark, sf_dir), _anchors(filt))


@register("report_price_summary", O.rounded(O.with_ctes(*O.filtered_chain(), _PANEL_SQL, body="""
SELECT ticker, end_date, arg_min(close, date) AS first_price, arg_max(close, date) AS last_price,
       min(close) AS price_min, max(close) AS price_max,
       (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 AS price_change_pct,
       min(close) - (max(close) - min(close)) * 0.08 AS y_min, max(close) + (max(close) - min(close)) * 0.08 AS y_max
FROM panel GROUP BY ticker, end_date"""), ["first_price", "last_price", "price_min", "price_max", "price_change_pct",
                                           "y_min", "y_max"]))
def q_report_price_summary(spark, sf_dir):
    """A5: first/last/%-change/min/max and padded range of each 31-day price panel."""
    filt = _filtered(spark, sf_dir)
    return report.price_summary(report.price_panel(fx.price_bars(spark, sf_dir), _anchors(filt)))


# ------------------------------------------------------------- profile (EDA)
_PROFILE_COLS = ["id", "type", "text", "created_utc", "score", "subreddit", "upvote_ratio", "parent_post_id"]


def _unified(spark, sf_dir):
    """F1 after harmonise / placeholders / title merge / type coercion (the EDA input)."""
    u = clean.harmonize(clean.scan_posts(fx.raw_posts(spark, sf_dir)),
                        clean.scan_comments(fx.raw_comments(spark, sf_dir)))
    return clean.coerce_types(clean.merge_title(clean.blank_and_drop_placeholders(u))).select(*_PROFILE_COLS)


def _f1_sql(body, *extra):
    return O.with_ctes(O.F1_RAW, O.F1_CLEAN, *extra, body=body)


_TS = "make_timestamp(created_utc * 1000000)"


@register("profile_distinct_counts", _f1_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_unique FROM merged" for c in _PROFILE_COLS)))
def q_profile_distinct_counts(spark, sf_dir):
    """Distinct non-null values per column of the unified mentions."""
    return profile.distinct_counts(_unified(spark, sf_dir))


@register("profile_missing", _f1_sql(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS missing, "
        f"count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS pct FROM merged" for c in _PROFILE_COLS)
    + ") WHERE missing > 0"))
def q_profile_missing(spark, sf_dir):
    """NULL counts and shares of the unified mentions (columns with NULLs only)."""
    return profile.missingness(_unified(spark, sf_dir))


_WC = f"len(list_filter(regexp_split_to_array(text, '{O.WS_RE}'), lambda x: x <> ''))"
_WSTAT = (f"count(*) AS texts, avg({_WC}) AS mean_words, median({_WC}) AS median_words, "
          f"min({_WC}) AS min_words, max({_WC}) AS max_words, "
          f"count(*) FILTER (WHERE length(text) <= 10) * 100.0 / count(*) AS short_pct")


@register("profile_word_stats", O.rounded(_f1_sql(
    f"SELECT type AS scope, {_WSTAT} FROM merged WHERE text IS NOT NULL AND text <> '' GROUP BY type "
    f"UNION ALL SELECT 'all', {_WSTAT} FROM merged WHERE text IS NOT NULL AND text <> ''"),
    ["mean_words", "median_words", "short_pct"]))
def q_profile_word_stats(spark, sf_dir):
    """A15 + X8: word-count mean/median/min/max and short-text share, per type and overall."""
    return profile.word_stats(_unified(spark, sf_dir))


@register("profile_activity", _f1_sql(f"""
SELECT 'weekday' AS dimension, s.value, coalesce(c.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS value FROM range(7)) s
LEFT JOIN (SELECT CAST(isodow({_TS}) - 1 AS INTEGER) AS value, count(*) AS n FROM merged GROUP BY 1) c USING (value)
UNION ALL
SELECT 'hour', s.value, coalesce(c.n, 0)
FROM (SELECT CAST(range AS INTEGER) AS value FROM range(24)) s
LEFT JOIN (SELECT CAST(hour({_TS}) AS INTEGER) AS value, count(*) AS n FROM merged GROUP BY 1) c USING (value)"""))
def q_profile_activity(spark, sf_dir):
    """A16 + D3: mentions by weekday (0 = Monday) and hour, all 7 / 24 values kept."""
    return profile.activity(_unified(spark, sf_dir))


@register("profile_dates_ids", _f1_sql(f"""
SELECT min(CAST({_TS} AS DATE)) AS first_date, max(CAST({_TS} AS DATE)) AS last_date,
       datediff('day', min(CAST({_TS} AS DATE)), max(CAST({_TS} AS DATE))) AS span_days,
       count(*) AS total, count(DISTINCT id) AS unique_ids, count(*) - count(DISTINCT id) AS duplicates,
       avg(upvote_ratio) FILTER (WHERE type = 'post') AS mean_ratio,
       median(upvote_ratio) FILTER (WHERE type = 'post') AS median_ratio
FROM merged"""))
def q_profile_dates_ids(spark, sf_dir):
    """A17 + A18 + A19: date range and span, id integrity, upvote-ratio mean/median of posts."""
    u = _unified(spark, sf_dir)
    return profile.dates_ids_ratios(u)


@register("profile_ticker_coverage", O.rounded(O.with_ctes(O.F1_RAW, O.F1_CLEAN, O.f1_tickers_sql(), body="""
SELECT type, count(*) AS rows, count(*) FILTER (WHERE len(own_tickers) > 0) AS with_tickers_before,
       count(*) FILTER (WHERE len(mentioned_tickers) > 0) AS with_tickers_after,
       count(*) FILTER (WHERE len(mentioned_tickers) > 0) - count(*) FILTER (WHERE len(own_tickers) > 0) AS gained,
       count(*) FILTER (WHERE len(own_tickers) > 0) * 100.0 / count(*) AS pct_before,
       count(*) FILTER (WHERE len(mentioned_tickers) > 0) * 100.0 / count(*) AS pct_after
FROM inherited GROUP BY type"""), ["pct_before", "pct_after"]))
def q_profile_ticker_coverage(spark, sf_dir):
    """Ticker coverage by type before / after inheritance."""
    return profile.ticker_coverage(_f1_tickers(spark, sf_dir))


@register("sentiment_by_subreddit", O.rounded(O.with_ctes(O.F2_SENTIMENT_RESULTS, body="""
SELECT subreddit, avg(final_sentiment_score) AS mean_sentiment, count(*) AS n
FROM sentiment_results GROUP BY subreddit HAVING count(*) >= 10"""), ["mean_sentiment"]))
def q_sentiment_by_subreddit(spark, sf_dir):
    """A10: mean sentiment and count by subreddit, HAVING count >= 10."""
    return profile.group_sentiment(fx.sentiment_results(spark, sf_dir), "subreddit", min_count=10)


@register("sentiment_by_ticker", O.rounded(O.with_ctes(O.F2_SENTIMENT_RESULTS, body="""
SELECT ticker, avg(final_sentiment_score) AS mean_sentiment, count(*) AS n FROM sentiment_results GROUP BY ticker"""),
    ["mean_sentiment"]))
def q_sentiment_by_ticker(spark, sf_dir):
    """Mean sentiment and mention count by ticker."""
    return profile.group_sentiment(fx.sentiment_results(spark, sf_dir), "ticker")


@register("sentiment_over_time", O.rounded(O.with_ctes(O.F2_SENTIMENT_RESULTS, body=f"""
SELECT {O.EPOCH_DAY} AS date, avg(final_sentiment_score) AS mean_sentiment, count(*) AS n
FROM sentiment_results GROUP BY 1"""), ["mean_sentiment"]))
def q_sentiment_over_time(spark, sf_dir):
    """A12 + D1: mean sentiment by UTC day."""
    sr = fx.sentiment_results(spark, sf_dir)
    return profile.group_sentiment(sr, F.to_date(F.timestamp_seconds("created_utc")).alias("date"))


@register("top_tickers", O.with_ctes(O.F4_SPARSE_MENTIONS, body="""
SELECT ticker, count(*) AS mentions FROM sentiment_results GROUP BY ticker ORDER BY mentions DESC, ticker LIMIT 20"""))
def q_top_tickers(spark, sf_dir):
    """O3: top 20 symbols by mentions on the F4 stream (150 symbols; ties by symbol)."""
    return profile.top_by_count(fx.sparse_mentions(spark, sf_dir), "ticker", 20)


_SCORES = [f"s{j}" for j in range(4)]
_SCORE_CTE = "sc AS (SELECT " + ", ".join(f"{O.m4(j)['score']} AS s{j}" for j in range(4)) + " FROM f5)"


@register("describe_scores", O.rounded(O.with_ctes(O.f5_cte(), _SCORE_CTE, body=" UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count({c}) AS DOUBLE) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM sc" for c in _SCORES)),
    ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]))
def q_describe_scores(spark, sf_dir):
    """Describe the four model scores (exact interpolated quartiles)."""
    df = fx.class_probabilities(spark, sf_dir).select(
        *[(F.col(f"m{j}_p_pos") - F.col(f"m{j}_p_neg")).alias(f"s{j}") for j in range(4)])
    return profile.describe(df, _SCORES)


@register("score_correlations", O.rounded(O.with_ctes(O.f5_cte(), _SCORE_CTE, body=" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM sc" for a in _SCORES for b in _SCORES)),
    ["corr"]))
def q_score_correlations(spark, sf_dir):
    """Pearson correlation matrix of the four model scores (long form)."""
    df = fx.class_probabilities(spark, sf_dir).select(
        *[(F.col(f"m{j}_p_pos") - F.col(f"m{j}_p_neg")).alias(f"s{j}") for j in range(4)])
    return profile.correlation_matrix(df, _SCORES)


_EDGE = "(CASE WHEN ({k}) >= 50 THEN hi ELSE lo + ({k}) * ((hi - lo) / 50) END)"
_K0 = "least(CAST(floor((final_sentiment_score - lo) * (50.0 / (hi - lo))) AS INTEGER), 49)"


@register("score_histogram", O.rounded(O.with_ctes(O.F2_SENTIMENT_RESULTS, """
mm AS (SELECT min(final_sentiment_score) AS lo, max(final_sentiment_score) AS hi FROM sentiment_results)""", f"""
k0 AS (SELECT final_sentiment_score AS x, lo, hi, {_K0} AS k FROM sentiment_results, mm
       WHERE final_sentiment_score IS NOT NULL)""", f"""
binned AS (SELECT CASE WHEN x < {_EDGE.format(k='k')} THEN k - 1
                       WHEN x >= {_EDGE.format(k='k + 1')} AND k <> 49 THEN k + 1 ELSE k END + 1 AS bin
           FROM k0)""", body=f"""
SELECT CAST(s.bin AS INTEGER) AS bin, {_EDGE.format(k='s.bin - 1')} AS bin_start, {_EDGE.format(k='s.bin')} AS bin_end,
       coalesce(c.n, 0) AS n
FROM (SELECT range AS bin FROM range(1, 51)) s, mm
LEFT JOIN (SELECT bin, count(*) AS n FROM binned GROUP BY bin) c ON c.bin = s.bin"""),
    ["bin_start", "bin_end"]))
def q_score_histogram(spark, sf_dir):
    """50 equal-width bins of the sentiment score, last bin closed, empty bins kept."""
    return profile.histogram(fx.sentiment_results(spark, sf_dir), "final_sentiment_score", 50)


# ------------------------------------------------------- sources and sinks (S)

@register("incremental_daily", O.rounded(_A1_SQL, ["sentiment_mean", "sentiment_median", "sentiment_std",
                                                   "total_upvotes", "avg_upvotes", "weighted_sentiment"]))
def q_incremental_daily(spark, sf_dir):
    """S13 + streaming: F2 results land in three waves (rows dealt by a hash, so later waves hold
    late rows of the same days) in month partitions; a Structured Streaming job merges each
    micro-batch into the daily state and replaces the touched days; the final table equals
    A1 over everything."""
    from ..streaming.incremental import land, start_daily_refresh
    base = scratch_path(spark, "incremental")
    sr = fx.sentiment_results(spark, sf_dir)
    wave = F.pmod(F.xxhash64(*sr.columns), F.lit(3))
    for i in range(3):
        land(sr.filter(wave == i), f"{base}/source")
        start_daily_refresh(spark, f"{base}/source", f"{base}/daily", f"{base}/_checkpoint").awaitTermination()
    out = readers.load_daily(spark, f"{base}/daily")
    return out.select("ticker", "sentiment_date", "sentiment_mean", "sentiment_median", "sentiment_std",
                      "mentions", "total_upvotes", "avg_upvotes", "weighted_sentiment",
                      "positive_count", "neutral_count", "negative_count")


@register("sink_signals_typed", O.with_ctes(O.F2_SENTIMENT_RESULTS, O.DAILY_WEIGHTED, *O.shock_ctes(), body="""
SELECT signal_date, ticker, CAST(CAST(sentiment_mean AS DECIMAL(38,9)) AS DECIMAL(15,6)) AS sentiment_mean,
       CAST(CAST(total_upvotes AS DECIMAL(38,9)) AS DECIMAL(15,6)) AS total_upvotes, CAST(CAST(window_sentiment AS DECIMAL(38,9)) AS DECIMAL(15,6)) AS window_sentiment,
       CAST(CAST(window_mentions AS DECIMAL(38,9)) AS DECIMAL(15,6)) AS window_mentions, CAST(CAST(baseline_mean AS DECIMAL(38,9)) AS DECIMAL(15,6)) AS baseline_mean,
       CAST(CAST(baseline_std AS DECIMAL(38,9)) AS DECIMAL(15,6)) AS baseline_std, CAST(CAST(z_score AS DECIMAL(38,9)) AS DECIMAL(15,6)) AS z_score, signal_type,
       CAST(signal_direction AS DECIMAL(3,0)) AS signal_direction, CAST(CAST(signal_score AS DECIMAL(38,9)) AS DECIMAL(15,6)) AS signal_score
FROM signals"""))
def q_sink_signals_typed(spark, sf_dir):
    """S10 (+S8): BUY/SELL rows typed (NUMBER(15,6) -> DECIMAL), NaN/inf -> NULL,
    overwritten as a table and as CSV, read back from the table."""
    sig = shock.shock_signals(fx.sentiment_results(spark, sf_dir))
    base = scratch_path(spark, "signals")
    sinks.load_signals(sig, f"{base}/table")
    sinks.to_csv(sig, f"{base}/csv")
    return versions.read_table(spark, f"{base}/table")


@register("sink_filtered_typed", O.with_ctes(*O.filtered_chain(), body=f"""
SELECT signal_date, ticker, target_date, signal_type, {', '.join(f'CAST(CAST({c} AS DECIMAL(38,7)) AS DECIMAL(15,4)) AS {c}' for c in O.MARKET_COLS)},
       CAST(market_moved_flag AS DECIMAL(1,0)) AS market_moved_flag, CAST(signal_direction AS DECIMAL(3,0)) AS signal_direction,
       {', '.join(f'CAST(CAST({c} AS DECIMAL(38,9)) AS DECIMAL(15,6)) AS {c}' for c in O.SIGNAL_DOUBLES)}
FROM filtered"""))
def q_sink_filtered_typed(spark, sf_dir):
    """The 21-column filtered-signal table, typed, overwritten, read back whole."""
    base = scratch_path(spark, "filtered")
    sinks.load_filtered_signals(_filtered(spark, sf_dir), f"{base}/table")
    return versions.read_table(spark, f"{base}/table")


@register("reference_dim_files", O.with_ctes("""
nas AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS ticker, p_name AS company_name, 'NASDAQ' AS exchange, 0 AS prio
        FROM part WHERE p_size % 10 <> 0)""", """
nyse AS (SELECT 'P' || CAST(s_suppkey AS VARCHAR) AS ticker, s_name AS company_name, 'NYSE' AS exchange, 1 AS prio
         FROM supplier)""", """
stop AS (SELECT 'P' || CAST(n_nationkey AS VARCHAR) AS ticker FROM nation)""", body="""
SELECT ticker, company_name, exchange FROM (SELECT * FROM nas UNION ALL SELECT * FROM nyse)
WHERE ticker NOT IN (SELECT ticker FROM stop)
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY prio, company_name, exchange) = 1"""))
def q_reference_dim_files(spark, sf_dir):
    """S4 + S5 + S6 + S7 + S8 + U2 + J2: a pipe-delimited listing (with comment, footer
    and test-issue rows) from ``part``, an exchange CSV from ``supplier`` and a JSON
    stop-list from ``nation`` are written, read back, unioned with first-list
    priority, stop-listed, exported and re-read with normalised headers."""
    base = scratch_path(spark, "dims")
    part = fx.table(spark, sf_dir, "part")
    test = (F.when(F.col("p_size") % 10 == 0, "Y").when(F.col("p_size") % 10 == 1, F.lit(None)).otherwise("N"))
    listing = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("Symbol"),
                          F.col("p_name").alias("Security Name"), test.alias("Test Issue"))
    footer = spark.createDataFrame([("File Creation Time: 0000", None, None)],
                                   "Symbol string, `Security Name` string, `Test Issue` string")
    sinks.to_csv(listing.unionByName(footer), f"{base}/nasdaq", sep="|")
    sup = fx.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("ACT Symbol"),
        F.col("s_name").alias("Company Name"))
    sinks.to_csv(sup, f"{base}/nyse")
    (fx.table(spark, sf_dir, "nation")
       .agg(F.to_json(F.struct(F.collect_list(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")))
                               .alias("stopwords"))).alias("value"))
       .write.mode("overwrite").text(f"{base}/stop"))
    nas = readers.read_symbol_list(spark, f"{base}/nasdaq", "NASDAQ")
    ny = readers.read_exchange_csv(spark, f"{base}/nyse", "NYSE")
    dim = tickers.combine_exchanges(nas, ny)
    stop = readers.read_stoplist(spark, f"{base}/stop").withColumnRenamed("word", "ticker")
    dim = dim.join(stop, "ticker", "left_anti")
    dim.toDF("Ticker", " Company Name ", "Exchange").write.mode("overwrite").option("header", True).csv(
        f"{base}/tickers")
    return readers.read_ticker_csv(spark, f"{base}/tickers").select("ticker", "company_name", "exchange")


# ------------------------------------------------------------ remaining ops

@register("document_text_views", OX.text_views())
def q_document_text_views(spark, sf_dir):
    """X6 (default and compatibility modes) + X7 + X8 over the whole text of every
    ``documents`` row, with the row's detected symbols protected."""
    d = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    t = tickers.detect_tickers(d, fx.ticker_dim(spark))
    v = t.select("id", tx.normalized_views("text", "mentioned_tickers").alias("views"),
                 tx.remove_stopwords("text", "mentioned_tickers").alias("without_stopwords"),
                 tx.text_length("text").alias("text_length"), tx.word_count("text").alias("word_count"))
    return v.select("id", "views.normalized", "views.normalized_compat", "without_stopwords", "text_length", "word_count")


@register("charting_window", OT.charting())
def q_charting_window(spark, sf_dir):
    """The 40-bar charting slice of every filtered signal with metrics
    recomputed on the slice and the triggers of its last 5 bars."""
    bars, filt = _stage_inputs(spark, sf_dir)
    anchors = filt.select("ticker", F.col("target_date").cast("date").alias("target_date")).distinct()
    return market.charting_window(bars, anchors).select(
        "ticker", "target_date", "date", "bar_n", "pct_3d_z", "ret_z", "vol_z", "vol_expansion", "atr_move",
        "is_recent", "trig_pct_3d_z", "trig_ret_z", "trig_vol_z", "trig_vol_expansion", "trig_atr_move")


@register("signal_sample", O.rounded(O.with_ctes(*O.filtered_chain(), body="""
SELECT signal_date, ticker, signal_type, window_sentiment, z_score FROM filtered
ORDER BY signal_date, ticker LIMIT 25"""), ["window_sentiment", "z_score"]))
def q_signal_sample(spark, sf_dir):
    """O6 + S3 + O1: a deterministic sample - ordered first, then the first 25 rows."""
    f = _filtered(spark, sf_dir)
    return readers.sample_preprocessed(f, 25, order=("signal_date", "ticker")).select(
        "signal_date", "ticker", "signal_type", "window_sentiment", "z_score")


@register("preprocessed_sample", f"SELECT * FROM ({OX.preprocessed('date')}) ORDER BY created_utc, id LIMIT 25")
def q_preprocessed_sample(spark, sf_dir):
    """S3: a deterministic sample of preprocessed rows, whole texts: ordered by time and id, the first 25."""
    pp = pipelines.preprocessed_table(pipelines.preprocess(
        fx.raw_posts(spark, sf_dir), fx.raw_comments(spark, sf_dir), fx.ticker_dim(spark), fx.ticker_stoplist(spark)))
    return readers.sample_preprocessed(pp, 25)


@register("exploded_mentions_all", O.with_ctes(O.F1_RAW, O.F1_CLEAN, O.f1_tickers_sql(), body="""
SELECT id, unnest(mentioned_tickers) AS ticker,
       CAST(len(mentioned_tickers) AS INTEGER) AS n_tickers FROM inherited WHERE len(mentioned_tickers) > 0
UNION ALL SELECT id, NULL, 0 FROM inherited WHERE len(mentioned_tickers) = 0"""))
def q_exploded_mentions_all(spark, sf_dir):
    """R2, keeping mentions without a ticker (a NULL ticker)."""
    u = _f1_tickers(spark, sf_dir).withColumn("tickers_csv", tx.ticker_csv("mentioned_tickers"))
    ex = scoring.explode_tickers(u.select("id", "tickers_csv"), "tickers_csv", keep_empty=True)
    return ex.select("id", "ticker", F.col("n_tickers").cast("int").alias("n_tickers"))


@register("long_only_trades", O.rounded(OT.backtest("SELECT * EXCLUDE (pid, dir) FROM t_table", long_only=True), OT.TRADE_DOUBLES))
def q_long_only_trades(spark, sf_dir):
    """P13 + T1-T6: long-only backtest (BUY or direction +1 signals only)."""
    t, _, _ = _trades(spark, sf_dir, long_only=True)
    return t.select(*_TRADE_COLS)


@register("schema_check", O.with_ctes(*O.filtered_chain(), body=" UNION ALL ".join(
    f"SELECT '{c}' AS required_column, true AS present, count({c}) AS non_null_rows FROM filtered"
    for c in ["signal_date", "ticker", "signal_type", "window_sentiment", "window_mentions",
              "baseline_mean", "baseline_std", "z_score", "signal_score"])))
def q_schema_check(spark, sf_dir):
    """P17 (+P16): each required column of the filtered-signal table, whether it is
    present, and its non-NULL row count (one aggregate pass)."""
    from ..schemas import REQUIRED_SIGNAL_COLUMNS
    f = _filtered(spark, sf_dir)
    missing = set(gates.missing_columns(f))
    present = [c for c in REQUIRED_SIGNAL_COLUMNS if c not in missing]
    counts = f.agg(*[F.count(c).alias(c) for c in present])
    pairs = ", ".join(f"'{c}', `{c}`" for c in present)
    out = counts.selectExpr(f"stack({len(present)}, {pairs}) as (required_column, non_null_rows)")
    out = out.select("required_column", F.lit(True).alias("present"), "non_null_rows")
    for c in sorted(missing):
        out = out.unionByName(spark.createDataFrame([(c, False, 0)], out.schema))
    return out


_LOADED = ["sentiment_mean", "sentiment_median", "sentiment_std", "total_upvotes", "avg_upvotes", "weighted_sentiment"]


@register("daily_table_load", O.rounded(f"""
SELECT 'stored' AS route, * FROM ({_A1_SQL}) AS a WHERE ticker = 'S1' AND sentiment_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
UNION ALL
SELECT 'fallback', * FROM ({_A1_SQL}) AS b WHERE ticker = 'S2' AND sentiment_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
UNION ALL
SELECT 'refreshed', * FROM ({_A1_SQL}) AS c WHERE sentiment_date BETWEEN DATE '1995-02-01' AND DATE '1995-02-28'""", _LOADED))
def q_daily_table_load(spark, sf_dir):
    """S13 (batch refresh, day-partitioned, whole and by date range) + S12 (load with ticker, from and to
    filters, partition-pruned; a missing table falls back to aggregating on the fly with the same filters)."""
    sr = fx.sentiment_results(spark, sf_dir)
    base = scratch_path(spark, "daily")
    sinks.refresh_daily(sr, f"{base}/daily")
    sinks.refresh_daily(sr, f"{base}/month", "1995-02-01", "1995-02-28")
    stored = readers.load_daily(spark, f"{base}/daily", None, "S1", "1996-01-01", "1998-12-31")
    fallback = readers.load_daily(spark, f"{base}/absent", sr, "S2", "1997-01-01", "1997-12-31")
    month = readers.load_daily(spark, f"{base}/month")
    parts = [(d.select(F.lit(r).alias("route"), *fallback.columns)) for r, d in
             (("stored", stored), ("fallback", fallback), ("refreshed", month))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("preprocessed_table_load", OX.preprocessed("date_col"))
def q_preprocessed_table_load(spark, sf_dir):
    """Truncate-and-load of preprocessed_data (date stored as date_col), read back."""
    pp = pipelines.preprocessed_table(pipelines.preprocess(
        fx.raw_posts(spark, sf_dir), fx.raw_comments(spark, sf_dir), fx.ticker_dim(spark), fx.ticker_stoplist(spark)))
    path = scratch_path(spark, "preprocessed")
    sinks.load_preprocessed(pp, path)
    return versions.read_table(spark, path)
