"""DuckDB SQL twins of the registered queries (the correctness oracle).

The fixture CTEs mirror :mod:`tickerpulse.sources.fixtures` row for row; the
query SQL re-states each operator's rule independently in plain SQL. Doubles
are rounded to 6 places on both sides before hashing.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixtures
F2_SENTIMENT_RESULTS = """
sentiment_results AS (
  SELECT 'S' || CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 16 END AS VARCHAR) AS ticker,
         CAST(epoch(l_shipdate) AS BIGINT) AS created_utc,
         (l_discount - 0.05) / 0.05 AS final_sentiment_score,
         l_quantity / 50.0 AS normalized_upvotes,
         CASE WHEN l_discount > 0.055 THEN 'positive'
              WHEN l_discount < 0.045 THEN 'negative' ELSE 'neutral' END AS final_sentiment_label,
         l_returnflag AS subreddit
  FROM lineitem)"""

F3_PRICE_BARS = """
bars AS (
  SELECT 'S' || CAST(CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 16 END AS VARCHAR) AS ticker,
         CAST(l_shipdate AS DATE) AS date,
         arg_min(90.0 + (l_extendedprice / l_quantity) % 20.0,
                 (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
         max(90.0 + (l_extendedprice / l_quantity) % 20.0) AS high,
         min(90.0 + (l_extendedprice / l_quantity) % 20.0) AS low,
         arg_max(90.0 + (l_extendedprice / l_quantity) % 20.0,
                 (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

F4_SPARSE_MENTIONS = """
sentiment_results AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker,
         CAST(epoch(ts) AS BIGINT) AS created_utc,
         least(value / 50.0 - 1.0, 1.0) AS final_sentiment_score,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS normalized_upvotes,
         'neutral' AS final_sentiment_label,
         event_type AS subreddit
  FROM events)"""

EPOCH_DAY = "(DATE '1970-01-01' + CAST(floor(created_utc / 86400) AS INTEGER))"


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def rnd(expr: str, scale: int = 6) -> str:
    """Half-away-from-zero rounding snapped through DECIMAL (twin of ``stable_round``)."""
    return (f"(CASE WHEN isfinite({expr}) THEN CAST(CAST(CAST({expr} AS DECIMAL(38,{scale + 3})) "
            f"AS DECIMAL(38,{scale})) AS DOUBLE) ELSE {expr} END)")


def rounded(sql: str, cols: list[str], scale: int = 6) -> str:
    """Wrap ``sql`` so the listed double columns are rounded like the Spark side."""
    if not cols:
        return sql
    rep = ", ".join(f"{rnd(c, scale)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"


# ------------------------------------------------------------ daily (A2)
DAILY_WEIGHTED = f"""
daily AS (
  SELECT ticker, date,
         CASE WHEN total_upvotes = 0 THEN sentiment_median ELSE su / total_upvotes END AS sentiment_mean,
         total_upvotes, sentiment_median, mentions
  FROM (SELECT ticker, {EPOCH_DAY} AS date,
               sum(final_sentiment_score * normalized_upvotes) AS su,
               coalesce(sum(normalized_upvotes), 0) AS total_upvotes,
               median(final_sentiment_score) AS sentiment_median,
               count(final_sentiment_score) AS mentions
        FROM sentiment_results
        WHERE ticker IS NOT NULL AND created_utc IS NOT NULL
        GROUP BY 1, 2) AS a)"""


def shock_ctes(window_days=3, baseline_days=30, min_baseline=15, min_mentions=5,
               base_z=2.0, min_abs=0.1, sens=0.2, bias=0.0) -> list[str]:
    """Gap-filled calendar (generated and joined back) + windows + rule."""
    base = (f"baseline_std IS NOT NULL AND baseline_std > 0 AND window_sentiment IS NOT NULL "
            f"AND window_mentions >= {min_mentions} AND abs_sent_change >= {min_abs}")
    return [
        """span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM daily GROUP BY ticker)""",
        """cal AS (SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
                   FROM span)""",
        """filled AS (SELECT c.ticker, c.date, coalesce(d.mentions, 0) AS mentions, d.sentiment_mean,
                             d.total_upvotes, d.sentiment_median
                      FROM cal c LEFT JOIN daily d ON c.ticker = d.ticker AND c.date = d.date)""",
        f"""win AS (SELECT *, CAST(sum(mentions) OVER w3 AS DOUBLE) AS window_mentions,
                          sum(sentiment_mean * mentions) OVER w3 AS ws_sum
                   FROM filled
                   WINDOW w3 AS (PARTITION BY ticker ORDER BY date
                                 ROWS BETWEEN {window_days - 1} PRECEDING AND CURRENT ROW))""",
        """win2 AS (SELECT *, ws_sum / nullif(window_mentions, 0) AS window_sentiment FROM win)""",
        f"""base AS (SELECT *,
                     CASE WHEN count(window_sentiment) OVER wb >= {min_baseline}
                          THEN avg(window_sentiment) OVER wb END AS baseline_mean,
                     CASE WHEN count(window_sentiment) OVER wb >= {min_baseline}
                          THEN stddev_samp(window_sentiment) OVER wb END AS baseline_std
                   FROM win2
                   WINDOW wb AS (PARTITION BY ticker ORDER BY date
                                 ROWS BETWEEN {baseline_days - 1} PRECEDING AND CURRENT ROW))""",
        f"""zz AS (SELECT *, (window_sentiment - baseline_mean) / nullif(baseline_std, 0) AS z_score,
                         {base_z} / (1 + {sens} * ln(1 + greatest(window_mentions, 1.0))) AS z_threshold,
                         abs(window_sentiment - baseline_mean) AS abs_sent_change
                  FROM base)""",
        f"""sig AS (SELECT *,
                    CASE WHEN {base} AND z_score >= z_threshold - {bias} AND window_sentiment > 0 THEN 'BUY'
                         WHEN {base} AND z_score <= -(z_threshold + {bias}) AND window_sentiment < 0 THEN 'SELL'
                         ELSE 'NONE' END AS signal_type
                  FROM zz)""",
        """signals AS (SELECT date AS signal_date, ticker, sentiment_mean, total_upvotes, window_sentiment,
                              window_mentions, baseline_mean, baseline_std, z_score, signal_type,
                              CAST(CASE signal_type WHEN 'BUY' THEN 1 ELSE -1 END AS INTEGER) AS signal_direction,
                              z_score AS signal_score
                       FROM sig WHERE signal_type <> 'NONE')""",
    ]


SIGNAL_DOUBLES = ["sentiment_mean", "total_upvotes", "window_sentiment", "window_mentions",
                  "baseline_mean", "baseline_std", "z_score", "signal_score"]


# ------------------------------------------------------- market
def market_ctes(z=2.0, vol_exp=1.75, atr=2.0, recent=5, lookback=20, atr_days=14) -> list[str]:
    lb = f"ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW"

    def zs(c):
        return (f"CASE WHEN count({c}) OVER wl >= {lookback} THEN ({c} - avg({c}) OVER wl) "
                f"/ stddev_samp({c}) OVER wl END")
    hit = (f"coalesce(abs(pct_3d_z) >= {z}, false) OR coalesce(abs(ret_z) >= {z}, false) "
           f"OR coalesce(abs(vol_z) >= {z}, false) OR coalesce(vol_expansion >= {vol_exp}, false) "
           f"OR coalesce(atr_move >= {atr}, false)")
    return [
        """m1 AS (SELECT *, row_number() OVER w AS bar_n, lag(close, 1) OVER w AS prev_close,
                         lag(close, 3) OVER w AS close_3
                  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))""",
        """m2 AS (SELECT *, close / prev_close - 1 AS returns,
                         (close / close_3 - 1) * 100 AS pct_3d_series,
                         (close - close_3) / close_3 * 100 AS pct_change_3d,
                         greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr
                  FROM m1)""",
        f"""m3 AS (SELECT *, {zs('pct_3d_series')} AS pct_3d_z, {zs('returns')} AS ret_z,
                          {zs('volume')} AS vol_z,
                          (CASE WHEN count(returns) OVER w3 >= 3 THEN stddev_samp(returns) OVER w3 END)
                          / (CASE WHEN count(returns) OVER wl >= {lookback} THEN stddev_samp(returns) OVER wl END)
                            AS vol_expansion,
                          CASE WHEN count(tr) OVER wa >= {atr_days} THEN avg(tr) OVER wa END AS atr_14
                   FROM m2
                   WINDOW wl AS (PARTITION BY ticker ORDER BY date {lb}),
                          w3 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
                          wa AS (PARTITION BY ticker ORDER BY date
                                 ROWS BETWEEN {atr_days - 1} PRECEDING AND CURRENT ROW))""",
        """m4 AS (SELECT *, abs(close - close_3) / atr_14 AS atr_move FROM m3)""",
        f"""mkt AS (SELECT *, CAST(max(CASE WHEN {hit} THEN 1 ELSE 0 END) OVER w5 AS INTEGER)
                           AS market_moved_flag
                    FROM m4 WINDOW w5 AS (PARTITION BY ticker ORDER BY date
                                          ROWS BETWEEN {recent - 1} PRECEDING AND CURRENT ROW))""",
    ]


TRADING_DAY = "(signal_date - CAST(greatest(isodow(signal_date) - 5, 0) AS INTEGER))"
MARKET_COLS = ["pct_change_3d", "pct_3d_z", "ret_z", "vol_z", "vol_expansion", "atr_14", "atr_move"]

FILTERED_CTE = f"""
joined AS (
  SELECT s.*, {TRADING_DAY} AS target,
         {', '.join(rnd('m.' + c, 2) + ' AS ' + c for c in MARKET_COLS)},
         m.market_moved_flag, m.bar_n
  FROM signals s JOIN mkt m ON m.ticker = s.ticker AND m.date = {TRADING_DAY}),
filtered AS (
  SELECT signal_date, ticker, sentiment_mean, total_upvotes, window_sentiment, window_mentions,
         baseline_mean, baseline_std, z_score, signal_type, signal_direction, signal_score,
         strftime(target, '%Y-%m-%d') AS target_date,
         {', '.join(MARKET_COLS)}, market_moved_flag
  FROM joined
  WHERE bar_n >= 20 AND market_moved_flag = 0
    AND signal_date IS NOT NULL AND window_mentions >= 5 AND isfinite(z_score)
    AND signal_type IN ('BUY', 'SELL')
  QUALIFY row_number() OVER (PARTITION BY ticker, signal_date, signal_type
                             ORDER BY sentiment_mean, total_upvotes, window_sentiment) = 1)"""


# ------------------------------------------------------------ F1 mentions
WS = ("chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) "
      "|| ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) "
      "|| chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) "
      "|| chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)")
WS_RE = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
         r"\x{205F}\x{3000}]+")


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def blank(x: str) -> str:
    return (f"(CASE WHEN coalesce(lower({strip(x)}) IN ('', '[deleted]', '[removed]', 'nan'), true) "
            f"THEN '' ELSE {strip(x)} END)")


F1_RAW = """
conv AS (
  SELECT conv_id, turn, role AS author,
         CASE (conv_id * 3 + turn) % 8
              WHEN 0 THEN '[removed]' WHEN 1 THEN text || ' $CI ' WHEN 2 THEN text || ' DER.A QUE '
              WHEN 3 THEN text || ' https://ex.com/x ' WHEN 4 THEN text || ' [link](https://ex.com) '
              WHEN 5 THEN 'short' WHEN 6 THEN NULL ELSE text END AS body,
         CAST(1704067200 + conv_id * 3600 + turn * 60 AS BIGINT) AS created_utc,
         CAST(CASE WHEN conv_id % 7 IN (3, 5, 6) THEN 0 ELSE length(text) % 500 END AS BIGINT) AS score,
         'r' || CAST(conv_id % 5 AS VARCHAR) AS subreddit
  FROM conversations),
raw AS (
  SELECT 'post' AS type, 'c' || CAST(conv_id AS VARCHAR) AS id, substring(body, 1, 40) AS title, body,
         created_utc, score, subreddit, CAST(NULL AS VARCHAR) AS parent_post_id,
         CASE WHEN conv_id % 10 <> 7 THEN (conv_id % 10) / 10.0 END AS upvote_ratio
  FROM conv WHERE turn = 0
  UNION ALL
  SELECT 'comment', 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), NULL, body,
         created_utc, score, subreddit, 'c' || CAST(conv_id AS VARCHAR), NULL
  FROM conv WHERE turn > 0
  UNION ALL
  SELECT 'comment', 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), NULL, body,
         created_utc + 30, score, subreddit, 'c' || CAST(conv_id AS VARCHAR), NULL
  FROM conv WHERE turn > 0 AND conv_id % 10 = 0)"""

F1_CLEAN = f"""
blanked AS (SELECT type, id, {blank('title')} AS title,
                   {blank('body')} AS text, created_utc, score, subreddit, parent_post_id,
                   upvote_ratio
            FROM raw),
kept AS (SELECT * FROM blanked WHERE text <> '' OR (type = 'post' AND title <> '')),
merged AS (SELECT type, id, created_utc, score, subreddit, parent_post_id, upvote_ratio,
                  concat_ws('. ', CASE WHEN type = 'post' AND title NOT IN ('', 'nan') THEN title END,
                                  CASE WHEN type <> 'post' OR text NOT IN ('', 'nan') THEN text END) AS text
           FROM kept),
valid AS (SELECT * FROM merged
          WHERE {strip('text')} NOT IN ('[deleted]', '[removed]', '') AND length({strip('text')}) > 10),
dedup AS (SELECT * FROM valid
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN type = 'post' THEN 0 ELSE 1 END,
                                     created_utc DESC, text) = 1),
clean AS (SELECT *, CAST(score - min(score) OVER (PARTITION BY subreddit) AS DOUBLE)
                    / (max(score) OVER (PARTITION BY subreddit) - min(score) OVER (PARTITION BY subreddit) + 1e-6)
                      AS normalized_upvotes,
                 make_timestamp(created_utc * 1000000) AS ts
          FROM dedup)"""

# Ticker candidates with RE2 (no look-around): Unicode word boundaries are
# emulated by requiring a non-word neighbour; separators are doubled first so
# that a consumed neighbour never hides the next token.
W = r"[\pL\pN_]"
NW = r"[^\pL\pN_]"


def dbl(x: str) -> str:
    """Pad with spaces and double every whitespace character (never part of a token)."""
    return f"regexp_replace(' ' || {x} || ' ', '({WS_RE[:-1]})', '\\1\\1', 'g')"


F1_TICKERS_SQL = f"""
dim AS (SELECT unnest(['CI', 'DER', 'DER-A', 'QUE', 'OU', 'EN', 'LA', 'SS', 'LE', 'THE', 'OF', 'TO', 'IN'])
               AS ticker),
stop AS (SELECT DISTINCT upper(w) AS ticker FROM (SELECT unnest(['US', 'in', 'SS', 'ss', 'EUR']) AS w)),
english AS (SELECT unnest(string_split('{{ENGLISH}}', ' ')) AS word),
cands AS (
  SELECT id, upper(c) AS cand FROM clean,
         unnest(regexp_extract_all({dbl('text')}, '\\$([A-Za-z]{{1,5}}(?:[.-][A-Za-z]{{1,2}})?){NW}', 1)) AS t(c)
  UNION
  SELECT id, c FROM clean,
         unnest(regexp_extract_all({dbl('text')}, '{NW}([A-Z]{{2,5}}(?:[.-][A-Z]{{1,2}})?){NW}', 1)) AS t(c)
  WHERE c NOT IN (SELECT word FROM english)),
variants AS (
  SELECT id, cand, 0 AS pos, cand AS v FROM cands
  UNION ALL SELECT id, cand, 1, replace(cand, '.', '-') FROM cands WHERE contains(cand, '.')
  UNION ALL SELECT id, cand, 2, replace(cand, '-', '.') FROM cands WHERE contains(cand, '-')),
hits AS (SELECT id, cand, arg_min(v, pos) AS ticker FROM variants WHERE v IN (SELECT ticker FROM dim)
         GROUP BY id, cand),
own AS (SELECT id, list_sort(list_distinct(list(ticker))) AS t FROM hits
        WHERE ticker NOT IN (SELECT ticker FROM stop) GROUP BY id),
detected AS (SELECT c.*, coalesce(o.t, []) AS own_tickers FROM clean c LEFT JOIN own o USING (id)),
inherited AS (
  SELECT d.*, CASE WHEN p.own_tickers IS NOT NULL AND d.type = 'comment'
                   THEN list_sort(list_distinct(list_concat(d.own_tickers, p.own_tickers)))
                   ELSE d.own_tickers END AS mentioned_tickers
  FROM detected d LEFT JOIN (SELECT id, own_tickers FROM detected
                             WHERE type = 'post' AND len(own_tickers) > 0) p ON p.id = d.parent_post_id)"""


# All-caps words that are no symbols, stated again (not imported) so that a slip in either list shows;
# only words of 2 to 5 capitals matter.
ENGLISH = ("AFTER AGAIN ALL ALSO AM AN AND ANY ARE AS AT BACK BE BEAT BEEN BEING BEST BOTH BOY BUT BY CAME CAN COME COULD DID "
           "DOWN EA EACH EVEN EVERY FIND FIRST FOR FROM GET GIVE GO GOING GOOD GOT GREAT HAD HAS HAVE HE HER HERE HIM HOME HOW "
           "IN INTO IS IT ITS JUST KEEP KNOW LAST LE LEFT LET LIFE LIKE LONG LOOK MADE MAKE MAN MANY MAY MIGHT MORE MOST MOVE "
           "MUCH MUST NEED NEVER NEW NEXT NIGHT NO NOT NOW OF OLD ON ONLY OTHER OUR OUT OVER OWN PLACE PUT RIGHT SAID SAME SAY "
           "SEE SHE SINCE SO SOME STILL SUCH TAKE TAX THAN THAT THE THEM THERE THESE THEY THING THINK THIS THOSE TIME TO TOO TWO "
           "UNDER UP USE VERY WANT WAS WATER WAY WE WELL WENT WERE WHAT WHEN WHERE WHICH WHILE WHO WHY WILL WITH WORK WORLD WOULD "
           "WRITE YEAR YES YET YOU YOUNG YOUR")


def f1_tickers_sql() -> str:
    return F1_TICKERS_SQL.replace("{ENGLISH}", ENGLISH)


# ------------------------------------------------------------ F5 scores
# What each answer of F5 must parse to, worked out by hand: (label, score, route, clamped score).
K1_EXPECTED = (("positive", 0.8, "json", 0.8), ("negative", -0.45, "json", -0.45), ("neutral", 0.5, "json", 0.5),
               ("negative", -0.7, "regex", -0.7), ("neutral", 0.0, "default", 0.0), ("neutral", 0.0, "default", 0.0),
               ("neutral", 0.0, "default", 0.0), ("neutral", 0.05, "regex", 0.05), ("positive", 0.3, "regex", 0.3),
               ("negative", 1.0, "json", 1.0), ("positive", None, "json", None), ("negative", -3.0, "regex", -1.0))


def f5_cte() -> str:
    parts = ["vec_id", "'S' || CAST(vec_id % 10 AS VARCHAR) AS ticker",
             "DATE '2024-01-01' + CAST(vec_id % 30 AS INTEGER) AS date"]
    for j in range(4):
        # element i (from 1) belongs to logit (i - 1) mod 12; model j has logits 3j, 3j + 1, 3j + 2
        e = ["exp(8 * (" + " + ".join(f"CAST(embedding[{i}] AS DOUBLE)" for i in range(3 * j + k, 65, 12)) + "))"
             for k in (1, 2, 3)]
        tot = " + ".join(e)
        for name, x in zip(("p_neg", "p_neu", "p_pos"), e):
            parts.append(f"{x} / ({tot}) AS m{j}_{name}")
    return "f5 AS (SELECT " + ",\n  ".join(parts) + " FROM embeddings)"


def m4(j: int) -> dict[str, str]:
    n, u, p = f"m{j}_p_neg", f"m{j}_p_neu", f"m{j}_p_pos"
    return {"score": f"({p} - {n})",
            "label": f"(CASE WHEN {p} > {n} AND {p} > {u} THEN 'positive' "
                     f"WHEN {n} > {p} AND {n} > {u} THEN 'negative' ELSE 'neutral' END)",
            "confidence": f"greatest({p}, {u}, {n})"}


def k1(clamp: bool = False) -> dict[str, str]:
    def pick(k: int) -> str:
        values = ", ".join("NULL" if r[k] is None else repr(r[k]) if isinstance(r[k], str) else f"CAST({r[k]} AS DOUBLE)"
                           for r in K1_EXPECTED)
        return f"([{values}][CAST(vec_id % 12 AS INTEGER) + 1])"
    return {"label": pick(0), "score": pick(3 if clamp else 1), "route": pick(2)}


# ------------------------------------------------------------ report (demo)
def filtered_chain() -> list[str]:
    return [F2_SENTIMENT_RESULTS, DAILY_WEIGHTED, *shock_ctes(), F3_PRICE_BARS, *market_ctes(), FILTERED_CTE]


REPORT_HISTORY = f"""
anchors AS (SELECT DISTINCT ticker, signal_date AS end_date FROM filtered),
per_day AS (SELECT ticker, {EPOCH_DAY} AS date, avg(final_sentiment_score) AS sentiment_mean,
                   count(*) AS mentions, sum(normalized_upvotes) AS total_upvotes,
                   CASE WHEN count(final_sentiment_score) = 1 THEN 0.0
                        ELSE stddev_samp(final_sentiment_score) END AS sentiment_stddev
            FROM sentiment_results GROUP BY 1, 2),
hist0 AS (SELECT a.ticker, a.end_date, p.date, p.sentiment_mean, p.mentions, p.total_upvotes, p.sentiment_stddev
          FROM anchors a JOIN per_day p ON p.ticker = a.ticker AND p.date BETWEEN a.end_date - 30 AND a.end_date),
hist1 AS (SELECT *, sentiment_mean * mentions AS weighted_sentiment,
                 sum(sentiment_mean * mentions) OVER w3 / nullif(CAST(sum(mentions) OVER w3 AS DOUBLE), 0)
                   AS window_sentiment
          FROM hist0 WINDOW w3 AS (PARTITION BY ticker, end_date ORDER BY date
                                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
hist AS (SELECT h.*, f.baseline_mean, f.baseline_std, f.z_score, f.signal_type
         FROM hist1 h LEFT JOIN filtered f ON f.ticker = h.ticker AND f.signal_date = h.date)"""
