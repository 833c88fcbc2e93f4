"""DuckDB SQL twins of the text rules X6 and X7 (RE2 has no look-around).

Every run of Unicode word characters is put in angle brackets first, so that a bracket is a word
boundary; a symbol is then a bracketed run of capitals or small letters, with its dollar sign or class
suffix outside the brackets. The stop-words are stated again, not imported.
"""

from __future__ import annotations

from . import oracle as O

WORD = r"[\pL\pM\pN\p{Pc}\x{200C}\x{200D}]"
_BLANK = r"[ \t\n\x0B\f\r]"
_INK = r"[^ \t\n\x0B\f\r]"
STOP = ("the a an and or but in on at to for of with by from as is are was were be been being have has had do does did will would could "
        "should may might must can this that these those i you he she it we they me my myself our ours ourselves your yours yourself "
        "yourselves him his himself her hers herself its itself them their theirs themselves what which who whom am having doing if "
        "because until while through during before after above below up down out off over under again "
        "further then once")


def bracketed(text: str) -> str:
    s = f"regexp_replace(coalesce({text}, ''), '\\[([^\\]]+)\\]\\(http[^) \\t\\n\\x0B\\f\\r]*\\)', '\\1', 'g')"
    s = f"regexp_replace({s}, 'http{_INK}+', ' ', 'g')"
    s = f"regexp_replace(translate({s}, '<>', '  '), '({WORD}+)', '<\\1>', 'g')"
    return f"replace({s}, '>$', '> ')"  # a dollar sign after a word character opens no cashtag


_SYMBOL = r"\$<[A-Za-z]{1,5}>(?:[.-]<[A-Za-z]{1,2}>)?|<[A-Za-z]{2,5}>(?:[.-]<[A-Za-z]{1,2}>)?"


def normalized(text: str, tickers: str | None) -> str:
    """X6; ``tickers`` is a list expression, or None for the compatibility mode."""
    inner = "translate(x, '<>', '')"
    symbol = f"regexp_full_match(x, '{_SYMBOL}')"
    keep = symbol if tickers is None else f"({symbol} AND (starts_with(x, '$') OR list_contains({tickers}, upper({inner}))))"
    plain = f"trim(lower(regexp_replace({inner}, '[^A-Za-z0-9_]+', ' ', 'g')))"
    token = f"CASE WHEN {keep} THEN upper({inner}) ELSE {plain} END"
    return (f"array_to_string(list_filter(list_transform(regexp_extract_all({bracketed(text)}, '{_SYMBOL}|<[^>]*>'), "
            f"lambda x: {token}), lambda y: y <> ''), ' ')")


def without_stopwords(text: str, tickers: str) -> str:
    """X7 with the row's symbols protected."""
    words = f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{O.WS_RE}'), lambda x: x <> '')"
    clean = f"lower(regexp_replace(x, '[^\\pL\\pM\\pN\\p{{Pc}}\\x{{200C}}\\x{{200D}}]', '', 'g'))"
    stop = "[" + ", ".join(f"'{w}'" for w in STOP.split()) + "]"
    return (f"array_to_string(list_filter({words}, lambda x: {clean} <> '' AND (list_contains({tickers}, upper(x)) "
            f"OR NOT list_contains({stop}, {clean}))), ' ')")


_WORDS = f"CAST(len(list_filter(regexp_split_to_array(text, '{O.WS_RE}'), lambda x: x <> '')) AS INTEGER)"


def text_views() -> str:
    detect = O.f1_tickers_sql().split("own AS")[0].rstrip().rstrip(",")
    return O.with_ctes("clean AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents)", detect,
                       "found AS (SELECT id, list_sort(list_distinct(list(ticker))) AS t FROM hits GROUP BY id)",
                       "every AS (SELECT c.id, c.text, coalesce(f.t, []) AS t FROM clean c LEFT JOIN found f USING (id))", body=f"""
SELECT id, {normalized('text', 't')} AS normalized, {normalized('text', None)} AS normalized_compat,
       {without_stopwords('text', 't')} AS without_stopwords, CAST(length(text) AS INTEGER) AS text_length, {_WORDS} AS word_count
FROM every""")


def preprocessed(date_name: str) -> str:
    return O.rounded(O.with_ctes(O.F1_RAW, O.F1_CLEAN, O.f1_tickers_sql(), body=f"""
SELECT * FROM (
  SELECT id, {normalized('text', 'mentioned_tickers')} AS sentiment_ready_text, type, subreddit, ts AS created_utc,
         CAST(CAST(normalized_upvotes AS FLOAT) AS DOUBLE) AS normalized_upvotes,
         array_to_string(mentioned_tickers, ',') AS mentioned_tickers, CAST(len(mentioned_tickers) AS SMALLINT) AS n_tickers,
         CAST(length(text) AS INTEGER) AS text_length, {_WORDS} AS word_count, CAST(ts AS DATE) AS {date_name},
         CAST(hour(ts) AS TINYINT) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week
  FROM inherited WHERE len(mentioned_tickers) > 0) WHERE sentiment_ready_text <> ''"""), ["normalized_upvotes"])
