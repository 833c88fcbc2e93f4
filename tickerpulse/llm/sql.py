"""DuckDB SQL for the queries of this subpackage that SQL can express, written from their rules."""

OP1 = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pM\pN]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pM\pN]+') AS w FROM benchmark),
doc_shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
                 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc_words WHERE len(w) > 0)),
item_shingles AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
                  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, CAST(n AS INTEGER) AS n_shingles, count(*) / n AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING 10 * count(*) >= 8 * n
"""

_PHRASES = ("cookie", "all rights reserved", "terms of use", "terms of service", "privacy policy", "sign in", "sign up", "log in",
            "click here", "read more", "subscribe", "newsletter", "enable javascript", "share this", "follow us", "back to top",
            "skip to content")

OP4 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
doc_words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
            FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
                  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc_words WHERE len(w) >= 3))),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM docs),
lines AS (SELECT doc_id, place, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
                 row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1 AS again
          FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
parts AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS clean, list_sum(list_transform(w, lambda x: length(x))) AS chars,
                 len(list_filter(w, lambda x: x IN ('|', '||', '»', '«', '›', '•', '·', '>', '>>', '/', '-'))) AS bars,
                 len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS marked,
                 len(list_filter(w, lambda x: ends_with(x, '!!') OR (length(x) > 1 AND upper(x) = x AND lower(x) <> x))) AS loud
          FROM lines),
judged AS (SELECT *, CASE WHEN bars >= greatest(2, 0.2 * n) THEN 'navigation'
                          WHEN marked > 0.2 * n THEN 'punctuation'
                          WHEN n >= 5 AND loud > 0.5 * n THEN 'punctuation'
                          WHEN n >= 25 AND NOT regexp_matches(clean, '[.!?…。！？。؟।:;,]') THEN 'punctuation'
                          WHEN again OR (n >= 10 AND len(list_distinct(w)) < 0.2 * n) THEN 'boilerplate'
                          WHEN n <= 15 AND regexp_matches(lower(clean), '{"|".join(_PHRASES)}') THEN 'boilerplate' ELSE '' END AS fault
           FROM parts),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE fault <> ''), 0) AS lost_chars,
                  count(*) FILTER (WHERE fault = 'punctuation') AS n_punctuation, count(*) FILTER (WHERE fault = 'navigation') AS n_navigation,
                  count(*) FILTER (WHERE fault = 'boilerplate') AS n_boilerplate FROM judged GROUP BY doc_id),
every AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars,
                 coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate
          FROM doc_words LEFT JOIN by_doc USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, base_failed = false AND lost_chars <= 0.5 * word_chars AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM every)
"""
