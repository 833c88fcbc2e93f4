"""Quality rules, line first.

Every line with a word is judged by three rules, failing lines are removed, and a document that
loses too much of its text is rejected:

* **punctuation**: prose carries sentence marks. A line fails if many of its words carry a symbol
  of ``#*$%&|<>``, if many of its words are shouted (all capitals or ending in ``!!``), or if it has
  ``list_words`` or more words and no sentence mark at all.
* **navigation**: a line fails if separators (a word that is only ``|``, a guillemet, a bullet or a
  middle dot) make up a good part of its words, so it is a menu or link bar.
* **boilerplate**: a line fails if it is short and holds a site phrase (cookie notice, sign-in and so
  on), if it has ``loop_words`` or more words but hardly any different ones, or if it repeats
  a line above it.

Beside the verdict, document-level base counts are given (see ``COUNTS``); a document with
fewer than ``min_words`` words, or with over half of its words inside repeated 3-word windows, fails
the base test whatever its lines are like.

Defined results: a null text counts as empty; an empty text has no words, fails the base test and is
not kept; repeated rows are judged one by one; a null id stays null; texts of any length are read
whole; further input columns never clash with the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SEPARATORS = frozenset({"|", "||", "»", "«", "›", "•", "·", ">", ">>", "/", "-"})
PHRASES = ("cookie", "all rights reserved", "terms of use", "terms of service", "privacy policy",
           "sign in", "sign up", "log in", "click here", "read more", "subscribe", "newsletter",
           "enable javascript", "share this", "follow us", "back to top", "skip to content")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")
_SENTENCE = re.compile("[.!?…。！？。؟।:;,]")


@dataclass(frozen=True)
class LineRules:
    """Thresholds; all shares are of a line's words, ``max_loss`` of a document's word characters."""
    symbol_share: float = 0.2
    shout_share: float = 0.5
    shout_words: int = 5
    list_words: int = 25
    separator_share: float = 0.2
    phrase_words: int = 15
    loop_words: int = 10
    loop_share: float = 0.2
    max_loss: float = 0.5
    min_words: int = 50
    repeat_percent: int = 50


def line_fault(words: list[str], seen: bool, r: LineRules) -> str:
    """The rule that the line breaks (``""``: none). ``seen``: an equal line stands above."""
    n, line = len(words), " ".join(words)
    if sum(w in SEPARATORS for w in words) >= max(2, r.separator_share * n):
        return "navigation"
    if len(_SYMBOL.findall(line)) and sum(1 for w in words if _SYMBOL.search(w)) > r.symbol_share * n:
        return "punctuation"
    if n >= r.shout_words and sum(w.endswith("!!") or (len(w) > 1 and w.isupper()) for w in words) > r.shout_share * n:
        return "punctuation"
    if n >= r.list_words and not _SENTENCE.search(line):
        return "punctuation"
    if seen or (n >= r.loop_words and len(set(words)) < r.loop_share * n):
        return "boilerplate"
    if n <= r.phrase_words and _PHRASE.search(line.lower()):
        return "boilerplate"
    return ""


def repeated_window_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first finding included."""
    if len(words) < 4:
        return 0
    codes, names = pd.factorize(np.array(words, dtype=object))
    pair = codes[:-1].astype(np.int64) * len(names) + codes[1:]
    pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1].astype(np.int64) * len(names) + codes[2:]
    _, which, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[which] > 1
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[k:len(words) - 2 + k] |= twice
    return int(marked.sum())


ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
COUNTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
          "n_repeat_words": "long", "lost_chars": "long", "n_punctuation": "long", "n_navigation": "long",
          "n_boilerplate": "long", "base_failed": "boolean", "kept": "boolean", "clean_text": "string"}


def judge(text: str | None, rules: LineRules) -> tuple:
    """One document's values in the order of ``COUNTS``."""
    text = text or ""
    words = text.encode().split()
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    repeats = repeated_window_words(words)
    faults = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    seen: set[str] = set()
    kept_lines, lost, dups = [], 0, 0
    for line in text.split("\n"):
        own = [w for w in re.split("[\x20\x09-\x0D]+", line) if w]
        if not own:
            kept_lines.append(line)
            continue
        again = line in seen
        dups += again
        seen.add(line)
        fault = line_fault(own, again, rules)
        if fault:
            faults[fault] += 1
            lost += sum(map(len, own))
        else:
            kept_lines.append(line)
    base = len(words) < rules.min_words or 100 * repeats > rules.repeat_percent * len(words)
    return (len(words), word_chars, sum(text.count(c) for c in SYMBOLS), dups, repeats, lost,
            faults["punctuation"], faults["navigation"], faults["boilerplate"], base,
            not base and lost <= rules.max_loss * word_chars, "\n".join(kept_lines))


def apply_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                rules: LineRules = LineRules()) -> DataFrame:
    """``doc_id`` and the columns of ``COUNTS`` for every row; no shuffle, rows stream in Arrow batches."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [judge(t, rules) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([v[i] for v in verdicts], ARROW[kind])
                                           for i, kind in enumerate(COUNTS.values()))], ["doc_id", *COUNTS])

    return narrow.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{k} {v}" for k, v in COUNTS.items()))


def keep_good(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with their failing lines removed and ``n_chars`` to match.

    All other columns of ``docs`` are returned as they were, rows of rejected documents go.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [judge(t, rules) for t in batch.column("text").to_pylist()]
            cols = dict(zip(batch.schema.names, batch.columns))
            cols["text"] = pa.array([v[-1] for v in verdicts], cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(v[-1]) for v in verdicts], cols["n_chars"].type)
            out = pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
            yield out.filter(pa.array([v[-2] for v in verdicts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
