"""Scoring stage: per-ticker rows (R1-R3), model inputs (X9, X10), the batched
classifier hook (F4), confidence routing (P10) and the second-model overwrite (J9).

No model ships with the library: the user passes a batch scorer. The hook runs
it with ``mapInPandas`` (Arrow batches; the scorer is built once per task via
``make_scorer``), so scoring scales with the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..functions.scores import route_by_confidence, score_from_probs
from ..functions.text import parse_ticker_list
from ..session import materialize
from ..sources.versions import ConcurrentPublish, VersionedTable

SCORE_FIELDS = "label string, score double, p_pos double, p_neu double, p_neg double"

DEFAULT_PROMPT = ("Rate the sentiment of this post about {ticker}. Reply with JSON holding "
                  "\"sentiment\" (Positive, Negative or Neutral) and \"score\" in [-1, 1].\n"
                  "Post: \"{text}\"\nJSON:")


def explode_tickers(df: DataFrame, col: str = "mentioned_tickers", keep_empty: bool = False) -> DataFrame:
    """R1 + R2 + R3: parse a list-or-CSV ticker column and emit one row per ticker.

    ``keep_empty`` keeps rows without tickers with a NULL ticker (explode_outer).
    """
    dt = df.schema[col].dataType.simpleString()
    lst = F.col(col) if dt.startswith("array") else parse_ticker_list(col)
    out = df.withColumn("_tickers", lst).withColumn("n_tickers", F.size("_tickers"))
    ex = F.explode_outer("_tickers") if keep_empty else F.explode("_tickers")
    return out.withColumn("ticker", ex).drop("_tickers")


def model_input(ticker="ticker", text="sentiment_ready_text") -> F.Column:
    """The classifier input string ``"{ticker}: {text}"``."""
    return F.concat(F.col(ticker), F.lit(": "), F.coalesce(F.col(text), F.lit("")))


def prompt_text(ticker="ticker", text="sentiment_ready_text", template: str = DEFAULT_PROMPT) -> F.Column:
    """A prompt from ``template`` ({ticker}, {text}) with the whole text; a model's
    length limit is the caller's business."""
    body = F.coalesce(F.col(text), F.lit(""))
    args = sorted([(template.find("{ticker}"), F.col(ticker)), (template.find("{text}"), body)],
                  key=lambda a: a[0])
    fmt = template.replace("%", "%%").replace("{ticker}", "%s").replace("{text}", "%s")
    return F.format_string(fmt, *[a for pos, a in args if pos >= 0])


def score_batches(df: DataFrame, make_scorer: Callable[[], Callable[[list[str]], list[dict]]],
                  text_col: str = "model_input", batch_size: int = 64,
                  prefix: str = "m_") -> DataFrame:
    """run a batch classifier over ``text_col``.

    ``make_scorer()`` is called once per task and returns ``fn(texts) -> list of
    {label, score, p_pos, p_neu, p_neg}``. A batch whose call raises gets
    ('neutral', 0.0) with NULL probabilities, and ``{prefix}failed`` is true for
    its rows, so they can be counted or scored again. Output columns are prefixed
    with ``prefix``.
    """
    pairs = [f.strip().split(" ") for f in SCORE_FIELDS.split(",")]
    fields = [name for name, _ in pairs]
    out_schema = StructType(list(df.schema.fields) + [
        StructField(prefix + name, StringType() if typ == "string" else DoubleType()) for name, typ in pairs]
        + [StructField(prefix + "failed", BooleanType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_scorer()
        for pdf in it:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            rows: list[dict] = []
            failed: list[bool] = []
            for i in range(0, len(texts), batch_size):
                chunk = texts[i:i + batch_size]
                try:
                    res = list(fn(chunk))
                    if len(res) != len(chunk):
                        raise ValueError("scorer returned a wrong number of results")
                except Exception:  # noqa: BLE001  (failed batch -> neutral default)
                    res = [{"label": "neutral", "score": 0.0} for _ in chunk]
                    failed.extend([True] * len(chunk))
                else:
                    failed.extend([False] * len(chunk))
                rows.extend(res)
            for f in fields:
                pdf[prefix + f] = [r.get(f) for r in rows]
            pdf[prefix + "failed"] = failed
            yield pdf

    return df.mapInPandas(run, out_schema)


SCORED = "scores"  # the part of a score table


def score_memoised(df: DataFrame, path: str, model: str, make_scorer: Callable[[], Callable[[list[str]], list[dict]]],
                   text_col: str = "model_input", batch_size: int = 64, prefix: str = "m_", attempts: int = 3) -> DataFrame:
    """F4 with a memory: every different text is scored once by ``model``, over all runs and rows.

    Results live in the versioned table at ``path`` by the SHA-256 of model name and text. Only texts that it lacks are
    scored (once each), and published together when they are done, so a run that is killed leaves the table as
    it was and one that is repeated scores nothing. Batches that fail are tried ``attempts`` times, each
    time in smaller batches, so that one bad text does not take its neighbours along; what still fails is not stored:
    its rows get ('neutral', 0.0) and ``{prefix}failed``, and the next run tries again. A null text counts as empty.
    """
    spark = df.sparkSession
    table = VersionedTable(spark, path)
    fields = [f.strip().split(" ")[0] for f in SCORE_FIELDS.split(",")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.lit(model + "\n"), text), 256)
    store = _stored(table)
    asked = df.select(key.alias("_key")).distinct()
    lacking = materialize(asked if store is None else asked.join(store.select("_key"), "_key", "left_anti"))
    # only texts that are to be scored move, once each
    todo = materialize(df.select(key.alias("_key"), text.alias("_text")).join(lacking, "_key", "left_semi").dropDuplicates(["_key"]))
    done = []
    for attempt in range(attempts):
        if todo.isEmpty():
            break
        scored = materialize(score_batches(todo, make_scorer, "_text", max(1, batch_size // 8 ** attempt), prefix=""))
        done.append(scored.where("NOT failed").select("_key", *fields))
        todo = scored.where("failed").select("_key", "_text")
    if done:
        new = done[0]
        for part in done[1:]:
            new = new.unionByName(part)
        _append(table, new)
        store = _stored(table)
    found = df.withColumn("_key", key)
    if store is None:
        store = spark.createDataFrame([], "_key string, " + SCORE_FIELDS)
    named = store.select("_key", F.lit(True).alias("_known"), *[F.col(f).alias(prefix + f) for f in fields])
    out = found.join(named, "_key", "left")
    known = F.col("_known").isNotNull()
    neutral = {"label": F.lit("neutral"), "score": F.lit(0.0)}
    for f, v in neutral.items():
        out = out.withColumn(prefix + f, F.when(known, F.col(prefix + f)).otherwise(v))
    return out.withColumn(prefix + "failed", ~known).drop("_key", "_known")


def _stored(table: VersionedTable) -> DataFrame | None:
    """One row per key (two runs at once may have scored the same text)."""
    rows = table.read()
    return None if rows is None else rows.dropDuplicates(["_key"])


def _append(table: VersionedTable, rows: DataFrame) -> None:
    """Publish ``rows`` beside what the table holds, also what another run publishes meanwhile."""
    (folders,) = table.write(rows).values()
    while True:
        base = table.manifest()
        held = base.parts[SCORED] if base else []
        try:
            table.publish(base, rows.schema, {SCORED: held + folders})
            return
        except ConcurrentPublish:
            continue


def with_model_scores(df: DataFrame, p_neg="p_neg", p_neu="p_neu", p_pos="p_pos", prefix: str = "tw_") -> DataFrame:
    """M4 applied to probability columns: ``{prefix}score``, ``label``, ``confidence``."""
    s = score_from_probs(p_neg, p_neu, p_pos)
    return (df.withColumn(prefix + "score", s["score"])
              .withColumn(prefix + "label", s["label"])
              .withColumn(prefix + "confidence", s["confidence"]))


def hybrid_results(df: DataFrame, second: DataFrame, key: str = "row_id",
                   drop_below: float | None = 0.50, second_below: float = 0.65,
                   first_name: str = "RoBERTa", second_name: str = "LLM") -> DataFrame:
    """P10 + J9: route by the first model's confidence and let the second model's
    (label, score) overwrite the routed rows; ``source_model`` names the winner.

    ``df`` carries tw_score / tw_label / tw_confidence; ``second`` carries
    (key, label, score) for the rows it scored (any superset is fine).
    """
    routed = df.withColumn("route", route_by_confidence("tw_confidence", drop_below, second_below))
    routed = routed.filter(F.col("route") != "drop")
    s = second.select(F.col(key).alias("_k"), F.col("label").alias("_l2"), F.col("score").alias("_s2"))
    j = routed.join(s, routed[key] == s["_k"], "left")
    use2 = (F.col("route") == "second") & F.col("_k").isNotNull()
    return (j.withColumn("final_sentiment_label", F.when(use2, F.col("_l2")).otherwise(F.col("tw_label")))
             .withColumn("final_sentiment_score", F.when(use2, F.col("_s2")).otherwise(F.col("tw_score")))
             .withColumn("source_model", F.when(use2, F.lit(second_name)).otherwise(F.lit(first_name)))
             .drop("_k", "_l2", "_s2"))
