"""Class-probability and model-output Column functions (M4, M5, M6, K1, P10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def score_from_probs(p_neg, p_neu, p_pos) -> dict[str, Column]:
    """M4: score = p_pos - p_neg; label = strict argmax (any tie -> 'neutral');
    confidence = max probability."""
    n, u, p = col(p_neg), col(p_neu), col(p_pos)
    label = (F.when((p > n) & (p > u), "positive")
              .when((n > p) & (n > u), "negative")
              .otherwise("neutral"))
    return {"score": p - n, "label": label, "confidence": F.greatest(p, u, n)}


def label_first_max(probs: list[tuple[str, Column | str]]) -> Column:
    """M5: argmax over (label, probability) pairs in the given order; the first
    maximum wins, a missing (NULL) probability counts as 0."""
    vals = [(lab, F.coalesce(col(c), F.lit(0.0))) for lab, c in probs]
    best = F.greatest(*[v for _, v in vals])
    out = None
    for lab, v in vals:
        out = F.when(v == best, F.lit(lab)) if out is None else out.when(v == best, F.lit(lab))
    return out


def ensemble_stats(cols: list) -> dict[str, Column]:
    """M6: row-wise mean, sample variance and sample std over model scores, NULLs skipped."""
    arr = F.filter(F.array(*[col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    n = F.size(arr)
    mean = F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), n.cast("double"))
    ss = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    var = F.when(n >= 2, ss / (n - 1))
    return {"mean": F.when(n > 0, mean), "variance": var, "std": F.sqrt(var)}


def route_by_confidence(conf, drop_below: float | None = 0.50, second_below: float = 0.65) -> Column:
    """P10: 'drop' (conf < drop_below), 'second' (conf < second_below) or 'keep'.

    ``drop_below=None`` is the no-drop variant: everything under
    ``second_below`` goes to the second model.
    """
    c = col(conf)
    r = F.when(c < second_below, "second").otherwise("keep")
    if drop_below is not None:
        r = F.when(c < drop_below, "drop").otherwise(r)
    return r


# Fixed value: the score fallback pattern.
_SCORE_RE = r"score\":\s*(-?0\.\d+|1\.0|-1\.0|-?\d+)"


def parse_model_response(c, clamp: bool = False) -> dict[str, Column]:
    """K1: (label, score) from a generative model's text answer.

    1. The greedy first ``{...}`` span, if it is exactly one JSON object by strict
       rules: ``sentiment`` (a string, lower-cased; 'neutral' if absent) and ``score``
       (a number, a numeric string, or a truth value as 1 or 0; 0.0 if absent; NaN
       becomes NULL). Any other type of either makes the JSON route fail.
    2. Otherwise the first ``score": <number>`` in the text gives the score
       (clamped to [-1, 1] when ``clamp``) and the label by +-0.1.
    3. Otherwise ('neutral', 0.0).
    """
    t = F.coalesce(col(c), F.lit(""))
    js = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    # inside brackets, text after the object or a second object is an error or a second element
    parsed = F.try_parse_json(F.concat(F.lit("["), js, F.lit("]")))
    one = F.try_variant_get(parsed, "$[0]", "variant").isNotNull() & F.try_variant_get(parsed, "$[1]", "variant").isNull()
    kind = lambda field: F.schema_of_variant(F.try_variant_get(parsed, f"$[0].{field}", "variant"))
    value = lambda field, to: F.try_variant_get(parsed, f"$[0].{field}", to)
    sent_kind, score_kind = kind("sentiment"), kind("score")
    score_num = (F.when(score_kind == "BOOLEAN", value("score", "boolean").cast("double"))
                  .when(score_kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), value("score", "double"))
                  .when(score_kind == "STRING", F.btrim(value("score", "string")).try_cast("double")))
    json_ok = (F.coalesce(one, F.lit(False))
               & F.coalesce(sent_kind == "STRING", F.lit(True))
               & (score_kind.isNull() | score_num.isNotNull()))
    j_label = F.lower(F.when(sent_kind.isNotNull(), value("sentiment", "string")).otherwise(F.lit("Neutral")))
    j_score = F.when(score_kind.isNull(), F.lit(0.0)).otherwise(F.nanvl(score_num, F.lit(None).cast("double")))
    rx = F.regexp_extract(t, _SCORE_RE, 1)
    rx_ok = rx != ""
    rx_val = rx.try_cast("double")
    rx_label = F.when(rx_val > 0.1, "positive").when(rx_val < -0.1, "negative").otherwise("neutral")
    rx_score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rx_val)) if clamp else rx_val
    label = F.when(json_ok, j_label).when(rx_ok, rx_label).otherwise(F.lit("neutral"))
    score = F.when(json_ok, j_score).when(rx_ok, rx_score).otherwise(F.lit(0.0))
    route = F.when(json_ok, "json").when(rx_ok, "regex").otherwise("default")
    return {"label": label, "score": score, "route": route}
