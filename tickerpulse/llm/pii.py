"""Personal data: pattern kinds plus bootstrapped contextual extraction.

Base kinds are found by fixed patterns and checks (``BASE``). They are then the seeds of a bootstrap
that finds identifiers no pattern describes:

* **Mentions.** Every seed, and every other token that could be an identifier (``CANDIDATE``: five or
  more digits), is a mention of an *instance* (its value) after one or two lexical *patterns* (the word
  before it, and the two words before it, lower-cased).
* **Pattern-instance graph.** Edges (pattern, instance) with their mention counts are a table. The
  number of times each pattern's words occur anywhere in the corpus, whatever follows, is counted over
  all documents.
* **Iteration.** A pattern's confidence is the share of its occurrences that precede an instance held
  for an identifier, each weighted by its score; it needs ``min_support`` distinct instances. An
  instance's score is the noisy-or of its accepted patterns' confidences; seeds score 1. Instances of
  score ``accept`` or more are held for identifiers in the next round, so patterns found late can find
  more. Confidences and scores only grow, and rounds go on until no pattern or instance is added and they
  stand still, so a chain of any length is followed. Words like "the" occur mostly before other words, and so never become patterns.
* **Discovery.** Mentions of held instances after an accepted pattern become spans of kind ``found``,
  unless they touch a base span.

Only DataFrame functions are used; seeds, patterns and scores stay in Spark tables, and what is joined
by pattern is pre-aggregated per (pattern, instance).

Defined results: a null text counts as empty and has no span; rows with repeated or null ids are
scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before_each, checkpointed, covered, keyed, kind_count, let, matches, of_kind, once, span_text, touches

# Fixed patterns. Possessive repeats keep what the plain ones match (nothing follows them that could
# take characters back) and make the matcher iterate instead of recursing on very long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BROADCAST_ROWS = 200_000
#: Relative growth of the summed confidences and scores from which on a round has changed nothing.
STILL = 1e-6
KINDS = ("email", "ip", "card", "phone")
#: A run of identifier characters with a digit; its value must hold five digits (checked afterwards).
CANDIDATE = r"(?<![\p{L}\p{N}./_+#@-])(?=[\p{L}./_+#@-]*+[0-9])[\p{L}\p{N}./_+#@-]{5,}+"
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "found": "[ID]"}


@dataclass(frozen=True)
class Bootstrap:
    min_support: int = 3
    min_confidence: float = 0.5
    accept: float = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # a part too large for an int casts to null
        return F.forall(F.split(value, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _context(before: Column, words: int) -> Column:
    """The last words of the 80 characters before a mention, lower-cased; null if there are fewer."""
    tail = F.regexp_replace(F.lower(F.substring(before, -80, 80)), r"[(\[{<\"'\x20\x09-\x0D]+$", "")
    own = F.filter(F.split(tail, r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0)
    return F.when(F.size(own) >= words, F.array_join(F.slice(own, -words, words), " "))


def _checked(found: Column, kind: str) -> Column:
    return F.filter(found, lambda m: _valid(kind, m["value"]))


def _as_mentions(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
        m["before"].alias("before")))


def _mentions(text: Column) -> Column:
    """array<struct<kind,start,end,value,before>> of base spans (kinds in order) and candidates."""
    out = []
    quick = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": None, "phone": text.contains("+")}
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        found = matches(text, pattern, quick[kind])
        if kind == "card":  # most numbers are short: the Luhn sum runs on the right lengths only
            found = _checked(found, kind)
            found = F.filter(found, lambda m: F.call_function("luhn_check", _digits(m["value"])))
        elif kind != "email":
            found = _checked(found, kind)
        out.append(_as_mentions(found, kind))
    other = matches(text, CANDIDATE, text.rlike(r"[0-9](?:[^0-9]*+[0-9]){4}"))
    other = F.transform(other, lambda m: F.struct(
        F.lit("found").alias("kind"), m["start"].alias("start"),
        (m["start"] + F.length(F.regexp_replace(m["value"], r"[./_+#@-]+$", ""))).alias("end"),
        F.regexp_replace(m["value"], r"[./_+#@-]+$", "").alias("value"), m["before"].alias("before")))
    out.append(F.filter(other, lambda m: F.length(_digits(m["value"])) >= 5))
    return F.concat(*out)


def mention_table(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(uid, doc_id, h, base, mentions)`` per row (``h``: hash of the text); texts are read once and not carried along.

    ``mentions`` is array<struct<kind,start,end,value,p1,p2>>; candidates that touch a base span are left out.
    """
    found = keyed(docs, text_col, id_col).select("uid", "doc_id", F.xxhash64("text").alias("h"), once(_mentions(F.col("text"))).alias("all"))
    found = found.select("uid", "doc_id", "h", "all", F.filter("all", lambda m: m["kind"] != "found").alias("base"))
    by_kind = F.array(*[let(of_kind(F.col("base"), k), covered) for k in KINDS])
    found = found.select("*", once(by_kind).alias("cover"))
    free = F.filter("all", lambda m: (m["kind"] != "found") | ~F.exists("cover", lambda c: touches(c, m)))
    return found.select("uid", "doc_id", "h", F.transform("base", lambda b: F.struct(
        b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))).alias("base"),
                        F.transform(free, lambda m: F.struct(
                            m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                            m["value"].alias("value"), _context(m["before"], 1).alias("p1"),
                            _context(m["before"], 2).alias("p2"))).alias("mentions"))


def graph_edges(mentions: DataFrame) -> DataFrame:
    """``(pattern, instance, seed, n)``: mentions pre-aggregated per pattern and instance."""
    one = mentions.select(F.explode("mentions").alias("m"))
    each = one.select(F.explode(F.array("m.p1", "m.p2")).alias("pattern"), F.col("m.value").alias("instance"),
                      (F.col("m.kind") != "found").alias("seed")).where("pattern IS NOT NULL")
    return each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))


def occurrences(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """``(pattern, total)``: how often each one- or two-word pattern stands before any word."""
    words = docs.select(once(F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+"),
                                      lambda w: F.length(w) > 0)).alias("w"))
    n = F.size("w")
    runs = words.where(n >= 2).select(once(F.concat(
        F.slice("w", F.lit(1), n - 1),
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.when(i > 1, F.concat_ws(
            " ", F.get("w", i - 2), F.get("w", i - 1)))))).alias("runs"))
    each = runs.select(F.explode("runs").alias("pattern")).where("pattern IS NOT NULL")
    if patterns.count() <= BROADCAST_ROWS:  # otherwise all contexts are counted before the join
        each = each.join(F.broadcast(patterns), "pattern", "left_semi")
    return each.groupBy("pattern").agg(F.count("*").alias("total")).join(patterns, "pattern", "left_semi")


def bootstrap(edges: DataFrame, totals: DataFrame, p: Bootstrap = Bootstrap()) -> tuple[DataFrame, DataFrame]:
    """``(pattern, confidence)`` of the accepted patterns and ``(instance, score)`` of the held instances.

    ``edges`` hold only patterns of ``totals``; both are checkpointed tables.
    """
    scores = edges.where("seed").select("instance").distinct().withColumn("score", F.lit(1.0))
    before = None
    while True:
        held = edges.join(scores, "instance")
        strength = held.groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("hits"),
                                               F.count("*").alias("support"))
        conf = strength.join(totals, "pattern", "left").withColumn(
            "confidence", F.col("hits") / F.greatest(F.coalesce("total", F.lit(0)), F.col("hits")))
        conf = conf.where((F.col("support") >= p.min_support) & (F.col("confidence") >= p.min_confidence))
        conf = checkpointed(conf.select("pattern", "confidence"))
        miss = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence"))))
        scores = edges.join(conf, "pattern").groupBy("instance").agg(
            F.max("seed").alias("seed"), (1 - F.exp(miss)).alias("noisy_or"))
        reached = scores.where((F.col("noisy_or") >= p.accept) & ~F.col("seed")).select("instance", F.col("noisy_or").alias("score"))
        seeds = edges.where("seed").select("instance").distinct().withColumn("score", F.lit(1.0))
        scores = checkpointed(seeds.unionByName(reached))
        now = (*conf.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first(),
               *scores.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first())
        if before and now[0] == before[0] and now[2] == before[2] and now[1] + now[3] - before[1] - before[3] <= STILL * (now[1] + now[3]):
            return conf, scores
        before = now


def find_personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                       params: Bootstrap = Bootstrap()) -> DataFrame:
    """``(uid, doc_id, h, base, spans)`` for every row: the hash of the text, the base spans, and all spans by kind and start.

    Both are array<struct<kind,start,end>> in code points, end exclusive.
    ``uid`` holds for this table alone.
    """
    mentions = checkpointed(mention_table(docs, text_col, id_col))
    edges = graph_edges(mentions)
    able = checkpointed(edges.groupBy("pattern").agg(F.count("*").alias("support"), F.max("seed").alias("seeded"))
                        .where(F.col("support") >= params.min_support).select("pattern"))
    edges = checkpointed(edges.join(able, "pattern", "left_semi"))
    totals = checkpointed(occurrences(docs, able, text_col))
    conf, scores = bootstrap(edges, totals, params)
    one = mentions.where(F.exists("mentions", lambda m: m["kind"] == "found")).select(
        "uid", F.explode(F.filter("mentions", lambda m: m["kind"] == "found")).alias("m"))
    one = one.select("uid", "m.start", "m.end", F.col("m.value").alias("instance"),
                     F.explode(F.array("m.p1", "m.p2")).alias("pattern"))
    hit = one.join(conf.select("pattern"), "pattern", "left_semi").join(scores.select("instance"), "instance", "left_semi")
    extra = hit.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct(
        F.lit("found").alias("kind"), "start", "end"))).alias("extra"))
    both = mentions.select("uid", "doc_id", "h", "base").join(extra, "uid", "left")
    spans = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    return both.select("uid", "doc_id", "h", "base", spans.alias("spans"))


_WIDE = "UTF-32"  # four bytes a code point, so that a slice needs no scan from the text's start


def wide(text: Column) -> Column:
    """The text behind one more character (a mark of byte order at its start is then text). Wrap it in ``once``."""
    return F.encode(F.concat(F.lit("x"), text), _WIDE)


def mask_spans(wide_text: Column, spans: Column) -> Column:
    """The text of ``wide`` with each span replaced by its kind's mark; of overlapping spans the earlier, then longer, counts."""
    marks = F.create_map(*(F.lit(x) for kv in MASK.items() for x in kv))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].cast("bigint").alias("start"), (-s["end"]).cast("bigint").alias("minus_end"), s["kind"].alias("kind"))))
    pieces = let(ordered, lambda own: let(before_each(F.transform(own, lambda s: -s["minus_end"]), F.lit(0), lambda a, b: F.greatest(a, b)), lambda at: F.transform(
        own, lambda s, i: F.when(s["start"] >= F.get(at, i), F.struct(
            F.get(at, i).alias("from"), (s["start"] - F.get(at, i)).alias("len"), F.element_at(marks, s["kind"]).alias("mark"))))))
    pieces = F.filter(pieces, lambda p: p.isNotNull())
    cut = lambda start, size: F.hex(F.substring(wide_text, (4 * start + 5).cast("int"), (4 * size).cast("int")))
    shown = F.array_join(F.transform(pieces, lambda p: F.concat(cut(p["from"], p["len"]), F.hex(F.encode(p["mark"], _WIDE)))), "")
    rest = cut(F.array_max(F.transform(spans, lambda s: s["end"].cast("bigint"))), F.length(wide_text).cast("bigint"))
    start = F.hex(F.encode(F.lit("x"), _WIDE))
    return F.substring(F.decode(F.unhex(F.concat(start, shown, rest)), _WIDE), F.lit(2), F.lit(2**31 - 1))


def mask_documents(docs: DataFrame, params: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` to match; no row goes.

    Rows meet their spans by (doc_id, hash of the text): spans follow from the text, so repeated
    rows share them. Only documents that have a span take part in the join's small side.
    """
    found = find_personal_data(docs.select("doc_id", "text"), params=params)
    masks = checkpointed(found.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("mask_id"), "h").agg(
        F.first("spans").alias("mask_spans")))
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(masks, docs["doc_id"].eqNullSafe(masks["mask_id"]) & (own == masks["h"]), "left")
    has = masks["mask_spans"].isNotNull()
    joined = joined.select(*[docs[c] for c in docs.columns], masks["mask_spans"].alias("__spans"),
                           once(F.when(has, wide(docs["text"]))).alias("__wide"))
    new = F.when(F.col("__spans").isNotNull(), mask_spans(F.col("__wide"), F.col("__spans"))).otherwise(F.col("text"))
    masked = joined.withColumn("text", new)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), size).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, the base digest and all spans as text."""
    counts = [kind_count("base", k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))
