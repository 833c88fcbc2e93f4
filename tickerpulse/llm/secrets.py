"""Secrets: pattern kinds plus multipart credential linking.

Base kinds (``ASSIGN``, ``ACCESS``, ``HEX``) are reported wherever they stand. A credential often has
several parts that mean little alone, so weaker parts are gathered as well:

* **identifiers**: access keys (base), and values named like a user, client, account or key id;
* **secrets**: assigned secrets and hex runs (base), values named like a pass phrase or private part, and
  mixed runs of 20 or more key characters;
* **endpoints**: URLs with a scheme, and host names after ``host``, ``endpoint`` or ``server``.

Parts are linked by an interval join inside a document: two parts are in one scope if the gap between
them is at most ``scope`` characters. A weak part is reported (kinds ``weak_id``, ``weak_secret``,
``endpoint``) only if a complement stands in its scope: an identifier needs a secret, a secret an
identifier or an endpoint, an endpoint a secret that has an identifier in its own scope or is a base
one. The join is by blocks of ``scope + 1`` characters, so that a gap of ``scope`` is at most one block
away: every block keeps, for each role, only the
outermost places, and a part looks into its own and the two neighbouring blocks. So a document with many
parts makes rows in proportion to them, not pairs.

Only DataFrame functions are used. Defined results: a null text counts as empty and has no span;
repeated rows and null ids are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, covered, keyed, kind_count, let, matches, of_kind, once, span_text, touches

# fixed patterns
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
# weak parts
WEAK_ID = (r"(?i:(?<![a-z0-9])(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?|key_?id)"
           r"""["']?\x20*[:=]\x20*["']?[a-z0-9@._+-]{3,}+)""")
WEAK_NAMED = (r"(?i:(?<![a-z0-9])(?:pass|pwd|passphrase|credential|auth|signature|private_?key)"
              r"""["']?\x20*[:=]\x20*["']?[a-z0-9+/_.=!@#$%^&*-]{4,}+)""")
WEAK_RUN = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=-]*+[0-9])(?=[^A-Z\x20\x09-\x0D]*+[A-Z])(?=[^a-z\x20\x09-\x0D]*+[a-z])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = (r"""(?i:(?<![a-z0-9])(?:[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D"'<>]++"""
            r"""|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9-]++(?:\.[a-z0-9-]++)++(?::[0-9]{2,5})?))""")
WEAK_KINDS = ("weak_id", "weak_secret", "endpoint")
_SPAN = "array<struct<start:bigint,kind:string,end:bigint>>"


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> of the base kinds, kind by kind."""
    lower = F.lower(text)
    named = (lower.contains("password") | lower.contains("passwd") | lower.contains("secret") | lower.contains("token")
             | lower.contains("apikey") | lower.contains("api_key"))
    assign = F.filter(matches(text, ASSIGN, named), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 6)
    access = F.filter(matches(text, ACCESS, text.contains("AKIA")), lambda m: F.length(m["value"]) >= 20)
    # a match is a whole run, so runs that are too short may as well be left out of the pattern
    long_hex = matches(text, r"(?<![0-9a-f])[0-9a-f]{24,}+")
    return F.concat(_spans(assign, "assign"), _spans(access, "access"), _spans(long_hex, "hex"))


def weak_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> of weak parts, linked or not."""
    assigned = text.rlike(r"[:=]")
    return F.concat(_spans(matches(text, WEAK_ID, assigned), "weak_id"),
                    _spans(matches(text, WEAK_NAMED, assigned), "weak_secret"),
                    _spans(matches(text, WEAK_RUN), "weak_secret"),
                    _spans(matches(text, ENDPOINT, text.contains("://") | text.contains(".")), "endpoint"))


def _order(spans: Column, ranks: tuple[str, ...]) -> Column:
    """By start, then kind as listed."""
    names = F.array(*map(F.lit, ranks))
    keyed_spans = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(names, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed_spans), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def linked_parts(rows: DataFrame, scope: int = 400) -> DataFrame:
    """``(uid, start, kind, end)`` of the weak parts of ``rows(uid, base, weak)`` that have complements."""
    part = rows.where(F.size("weak") > 0).select("uid", F.explode(F.concat("base", "weak")).alias("p")).select("uid", "p.*")
    role = (F.when(F.col("kind").isin("access", "weak_id"), "id").when(F.col("kind") == "endpoint", "endpoint")
            .otherwise("secret"))
    size = scope + 1
    part = part.select("*", role.alias("role"), F.floor(F.col("start") / size).alias("first"), F.floor((F.col("end") - 1) / size).alias("last"))

    def near(asked: DataFrame, offered: DataFrame, role_name: str) -> DataFrame:
        """``asked`` rows that have an offered part at most ``scope`` characters away."""
        # a part covers blocks first..last and is seen from one block further on either side
        seen = offered.select("uid", "start", "end", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("block"))
        at = seen.select("uid", "block", "start", "end")
        # nearest part wholly before / after a place need only the outermost ends of the block
        reach = at.groupBy("uid", "block").agg(
            F.max(F.when(F.floor((F.col("end") - 1) / size) <= F.col("block") - 1, F.col("end"))).alias("left_end"),
            F.min(F.when(F.floor(F.col("start") / size) >= F.col("block") + 1, F.col("start"))).alias("right_start"),
            F.max((F.floor(F.col("start") / size) <= F.col("block")) & (F.floor((F.col("end") - 1) / size) >= F.col("block"))).alias("inside"))
        looked = asked.withColumn("block", F.explode(F.sequence("first", "last")))
        hit = looked.join(reach, ["uid", "block"]).where(
            F.col("inside") | (F.col("start") - F.col("left_end") <= scope) | (F.col("right_start") - F.col("end") <= scope))
        return hit.select("uid", "start", "kind", "end").distinct()

    ids, secrets, ends = (part.where(F.col("role") == r) for r in ("id", "secret", "endpoint"))
    strong = F.col("kind").isin(*KINDS)
    key = ["uid", "start", "kind", "end"]
    id_hit = near(ids.where(~strong), secrets, "secret")
    with_id = near(secrets, ids, "id")
    with_end = near(secrets, ends, "endpoint")
    full = secrets.join(with_id, key, "left_semi").unionByName(secrets.where(strong)).distinct()
    end_hit = near(ends, full, "secret")
    weak_secret = with_id.unionByName(with_end).where(~strong)
    return id_hit.unionByName(weak_secret).unionByName(end_hit).distinct()


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = 400) -> DataFrame:
    """``(uid, doc_id, base, spans)`` for every row: base spans and all spans, by start, then kind.

    Spans are array<struct<kind,start,end>> in code points, end exclusive; ``uid`` holds for this table alone.
    """
    text = F.col("text")
    rows = keyed(docs, text_col, id_col).select("uid", "doc_id", once(F.struct(base_spans(text).alias("base"), weak_spans(text).alias("weak"))).alias("s"))
    rows = rows.select("uid", "doc_id", "s.base", "s.weak")
    by_kind = F.array(*[let(of_kind(F.col("base"), k), covered) for k in KINDS])
    rows = rows.select("*", once(by_kind).alias("cover"))
    rows = checkpointed(rows.withColumn("weak", F.filter("weak", lambda w: ~F.exists("cover", lambda c: touches(c, w)))).drop("cover"))
    extra = linked_parts(rows, scope).groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    joined = rows.select("uid", "doc_id", "base").join(extra, "uid", "left")
    every = F.concat("base", F.coalesce("extra", F.array().cast(_SPAN)))
    return joined.select("uid", "doc_id", _order(F.col("base"), KINDS).alias("base"),
                         _order(every, KINDS + WEAK_KINDS).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, the base digest and all spans as text."""
    counts = [kind_count("base", k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))
