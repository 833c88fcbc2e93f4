"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

RUN = 64
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: cuts lineage and survives lost executors."""
    return materialize(df)


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(uid, doc_id, text)`` only, so further columns of any name cannot clash.

    ``uid`` tells repeated and null ids apart. It is stable only below a checkpoint:
    checkpoint what is derived from it before joining on it.
    """
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def once(value: Column) -> Column:
    """``value`` behind a one-row generator.

    Catalyst moves filters (also those it infers from joins and explodes) below projections by copying
    the projected expressions into them. For a costly expression, and worse for one inside a lambda,
    that would evaluate it again and again; nothing is moved below a generator.
    """
    return F.explode(F.array(value))


def matches(text: Column, pattern: str, present: Column | None = None) -> Column:
    """All leftmost, non-overlapping matches of a Java ``pattern`` with their places.

    array<struct<start,end,value,before>> in code points, end exclusive; ``before`` is the text
    between the previous match and this one. ``split`` and ``regexp_extract_all`` walk the same
    matches, so pieces and values alternate. ``present`` is a cheap test that rules a text out.
    The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(found, pieces, lambda m, p: F.struct(
        p.alias("before"), m.alias("value"), F.length(p).cast("long").alias("gap"),
        F.length(m).cast("long").alias("len")))
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())
    placed = let(pairs, lambda ps: let(before_each(F.transform(ps, lambda x: x["gap"] + x["len"]), F.lit(0), lambda a, b: a + b), lambda at: F.transform(
        ps, lambda x, i: F.struct((F.get(at, i) + x["gap"]).alias("start"), (F.get(at, i) + x["gap"] + x["len"]).alias("end"),
                                  x["value"].alias("value"), x["before"].alias("before")))))
    has = text.rlike(pattern) if present is None else present & text.rlike(pattern)
    return F.coalesce(F.when(has, placed), F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For every element, ``join`` (a sum, a maximum) of the elements before it; ``values`` is array<bigint>.

    ``aggregate`` copies its accumulator at every step, so one that gathers an array takes quadratic time. Here every
    element joins the ones before it in its block of ``RUN``, the blocks before that in its block of blocks, and
    the blocks of blocks before that: three short runs for up to hundreds of thousands of elements.
    """
    start = zero.cast("bigint")
    total = lambda part: F.aggregate(part, start, join)
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda b: total(F.slice(a, b * RUN + 1, F.lit(RUN))))

    def within(a: Column, outer: Callable[[Column], Column]) -> Column:
        """For every element of ``a``: what ``outer`` gives for its block, and the elements before it in the block."""
        return F.transform(a, lambda _, i: let(F.floor(i / RUN).cast("int"), lambda b: join(outer(b), total(F.slice(a, b * RUN + 1, i - b * RUN)))))

    def long(a: Column) -> Column:
        return let(blocks(a), lambda one: let(blocks(one), lambda two: let(
            F.transform(two, lambda _, i: total(F.slice(two, F.lit(1), i))), lambda before_two: let(
                within(one, lambda b: F.get(before_two, b)), lambda before_one: within(a, lambda b: F.get(before_one, b))))))

    return let(values, lambda a: F.when(F.size(a) <= RUN, F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i)))).otherwise(long(a)))


def covered(spans: Column) -> Column:
    """A byte per code point up to the last span's end: 1 inside a span, 0 outside; for spans of one kind, which follow
    one another. Wrap it in ``once`` before a lambda."""
    return F.array_join(F.transform(spans, lambda s, i: F.concat(
        F.repeat(F.lit("0"), (s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))).cast("int")),
        F.repeat(F.lit("1"), (s["end"] - s["start"]).cast("int")))), "").cast("binary")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def touches(cover: Column, span: Column) -> Column:
    """Whether ``span`` shares a place with the spans that ``cover`` was made of."""
    own = F.substring(cover, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
    return F.contains(own, F.lit("1").cast("binary"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span in the given order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def kind_count(spans: str, kind: str) -> Column:
    return F.size(of_kind(F.col(spans), kind)).cast("long").alias(f"n_{kind}")
