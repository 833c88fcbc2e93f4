"""Long texts with many matches, masking of any character, and pages whose attributes mislead."""

import itertools
import re
import time

import pytest
from pyspark.sql import functions as F

from tickerpulse.llm import common, html_text, pii, quality_rules, secrets


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_matches_keep_their_places(spark):
    text = "é\U0001F600 12 ﻿345\n6 " * 300 + "x7"
    got = one(spark, text).select(common.matches(F.col("text"), "[0-9]+").alias("m")).first()["m"]
    assert [(m["start"], m["end"], m["value"]) for m in got] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert "".join(m["before"] + m["value"] for m in got) == text


def test_sums_and_maxima_before_each(spark):
    for n in (0, 1, 63, 64, 65, 4096, 4097, 20_000):
        values = [(k * 7919) % 101 for k in range(n)]
        df = spark.createDataFrame([(values,)], "v array<bigint>")
        got = df.select(common.before_each(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), common.before_each(F.col("v"), F.lit(0), lambda a, b: F.greatest(a, b)).alias("m")).first()
        assert got["s"] == [0, *itertools.accumulate(values)][:n] and got["m"] == [0, *itertools.accumulate(values, max)][:n]


def test_many_matches_take_time_in_proportion(spark):
    def seconds(n):
        df = one(spark, "1234567 " * n).select(F.size(common.matches(F.col("text"), "[0-9]+")).alias("n"))
        start = time.perf_counter()
        assert df.first()["n"] == n
        return time.perf_counter() - start

    seconds(1_000)
    assert seconds(20_000) < 10  # it was 37 s when every match copied the earlier ones


def test_long_texts_of_identifiers_and_secrets(spark):
    text = "call +49 170 1234567 or 10.0.0.1 " * 8_000
    found = pii.find_personal_data(one(spark, text)).first()
    assert len(found["base"]) >= 16_000
    keys = secrets.find_secrets(one(spark, "password=abcdef12 user=bob " * 8_000)).first()
    assert len(keys["base"]) == 8_000 and len(keys["spans"]) == 16_000


def test_touching_spans(spark):
    spans = [(3, 6), (6, 9), (20, 21)]
    df = spark.createDataFrame([([{"start": a, "end": b} for a, b in spans],)], "s array<struct<start:long,end:long>>")
    cover = df.select(common.covered(F.col("s")).alias("c")).first()["c"]
    assert bytes(cover) == b"000111111" + b"0" * 11 + b"1"
    asked = spark.createDataFrame([(bytes(cover), a, a + n) for a in range(24) for n in (1, 3)], "c binary, start long, end long")
    got = {(r["start"], r["end"]): r["t"] for r in asked.select("*", common.touches(F.col("c"), F.struct("start", "end")).alias("t")).collect()}
    assert got == {(a, b): any(x < b and a < y for x, y in spans) for a, b in got}


@pytest.mark.parametrize("text", ["﻿ab cd ef", "\U0001F600é日本 cd", "plain", ""])
def test_masking_any_character(spark, text):
    spans = [("ip", 0, 2), ("email", 1, 3), ("found", 4, 5)]
    own = [s for s in spans if s[2] <= len(text)]
    df = one(spark, text).select(pii.wide(F.col("text")).alias("w"), F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for k, a, b in own or spans[:1]]).alias("s"))
    got = df.select(pii.mask_spans(F.col("w"), F.col("s"))).first()[0]
    want, at = "", 0
    for kind, a, b in own or spans[:1]:
        if a >= at:
            want += text[at:a] + pii.MASK[kind]
        at = max(at, b)
    assert got == want + text[at:]


def test_masked_documents_keep_types_and_columns(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.example.org now", 26, "k"), (None, "clean", 5, "k"), (2, None, None, "k")],
                                 "doc_id long, text string, n_chars int, uid string")
    got = {r["doc_id"]: r for r in pii.mask_documents(docs).collect()}
    assert got[1]["text"] == "mail [EMAIL] now" and got[1]["n_chars"] == 16 and got[None]["text"] == "clean" and got[2]["text"] is None
    assert pii.mask_documents(docs).schema == docs.schema
    long = docs.withColumn("text", F.lit(" ".join(f"some{k} plain{k} words{k}, here{k}." for k in range(20))))
    kept = quality_rules.keep_good(long)
    assert kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and kept.count() == 3


ARTICLE = "<p>" + "A long paragraph, with commas, that tells something, and goes on for a while. " * 6 + "</p>"


@pytest.mark.parametrize("wrapper", [
    'class="overflow-hidden p-4"', 'class="hidden md:block"', 'aria-hidden="false"', 'hidden="until-found"', 'data-hidden', 'title="display:none"',
    "data-x='hidden'"])
def test_wrappers_that_only_look_hidden(wrapper):
    assert "long paragraph" in html_text.main_text(f"<html><body><div {wrapper}>{ARTICLE * 3}</div></body></html>")


@pytest.mark.parametrize("attrs", [
    "hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display : none"', 'class="commentlist"', 'class="user-reviews"', 'id="sidebarLeft"',
    'class="CommentSection"'])
def test_what_is_hidden_or_beside_the_article(attrs):
    page = f"<html><body><div class='story'>{ARTICLE * 3}</div><div {attrs}><p>Other words, in passing, that nobody wants to keep, at all.</p></div></body></html>"
    got = html_text.main_text(page)
    assert "long paragraph" in got and "nobody" not in got
