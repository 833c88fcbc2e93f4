"""Dictionary tests inside the row, and what they spare the plan."""

import re

import pytest
from pyspark.sql import functions as F

from paths import SF001
from tickerpulse.operators import dictionary, tickers
from tickerpulse.plans.registry import all_queries
from tickerpulse.sources import fixtures as fx


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in ["A", "BRK-B", "GME", "é", "x y", ""] + [f"S{k}" for k in range(3000)]], "w string")


def test_exact(spark, words):
    test = dictionary.exact_test([r[0] for r in words.collect()])
    asked = spark.createDataFrame([(w,) for w in ["A", "B", "BRK-B", "BRK", "é", "x y", "", "S0", "S2999", "S3000", "S29990", None]], "w string")
    got = {r["w"]: r["hit"] for r in asked.withColumn("hit", test(F.col("w"))).collect()}
    assert got == {"A": True, "B": False, "BRK-B": True, "BRK": False, "é": True, "x y": True, "": True, "S0": True, "S2999": True,
                   "S3000": False, "S29990": False, None: False}
    assert not asked.where(dictionary.exact_test([])(F.col("w"))).count()
    with pytest.raises(ValueError):
        dictionary.exact_test(["a\x01b"])


def test_bloom_never_rejects_a_member(spark, words, monkeypatch):
    other = spark.range(20_000).select(F.concat(F.lit("T"), "id").alias("w"))
    test = dictionary.bloom_test(words, words.count())
    assert words.where(~test(F.col("w"))).count() == 0
    assert other.where(test(F.col("w"))).count() < 1200  # about 2 %
    assert spark.createDataFrame([(None,)], "w string").where(test(F.col("w"))).count() == 0
    monkeypatch.setattr(dictionary, "MAX_BITS", 1 << 12)
    weak = dictionary.bloom_test(words, words.count())
    assert words.where(~weak(F.col("w"))).count() == 0


def test_both_ways_find_the_same_symbols(spark):
    texts = spark.createDataFrame([
        (1, "$gme and BRK.B, THE $brk-b; GME GME"), (2, "nothing"), (3, None), (4, "YOLO $a AA $zz.x"), (5, "BF-B BF.B ON")], "id long, text string")
    dim = spark.createDataFrame([(" gme",), ("BRK-B",), ("BF.B",), ("A",), ("AA",), (None,), ("",), ("GME",)], "ticker string")
    stop = spark.createDataFrame([("aa",)], "word string")
    want = {1: ["BRK-B", "GME"], 2: [], 3: [], 4: ["A"], 5: ["BF.B"]}
    for bound in (100, 2):
        out = tickers.detect_tickers(texts, dim, stop, max_exact=bound)
        assert {r["id"]: r["mentioned_tickers"] for r in out.collect()} == want
        assert {r["id"]: r["n_tickers"] for r in out.collect()} == {k: len(v) for k, v in want.items()}
        assert out.columns == ["id", "text", "mentioned_tickers", "n_tickers"]


def exchanged_columns(df):
    """The output columns of every exchange of the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [re.search(r"Input \[\d+\]: \[(.*)\]", part)[1] for part in re.split(r"\n\(\d+\) ", plan) if part.startswith("Exchange")]


def test_no_text_is_exchanged(spark):
    out = all_queries()["document_tickers"].build(spark, SF001)
    assert exchanged_columns(out) == []
    docs = fx.table(spark, SF001, "documents").select(F.col("doc_id").alias("id"), "text")
    assert exchanged_columns(tickers.detect_tickers(docs, fx.ticker_dim(spark), fx.ticker_stoplist(spark))) == []
