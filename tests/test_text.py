from tickerpulse.functions import text as tx
from tickerpulse.operators import clean, tickers
from tickerpulse.plans import pipelines
from tickerpulse.sources import fixtures as fx


def test_literal_edge_cases(spark):
    rows = [("1", "Buying $brk.b and BRK-A today"), ("2", "$THE is a cashtag, THE is a word"),
            ("3", "unknown suffix $CI-US here"), ("4", None), ("5", "   ")]
    df = spark.createDataFrame(rows, "id string, text string")
    dim = spark.createDataFrame([("BRK-B",), ("BRK.A",), ("THE",), ("CI",)], "ticker string")
    out = {r["id"]: list(r["mentioned_tickers"]) for r in tickers.detect_tickers(df, dim).collect()}
    assert out["1"] == ["BRK-B", "BRK.A"]
    assert out["2"] == ["THE"]           # cashtags skip the English list
    assert out["3"] == []                 # CI-US is not CI (no fallback to the base symbol)
    assert out["4"] == [] and out["5"] == []


def test_placeholders_and_length(spark):
    vals = [None, "", "  [Deleted] ", "[removed]", "NaN", "x" * 10, "x" * 11, " [removed]\t"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [(r["p"], r["v"]) for r in df.select(tx.is_placeholder("t").alias("p"),
                                               tx.is_valid_text("t").alias("v")).collect()]
    assert [p for p, _ in got] == [True, True, True, True, True, False, False, True]
    assert [v for _, v in got] == [False, False, False, False, False, False, True, False]


def test_normalize_compat_literals(spark):
    cases = [("Check $AAPL's move, BRK.B up!", "CHECK $AAPL s MOVE BRK.B UP"), ("x$AB and _CD", "x AB AND _cd"),
             ("A [link](https://ex.com/a) and https://ex.com/b now", "a LINK AND NOW"), ("lowercase longword 123", "lowercase longword 123"),
             (None, ""), ("  ", "")]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(tx.normalize_text("t", compat=True)).collect()] == [w for _, w in cases]


def test_normalize_default_protects_only_detected(spark):
    df = spark.createDataFrame([("Go $CI and DER.A now, the QUE", ["DER-A", "QUE"])],
                               "t string, k array<string>")
    assert df.select(tx.normalize_text("t", "k")).first()[0] == "go $CI and der a now the QUE"


def test_both_views_come_from_one_pass(spark):
    texts = ["Go $CI and DER.A now, the QUE", "ab\u00e9 x-y.z [a b](http://c d) http", "BRK.B-A $AAPL's toolong", "raw \x01 Foo.Bar \x02 and \x01ci", None, ""]
    df = spark.createDataFrame([(t, ["DER-A", "QUE"]) for t in texts], "t string, k array<string>")
    got = df.select(tx.normalized_views("t", "k").alias("v")).select("v.*").collect()
    alone = df.select(tx.normalize_text("t", "k"), tx.normalize_text("t", compat=True)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in alone]
    assert tuple(got[0]) == ("go $CI and der a now the QUE", "GO $CI AND DER.A NOW THE QUE")
    assert tuple(got[2]) == ("brk b a $AAPL s toolong", "BRK.B a $AAPL s toolong") and tuple(got[4]) == ("", "")


def test_stopword_literals(spark):
    cases = [("The IN and THE of it", ["IN"], "IN"), ("a, the. (and) buy!", [], "buy!"), ("-- cat ... dog", [], "cat dog"),
             ("IN the money", [], "money"), (None, [], "")]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, k array<string>")
    assert [r[0] for r in df.select(tx.remove_stopwords("t", "k")).collect()] == [c[2] for c in cases]


def test_whole_bodies_are_read(spark):
    body = "word " * 900 + "$CI tail"  # the cashtag and the last word stand after character 4,000
    posts = spark.createDataFrame([("a", "t", 1, "p1", 1, "5", body, "r", "0.5", None)],
                                  "author string, title string, created_utc long, id string, is_original_content int, score string, "
                                  "body string, subreddit string, upvote_ratio string, url string")
    comments = spark.createDataFrame([], "author string, created_utc long, id string, parent_post_id string, score string, body string, "
                                         "subreddit string")
    out = pipelines.preprocess(posts, comments, fx.ticker_dim(spark)).first()
    assert list(out["mentioned_tickers"]) == ["CI"] and out["word_count"] == 903 and out["text_length"] == len("t. " + body)


def test_coercion_of_bad_values(spark):
    rows = [("1700000000", "3.7", "0.9"), ("1e18", "NaN", "NaN"), ("x", "inf", "-Infinity"), (None, None, None), ("2024-01-02 03:04:05", "abc", "1e400")]
    df = spark.createDataFrame(rows, "created_utc string, score string, upvote_ratio string")
    got = [(r[0] and r[0].year, r[1], r[2]) for r in clean.coerce_types(df).collect()]
    assert got == [(2023, 3, 0.9), (None, 0, None), (None, 0, None), (None, 0, None), (2024, 0, None)]
