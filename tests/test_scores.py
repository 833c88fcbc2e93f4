from tickerpulse.functions import scores as sc


def test_m4_ties_are_neutral(spark):
    df = spark.createDataFrame([(0.4, 0.2, 0.4), (0.1, 0.2, 0.7), (0.5, 0.5, 0.0), (0.6, 0.3, 0.1)],
                               "n double, u double, p double")
    s = sc.score_from_probs("n", "u", "p")
    got = [tuple(r) for r in df.select(s["label"], s["confidence"]).collect()]
    assert [g[0] for g in got] == ["neutral", "positive", "neutral", "negative"]


def test_m5_first_max_wins(spark):
    df = spark.createDataFrame([(0.4, 0.2, 0.4), (None, 0.2, 0.1)], "n double, u double, p double")
    lab = sc.label_first_max([("positive", "p"), ("negative", "n"), ("neutral", "u")])
    assert [r[0] for r in df.select(lab).collect()] == ["positive", "neutral"]


def test_m6_ensemble(spark):
    df = spark.createDataFrame([(0.1, 0.3, None), (0.5, None, None)], "a double, b double, c double")
    e = sc.ensemble_stats(["a", "b", "c"])
    r = df.select(e["mean"], e["variance"]).collect()
    assert abs(r[0][0] - 0.2) < 1e-12 and abs(r[0][1] - 0.02) < 1e-12
    assert r[1][0] == 0.5 and r[1][1] is None


def test_k1_parse_routes(spark):
    cases = [
        ('{"sentiment": "Positive", "score": 0.8}', "positive", 0.8, "json"),
        ('blah {"sentiment": "negative", "score": "-0.4"} blah', "negative", -0.4, "json"),
        ('{"score": 0.3}', "neutral", 0.3, "json"),
        ('broken "score": -0.7 and more', "negative", -0.7, "regex"),
        ('{"sentiment": null}', "neutral", 0.0, "default"),
        ('score": 5', "positive", 5.0, "regex"),
        ('', "neutral", 0.0, "default"),
        ("{'sentiment': 'positive', 'score': 0.9}", "neutral", 0.0, "default"),
        ('{"sentiment": "positive", "score": 0.05} and {more}', "neutral", 0.05, "regex"),
        ('{"sentiment": 1, "score": 0.3}', "positive", 0.3, "regex"),
        ('{"sentiment": "Negative", "score": true}', "negative", 1.0, "json"),
        ('{"sentiment": "neutral", "score": [1]}', "neutral", 0.0, "default"),
        ('{"sentiment": "positive"} {"score": 0.2}', "positive", 0.2, "regex"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "r string")
    p, q = sc.parse_model_response("r"), sc.parse_model_response("r", clamp=True)
    got = df.select(p["label"], p["score"], p["route"], q["score"]).collect()
    for (txt, lab, score, route), g in zip(cases, got):
        assert (g[0], round(g[1], 9), g[2]) == (lab, score, route), txt
    assert got[5][3] == 1.0
    nan = spark.createDataFrame([('{"sentiment": "Positive", "score": "NaN"}',)], "r string").select(p["label"], p["score"]).first()
    assert tuple(nan) == ("positive", None)


def test_routing(spark):
    df = spark.createDataFrame([(0.49,), (0.5,), (0.64,), (0.65,)], "c double")
    assert [r[0] for r in df.select(sc.route_by_confidence("c")).collect()] == ["drop", "second", "second", "keep"]
    assert [r[0] for r in df.select(sc.route_by_confidence("c", None, 0.5)).collect()] == \
        ["second", "keep", "keep", "keep"]
