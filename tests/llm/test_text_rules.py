"""Quality rules, quality model, HTML extraction and licences."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerpulse.llm import html_text, licences, quality_model, quality_rules
from tickerpulse.llm.quality_rules import LineRules, judge


def test_base_counts_match_a_plain_count(docs, rows):
    got = quality_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for doc_id, text, _ in rows:
        words = re.findall("[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        marked = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        want.append((doc_id, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                     len(marked), len(words) < 50 or 100 * len(marked) > 50 * len(words)))
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("line, rule", [
    ("Home | About | Contact | Help", "navigation"), ("Of%%% the*** man$$$ went.### home", "punctuation"),
    ("BUY NOW!! BEST PRICE!! CALL US!!", "punctuation"), ("word " * 30, "punctuation"), ("and on and on " * 8 + ".", "boilerplate"),
    ("We use cookies on this site.", "boilerplate"), ("An ordinary sentence, as people write it.", "")])
def test_each_line_rule(line, rule):
    assert quality_rules.line_fault(line.split(), False, LineRules()) == rule


def test_lines_go_and_a_document_that_loses_too_much_is_rejected():
    good = "\n".join(f"Sentence{i} number{i} says{i} something{i}, and{i} ends{i} properly{i}." for i in range(12))
    verdict = dict(zip(quality_rules.COUNTS, judge(good + "\nHome | About | Contact | Help", LineRules())))
    assert verdict["kept"] and verdict["clean_text"] == good and verdict["n_navigation"] == 1
    bad = "\n".join(f"Home{i} | About{i} | Contact{i} | Help{i}" for i in range(40))
    verdict = dict(zip(quality_rules.COUNTS, judge(bad, LineRules())))
    assert not verdict["base_failed"] and not verdict["kept"] and verdict["clean_text"] == ""


def test_kept_documents_keep_their_columns(docs, none):
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema
    judged = Counter((r["doc_id"], r["clean_text"]) for r in quality_rules.apply_rules(docs).where("kept").collect())
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == judged
    assert quality_rules.keep_good(none).count() == 0 and quality_rules.apply_rules(none).count() == 0


def test_quality_model_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_model.score_documents(docs, labels)
    got = {r["doc_id"]: r for r in scored.collect()}
    truth = [(r["doc_id"], r["quality"]) for r in labels.collect()]
    held = [(q, got[i]["score"]) for i, q in truth if i in got and got[i]["held_out"]]
    assert len(held) > 40 and np.mean([(s >= 0.3) == q for q, s in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == docs.count()
    # labels of the held-out fold are never read
    flipped = labels.withColumn("quality", 1 - labels["quality"]).where(quality_model.fold(labels["doc_id"]) == 0)
    again = quality_model.score_documents(docs, labels.where(quality_model.fold(labels["doc_id"]) != 0).unionByName(flipped))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == pytest.approx({i: r["score"] for i, r in got.items()}, abs=1e-9)


def test_quality_model_edges(docs, none, spark):
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.score_documents(docs, labels).collect()
    assert len(out) == docs.count() and all(r["score"] in (0.5, 1.0) for r in out)
    assert quality_model.score_documents(none, labels.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>Not <b>this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad-box">Buy, buy, buy, now.</div>
<div id="content"><h1>Title</h1><p>First, of &amp; two&nbsp;parts: <b>bo</b>ld.<p>Second &lt;here&gt; is <a href="x">linked</a>,
 and long enough to count as text.</p><form><p>Your name</p></form><div class='comments'><p>Nice, very nice, really, yes.</p></div></div>
<div class="sidebar"><p>Side, side, side, side.</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == ("Title First, of & two parts: bold. Second <here> is linked, and long enough to count as text.")
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    assert html_text.main_text("just text, no tag") == "just text, no tag"
    assert html_text.main_text("<p>cut off<") == "cut off<" and html_text.main_text("<p>cut off<a href='x") == "cut off"
    assert html_text.main_text("<ul><li>one<li>two</ul>" ) == "one two"
    assert html_text.main_text("<p>" * 3000 + "deep" + "</div>" * 50) == "deep"


def test_html_rows(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, 1), (3, "v", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_text.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 93, 93] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0
    # every article of the test pages, against its markup
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html as h
    want = {}
    for r in real.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(h.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", article))).split())
    assert {r["page_id"]: r["text"] for r in html_text.extract(real).collect()} == want


def test_licences(spark, none):
    lines = [(1, "Prose of some words here.\nReleased under the MIT License.\nMore prose follows it.", "mit"),
             (2, "Licensed under the Apache License, Version 2.0.", "apache"), (3, "the license of the work was under debate", ""),
             (4, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "cc-by-nc,gpl"),
             (5, None, ""), (6, "", ""), (6, "", ""), (None, "Released under the MIT License.", "mit")]
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text").where(
        "NOT text rlike '(?i)licen|rights reserved'")
    docs = spark.createDataFrame([x[:2] for x in lines], "doc_id long, text string").unionByName(prose)
    model = licences.train(docs)
    got = Counter((r["doc_id"], r["families"]) for r in licences.scan(docs, model=model).collect() if (r["doc_id"] or 0) < 1000)
    assert got == Counter((i, f) for i, _, f in lines)
    found = licences.scan(docs, model=model).where("doc_id >= 1000 AND families <> ''")
    assert found.count() == 0
    assert licences.scan(none, model=model).count() == 0


PLAIN = "one hundred and fifty characters of text without any comma in it at all so that it earns few points but is part of the article as it stands here ok"
RICH = "a long paragraph, with commas, many of them, so that it scores well, far more than others, and wins, clearly, over all the rest, of the page"


def parts_of(html):
    """Every ``[name]`` that the main text holds."""
    return set(re.findall(r"\[(\w+)\]", html_text.main_text(html)))


@pytest.mark.parametrize("html, want", [
    # sections of one article, the second without a comma
    (f"<body><nav><a href=x>[menu]</a></nav><article><h1>[title]</h1><section><h2>[first]</h2><p>{RICH}</p><p>{RICH}</p></section>"
     f"<section><h2>[second]</h2><p>[x]{PLAIN}</p><p>{PLAIN}</p></section></article></body>", "title first second x"),
    # sections without an article element, and a heading one level up
    (f"<body><div><h1>[title]</h1><div><div><p>{RICH}</p><p>{RICH}</p></div><div><h2>[second]</h2><p>{PLAIN}</p><p>{PLAIN}</p></div></div></div></body>",
     "title second"),
    # a long list wins; a table, a short list and a wrapped lead stay
    ("<body><div><div>[lead] stands in its own element</div><ul>" + "<li>[item] entry of the list</li>" * 30 + "</ul><table><tr><td>[cell]</td>"
     "<td>12</td></tr></table><ol><li>[short]</li></ol></div></body>", "lead item cell short"),
    # a list in one section of an article
    ("<main><section><ul>" + "<li>[item] entry of the list</li>" * 30 + f"</ul></section><section><p>[prose]{PLAIN}</p></section></main>", "item prose"),
    # layout classes
    (f"<body class=x><div class='page with-sidebar'><article><p>[text]{RICH}</p></article><div class=sidebar><p>[aside]{RICH}</p></div></div></body>", "text"),
    (f"<body><div id='header-layout no-nav'><p>[text]{RICH}</p><p>{RICH}</p></div><div class=comments><p>[reply] short</p></div></body>", "text"),
    # comments stay away, however long, and link lists too
    (f"<body><article><p>[text]{RICH}</p></article><div class=comments>" + f"<article class=comment><p>[reply]{RICH}</p></article>" * 9
     + "</div><ul><li><a href=x>[other] page</a></li><li><a href=y>[other] page</a></li></ul></body>", "text"),
])
def test_whole_articles(html, want):
    assert parts_of(html) == set(want.split())


def test_licence_cut_covers_all_paragraphs(spark):
    scored = spark.createDataFrame([(k if k < 5000 else None, p) for k, p in enumerate([i / 10_000 for i in range(4980)] + [
        0.6 + i / 100 for i in range(20)] + [0.99] * 30)] * 2, "h long, probability double")
    distinct = [i / 10_000 for i in range(4980)] + [0.6 + i / 100 for i in range(20)]
    assert licences.calibrate(scored) == pytest.approx(np.quantile(distinct, 0.999))
    one_odd = scored.where("h < 4980").unionByName(spark.createDataFrame([(9000, 0.98)], scored.schema))
    assert licences.calibrate(one_odd) == 0.5
    assert licences.calibrate(scored.limit(0)) == 0.5


def test_licence_negatives_are_different_paragraphs(spark):
    t = licences.Training(negatives=40)
    lines = [f"some words of line {k} here" for k in range(300)]
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(x,) for x in lines], "w string").selectExpr("w", "xxhash64(split(w, ' ')) h").collect()}
    smallest = min(lines, key=hashes.get)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines + ["\n".join([smallest] * 1000)])], "doc_id long, text string")
    got = licences._negatives(docs, "text", licences._pool(licences.templates(spark)), t).collect()
    assert [" ".join(r["words"]) for r in got] == sorted(lines, key=hashes.get)[:40]


def test_licence_scores_need_longer_grams_of_near_paragraphs_only(spark):
    docs = spark.createDataFrame([(i, f"some plain words of line {i} and no more\nLicensed under the MIT License.") for i in range(60)], "doc_id long, text string")
    model = licences.fit(docs, t=licences.Training(negatives=40))
    pool = licences._pool(licences.templates(spark))
    lines = ["licensed under the mit license", "the mit is not a license of the kind", "under x the x mit x license", "no such word", "license", "", "the",
             "of the of the of the of the", "prose that ends with all rights", "a b c d e f g h under the", "released under the released under the bsd license"]
    words = spark.createDataFrame([(n, x.split()) for n, x in enumerate(lines)], "n int, words array<string>")
    near = words.withColumn("near", licences._near(F.col("words"), sorted({*pool, *model.pairs()})))
    pairs = [list(zip(x.split(), x.split()[1:])) for x in lines]
    known = [{p for p in ps if " ".join(p) in pool} for ps in pairs]
    rows = {r["n"]: r for r in near.withColumn("unlike", licences._is_dissimilar(F.col("near"), pool, 0.3)).collect()}
    assert [rows[n]["near"] for n in range(len(lines))] == [x.split() if k else [] for x, k in zip(lines, known)]
    assert [rows[n]["unlike"] for n in range(len(lines))] == [len(k) <= 0.3 * len(set(ps)) for k, ps in zip(known, pairs)]
    assert {len(k) > 0 for k in known} == {r["unlike"] for r in rows.values()} == {True, False}
    whole = {r["n"]: (r["family"], r["probability"]) for r in model.predict(words).collect()}
    assert {r["n"]: (r["family"], r["probability"]) for r in model.predict(near, "near").collect()} == whole
