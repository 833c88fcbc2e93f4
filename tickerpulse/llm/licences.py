"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of a document. Its features are the counts of word 1-, 2- and 3-grams out
of the vocabulary of the licence templates; a multinomial logistic regression with an L1 penalty gives
each family's and the unknown class's probability.

* **Training.** Positives are the template sentences, alone and in runs; negatives are paragraphs of the
  corpus that share little with any template: of the ``Training.negatives`` different ones with the smallest
  hash every second one, so the sample depends neither on the order of the table nor on repeated lines.
* **Calibration.** The cut that a family's probability has to pass is the largest of
  ``Training.least_probability`` and the ``1 - false_rate`` quantile of the best family probability over all
  different paragraphs of the corpus that share little with any template and were not fitted on; below it a
  paragraph is ``unknown``. Paragraphs are scored once, and the scores stored for both uses.
* **Confirmation.** A predicted family stands only if a template sentence of that family has at least
  ``overlap`` of its word pairs in the paragraph, or the paragraph has that share of its pairs in one.

Only DataFrame functions and ``pyspark.ml`` (JVM) are used. The vocabulary and weights are bounded by
the fixed templates, so they may travel with the tasks. Defined results: null and empty texts have no
licence; repeated rows and null ids are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import checkpointed, keyed, let, once

# fixed values: customary notices of each family
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
             "Licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.",
               "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Released under the BSD 3-Clause License.", "Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "Released under CC0 1.0 Universal, dedicated to the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "either version 3 of the License, or (at your option) any later version.", "Released under the GNU GPL v3.",
            "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Released under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
             "Licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited.",
                    "Proprietary and confidential."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *sorted(TEMPLATES))
LEAST_WORDS = 3  # of a negative
SHARED = 0.3  # largest share of a negative's word pairs that templates have


@dataclass(frozen=True)
class Training:
    negatives: int = 4000
    least_probability: float = 0.5
    false_rate: float = 0.001
    penalty: float = 0.0005
    overlap: float = 0.6


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _pairs(words: Column) -> Column:
    """Neighbouring word pairs; a single word stands for itself."""
    n = F.size(words)
    both = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.array_distinct(F.when(n >= 2, both).otherwise(words))


def templates(spark: SparkSession) -> DataFrame:
    """``(family, sentence, pairs)`` of the fixed templates."""
    rows = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(s).alias("sentence")) for f, own in TEMPLATES.items() for s in own))
    listed = spark.range(1).select(F.explode(rows).alias("t")).select("t.*", once(_words(F.col("t.sentence"))).alias("words"))
    return listed.select("family", "sentence", "words", _pairs(F.col("words")).alias("pairs"))


def paragraphs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(uid, doc_id, paragraph, words)``, one row per line; a text without a word has one row."""
    lines = keyed(docs, text_col, id_col).select("uid", "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.select("uid", "doc_id", "paragraph", once(_words(F.col("line"))).alias("words"))


def _grams(df: DataFrame, longer: str = "words") -> DataFrame:
    """``grams``: the words of ``words`` and the word 2- and 3-grams of ``longer``."""
    for n in (2, 3):
        df = NGram(n=n, inputCol=longer, outputCol=f"__{n}").transform(df)
    return df.withColumn("grams", F.concat("words", "__2", "__3")).drop("__2", "__3")


def _near(words: Column, pairs: list[str]) -> Column:
    """``words`` where two neighbouring ones are one of ``pairs``, else no word; ``pairs`` are bounded by TEMPLATES.

    Most paragraphs hold no pair of any template, so building their pairs and longer n-grams would find nothing.
    """
    first = sorted({p.split(" ")[0] for p in pairs})
    starts = F.filter(words, lambda w, i: w.isin(first) & F.concat(w, F.lit(" "), F.get(words, i + 1)).isin(pairs))
    return F.when(F.size(starts) > 0, words).otherwise(F.slice(words, 1, 0))


@dataclass
class LicenceModel:
    vocabulary: CountVectorizerModel
    regression: LogisticRegressionModel
    cut: float
    #: Dissimilar paragraphs of even hash up to this one were fitted on.
    fitted_to: int | None

    def pairs(self) -> list[str]:
        """The first two words of every longer gram of the vocabulary: without one of them a paragraph has no such gram."""
        return sorted({" ".join(g.split(" ")[:2]) for g in self.vocabulary.vocabulary if " " in g})

    def predict(self, df: DataFrame, longer: str = "words") -> DataFrame:
        """``df`` with ``family`` and ``probability``: the best family, whatever the unknown class has.

        ``longer`` holds the words again, but may be empty where there is none of ``pairs``.
        """
        scored = self.regression.transform(self.vocabulary.transform(_grams(df, longer)))
        p = scored.select(*df.columns, once(vector_to_array("__probability")).alias("__p"))
        best = F.array_max(F.slice("__p", 2, len(FAMILIES) - 1))
        name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("__p", best).cast("int"))
        return p.select(*df.columns, best.alias("probability"), name.alias("family"))


def _is_dissimilar(words: Column, pool: list[str], share: float) -> Column:
    """Whether the word pairs of ``words`` are mostly not template pairs; no words have none."""
    mostly_not = let(_pairs(words), lambda pairs: F.size(F.filter(pairs, lambda p: p.isin(pool))) <= share * F.size(pairs))
    return (F.size(words) == 0) | mostly_not


def _pool(known: DataFrame) -> list[str]:
    """The pairs of all templates: one small list, bounded by TEMPLATES."""
    return sorted({p for r in known.select("pairs").collect() for p in r["pairs"]})


def _negatives(docs: DataFrame, text_col: str, pool: list[str], t: Training) -> DataFrame:
    """``(h, words)``: the ``t.negatives`` different dissimilar paragraphs with the smallest hashes, if there are as many."""
    lines = paragraphs(docs, text_col, docs.columns[0]).where(F.size("words") >= LEAST_WORDS).select(
        F.xxhash64("words").alias("h"), "words")
    wanted = 4 * t.negatives
    while True:
        hashes = checkpointed(lines.select("h").distinct().orderBy("h").limit(wanted))  # of 8 bytes a row
        edge = hashes.agg(F.max("h").alias("edge"), F.count("*").alias("n")).first()
        near = lines.where(F.col("h") <= F.lit(edge["edge"])).distinct()
        # behind once, or the test moves below the distinct and meets every paragraph
        unlike = near.select("h", "words", once(_is_dissimilar(F.col("words"), pool, SHARED)).alias("unlike")).where("unlike").drop("unlike")
        found = checkpointed(unlike.orderBy("h", "words").limit(t.negatives))
        if edge["n"] < wanted or found.count() >= t.negatives:
            return found
        wanted *= 4


def fit(docs: DataFrame, text_col: str = "text", t: Training = Training()) -> LicenceModel:
    """The classifier, not calibrated yet (cut 0)."""
    known = checkpointed(templates(docs.sparkSession))
    negatives = _negatives(docs, text_col, _pool(known), t)
    edge = negatives.agg(F.max("h").alias("edge")).first()["edge"]
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    runs = known.groupBy("family").agg(F.flatten(F.collect_list("words")).alias("words"))
    positives = known.select("family", "words").unionByName(runs).select(label.alias("label"), "words", F.lit(20.0).alias("weight"))
    fit_on = positives.unionByName(negatives.where(F.pmod("h", F.lit(2)) == 0).select(F.lit(0.0).alias("label"), "words", F.lit(1.0).alias("weight")))
    vocabulary = CountVectorizer(inputCol="grams", outputCol="__counts", binary=True, vocabSize=1 << 16).fit(_grams(known))
    regression = LogisticRegression(featuresCol="__counts", labelCol="label", weightCol="weight", probabilityCol="__probability",
                                    predictionCol="__prediction", rawPredictionCol="__raw", family="multinomial",
                                    regParam=t.penalty, elasticNetParam=1.0, standardization=False, maxIter=60)
    return LicenceModel(vocabulary, regression.fit(vocabulary.transform(_grams(checkpointed(fit_on)))), 0.0, edge)


def train(docs: DataFrame, text_col: str = "text", t: Training = Training()) -> LicenceModel:
    """The classifier and its calibrated cut."""
    model = fit(docs, text_col, t)
    model.cut = calibrate(scores(docs, model, text_col, docs.columns[0], t), t)
    return model


def scores(docs: DataFrame, model: LicenceModel, text_col: str = "text", id_col: str = "doc_id", t: Training = Training()) -> DataFrame:
    """``(uid, doc_id, probability, family, alike, h)`` of every paragraph, stored: ``family`` and ``alike`` (whether a
    template confirms it) where the probability passes the least one, ``h`` where the paragraph calibrates."""
    known = templates(docs.sparkSession)
    pool = _pool(known)
    near = once(_near(F.col("words"), sorted({*pool, *model.pairs()})))
    found = model.predict(paragraphs(docs, text_col, id_col).withColumn("near", near), "near")
    h = F.xxhash64("words")
    seen = F.lit(False) if model.fitted_to is None else (h <= F.lit(model.fitted_to)) & (F.pmod(h, F.lit(2)) == 0)
    unlike = _is_dissimilar(F.col("near"), pool, SHARED)  # a paragraph with a template pair is near
    calibrates = F.when((F.size("words") >= LEAST_WORDS) & ~seen, F.when(unlike, h))
    by_family = F.broadcast(known.groupBy("family").agg(F.collect_list("pairs").alias("known")))
    likely = found.withColumn("family", F.when((F.col("probability") > t.least_probability) & (F.size("words") > 0), F.col("family")))
    own = F.when(F.col("family").isNotNull(), _pairs(F.col("words")))
    checked = likely.withColumn("own", own).join(by_family, "family", "left")
    alike = F.exists("known", lambda k: F.size(F.array_intersect("own", k)) >= t.overlap * F.least(
        F.size(k), F.greatest(F.size("own"), F.lit(2))))
    path = scratch_path(docs.sparkSession, "licence-scores")
    checked.select("uid", "doc_id", "probability", "family", F.when(F.col("family").isNotNull(), alike).alias("alike"),
                   calibrates.alias("h")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def calibrate(scored: DataFrame, t: Training = Training()) -> float:
    """The cut, from the scores of all different paragraphs that calibrate."""
    each = scored.where("h IS NOT NULL").groupBy("h").agg(F.max("probability").alias("p"))
    above = F.col("p") > t.least_probability
    n, high, below = each.agg(F.count("*"), F.count_if(above), F.max(F.when(~above, F.col("p")))).first()
    place = (n - 1) * (1 - t.false_rate)  # of the quantile in ascending order, from 0
    if not n or place <= n - high - 1:
        return t.least_probability
    # the quantile lies between two neighbouring values, the lower one of which may be the largest below
    ranks = [math.floor(place) - (n - high), math.ceil(place) - (n - high)]
    top = scored.where(F.col("h").isNotNull() & (F.col("probability") > t.least_probability)).groupBy("h").agg(
        F.max("probability").alias("p"))
    found = [below if r < 0 else _ranked(top, r, high) for r in ranks]
    return max(t.least_probability, found[0] + (place - math.floor(place)) * (found[1] - found[0]))


def _ranked(top: DataFrame, rank: int, n: int) -> float:
    """The value of ``top.p`` at ``rank`` of ``n`` from 0, exactly: the percentile there needs no interpolation."""
    counts = top.groupBy("p").agg(F.count("*").alias("n"))
    return counts.agg(F.expr(f"percentile(p, {rank / max(1, n - 1)!r}D, n)")).first()[0]


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", t: Training = Training(),
         model: LicenceModel | None = None) -> DataFrame:
    """``doc_id, licence, families, n_paragraphs, probability`` of every row.

    ``families`` lists the confirmed families, ``licence`` is the one of the most probable paragraph
    (``none`` without one), ``n_paragraphs`` counts confirmed paragraphs.
    """
    checked = scores(docs, model or fit(docs, text_col, t), text_col, id_col, t)
    cut = model.cut if model else calibrate(checked, t)
    confirmed = F.coalesce((F.col("probability") > cut) & F.col("alike"), F.lit(False))
    rows = checked.select("uid", "doc_id", F.when(confirmed, F.col("family")).alias("family"),
                          F.when(confirmed, F.col("probability")).alias("probability"))
    each = rows.groupBy("uid", "doc_id").agg(
        F.max_by("family", F.struct("probability", "family")).alias("best"), F.collect_set("family").alias("all"),
        F.count("family").alias("n_paragraphs"), F.max("probability").alias("probability"))
    return each.select("doc_id", F.coalesce("best", F.lit("none")).alias("licence"), F.array_join(F.array_sort("all"), ",").alias("families"),
                       "n_paragraphs", F.coalesce("probability", F.lit(0.0)).alias("probability"))
