"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each whole text gives a vector of transformed statistics (``STATISTICS``). Class means and covariances
are exact moments over all training rows, summed in Spark; only the moments (a few hundred numbers)
reach the driver. Each class covariance is shrunk towards the pooled one and that towards its
diagonal, a small ridge is added, and its Cholesky factor is cached for all scoring tasks. A
document's score is the logistic of the difference of the two Mahalanobis log-densities plus the log
prior odds: higher means label 1 is likelier.

Defined results: a null text counts as empty and is scored like any other; a label is used for every
row with its id, null ids have none; null labels are ignored; with fewer than two rows of either
class the score is the share of label 1 (one half without labels); empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .quality_rules import SYMBOLS, repeated_window_words

STATISTICS = ("log words", "mean word length", "symbols per word", "capitals per letter", "exclamation marks per word",
              "different words", "repeated windows", "sentence ends per word", "commas per word", "bars per word",
              "digits per character", "log words per line", "repeated neighbours")


@dataclass(frozen=True)
class Shrinkage:
    pooled: float = 0.3
    diagonal: float = 0.1
    ridge: float = 1e-2


@cache
def _kinds() -> np.ndarray:
    """Per code point of the basic plane: 0 other, 1 capital, 2 other letter, 3 digit."""
    return np.array([1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 0
                     for c in map(chr, range(1 << 16))], np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; shares are square-rooted, sizes logged."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = sum(map(len, words))
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    _, upper, lower, digits = np.bincount(_kinds()[points[points < 1 << 16]], minlength=4).tolist()
    lines = sum(1 for x in text.split("\n") if x.strip())
    same = sum(a == b for a, b in zip(words, words[1:]))
    root = math.sqrt
    return [math.log1p(n), chars / n, root(sum(text.count(c) for c in SYMBOLS) / n), root(upper / max(1, upper + lower)),
            root(text.count("!") / n), root(len(set(words)) / n), root(repeated_window_words(words) / n),
            root(sum(text.count(c) for c in ".?…") / n), root(text.count(",") / n), root(text.count("|") / n),
            root(digits / len(text)), math.log1p(n / max(1, lines)), root(same / n)]


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, x)`` per row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return narrow.mapInArrow(run, f"doc_id {id_type}, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per class of ``rows(quality, x)``: count, sum and sum of outer products, added up by Spark."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, d)
            y = b.column("quality").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = np.hstack([np.ones((int((y == k).sum()), 1)), x[y == k]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * (d + 1) ** 2, pa.int32()), pa.array(np.arange((d + 1) ** 2), pa.int32()),
                     pa.array((own.T @ own).ravel())], ["k", "cell", "v"])

    sums = rows.mapInArrow(run, "k int, cell int, v double").groupBy("k", "cell").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in (0, 1):
        m = np.zeros((d + 1) ** 2)
        for r in sums:
            if r["k"] == k:
                m[r["cell"]] = r["v"]
        m = m.reshape(d + 1, d + 1)
        out[k] = int(round(m[0, 0])), m[0, 1:], m[1:, 1:]
    return out


@dataclass
class Discriminant:
    """Two Gaussians by mean, Cholesky factor and log determinant, and the log prior odds."""
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    @classmethod
    def fit(cls, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], s: Shrinkage) -> Discriminant | float:
        """The model, or the constant score of too little data."""
        counts = [sums[k][0] for k in (0, 1)]
        if min(counts) < 2:
            return counts[1] / sum(counts) if sum(counts) else 0.5
        means = np.array([sums[k][1] / counts[k] for k in (0, 1)])
        scatter = np.array([sums[k][2] - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)])
        pooled = scatter.sum(axis=0) / sum(counts)
        factors, dets = [], []
        for k in (0, 1):
            cov = (1 - s.pooled) * scatter[k] / counts[k] + s.pooled * pooled
            cov = (1 - s.diagonal) * cov + s.diagonal * np.diag(np.diag(cov)) + s.ridge * np.eye(len(cov))
            factors.append(np.linalg.cholesky(cov))
            dets.append(2 * np.log(np.diag(factors[-1])).sum())
        return cls(means, np.array(factors), np.array(dets), math.log(counts[1] / counts[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        log_density = []
        for k in (0, 1):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            log_density.append(-0.5 * ((z * z).sum(axis=0) + self.log_dets[k]))
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0] + self.log_odds, -500, 500)))


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5


def score_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", held_out_fold: int = 0,
                    shrinkage: Shrinkage = Shrinkage()) -> DataFrame:
    """``doc_id, held_out, score`` of every row; labels of the held-out fold are never read."""
    table = checkpointed(features(docs, text_col, id_col))
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)")
    known = known.where(fold(F.col("doc_id")) != held_out_fold)
    model = Discriminant.fit(moments(table.join(known, "doc_id").select("quality", "x")), shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score)],
                                             ["doc_id", "held_out", "score"])

    id_type = table.schema["doc_id"].dataType.simpleString()
    asked = table.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False)).alias("held_out"), "x")
    return asked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
