"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, html_text, katz, language, licences, packing, periodic, pii, quality_model, quality_rules, secrets, simhash, sql
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair whose containment of 5-word shingles is 0.8 or more."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; label 1 is predicted from 0.3 up."""
    scored = quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, line losses and verdict of every document."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in mixture-controlled sequences of 4096 tokens."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans and linked weak credentials."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz back-off score of every document, learnt from the ids whose crc32 modulo 5 is not 1."""
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, 3 or fewer differing bits."""
    marked = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and identifiers found by bootstrapped contexts."""
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a conditional random field over its words, and the spans of each language."""
    return language.predict_documents(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level alignment of two tokenizers for every document, with corpus-wide counts of linked pairs."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.digest(alignment.align_documents(table(spark, sf_dir, "documents"), *paths))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op13's contract looks at: every tenth document's tail is made periodic. Null ids stay as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a:a + p] * (n // p + 1))[:n - a]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document: at least six words and four periods long."""
    return periodic.digest(periodic.find_runs(table(spark, sf_dir, "documents"), words_of=planted_period))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontaminate, op2_html_text, op3_quality_model, op4_quality_rules, op5_packing, op6_secrets, op7_katz, op8_simhash,
        op9_pii, op10_licences, op11_language, op12_alignment, op13_runs)}

SQL: dict[str, str] = {"op1_decontaminate": sql.OP1, "op4_quality_rules": sql.OP4}
