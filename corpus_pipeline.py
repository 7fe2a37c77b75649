"""A corpus pipeline of the text operators: every stage works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficloom.llm import decontaminate, langid, mixing, set_join, token_files
from trafficloom.llm.tables import BATCHES, ship_package, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A text whose best language scores less is in none of the languages learned.
LEAST_LANGUAGE_SCORE = 0.3
VOCABULARY = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model learns from their own labels. Null texts,
    texts without letters and texts like no language learned go."""
    model = langid.train(docs, F.lit(True))
    found = langid.classify(docs.toDF(*_inner(docs)), model, "c_text")
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.drop("lang_pred", "score").toDF(*docs.columns)


def _inner(docs: DataFrame) -> list[str]:
    """Column names that nothing an operator adds can clash with."""
    return [f"c_{c}" for c in docs.columns]


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents by position, with a key for each distinct pair of doc_id and text."""
    return docs.toDF(*_inner(docs)).withColumn("key", F.xxhash64("c_doc_id", "c_text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id, a null last.
    Rows that share a doc_id and have different texts are different documents, and so are rows
    without a doc_id. Of rows equal in doc_id and text one stays. Texts without words copy nothing."""
    keyed = _keyed(docs)
    groups = written(set_join.jaccard_components(keyed.select(F.col("key").alias("doc_id"), F.col("c_text").alias("text"))), "copies")
    place = F.struct(F.col("c_doc_id").isNull(), "c_doc_id", "key")
    members = keyed.select("key", "c_doc_id").join(groups.select(F.col("doc_id").alias("key"), "component_id").distinct(), "key")
    keepers = members.groupBy("component_id").agg(F.min(place)["key"].alias("key")).select("key")
    kept = keyed.join(keepers, "key", "left_semi")
    one = Window.partitionBy("key").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in _inner(docs)]))
    kept = kept.withColumn("row", F.row_number().over(one)).where("row = 1")
    return kept.drop("key", "row").toDF(*docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Rows are looked up by doc_id and text, so a
    document that shares its doc_id with a leaking one stays; null texts hold nothing."""
    benchmark = table(spark, sf_dir, "benchmark")
    keyed = _keyed(docs)
    leaks = decontaminate.find_leaks(keyed.select(F.col("key").alias("doc_id"), F.col("c_text").alias("text")), benchmark)
    leaked = leaks.select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(leaked, "key", "left_anti").drop("key").toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat or go as their source's budget has it.
    A null source is a source, rows with null or repeated ids are mixed like others, and
    documents without words go, as nothing is taken of them."""
    mixed = mixing.mixed_documents(docs)
    # A document cut at its budget is shorter than it was.
    return mixed.withColumn("n_chars", F.length("text")) if "n_chars" in docs.columns else mixed


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row as a token file, and what reading it gives. A null text is empty;
    rows are in order of doc_id, nulls first, and repeated ones are written as often as they occur."""
    return token_files.token_digests(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))


def _in_small_batches(stage: Stage) -> Stage:
    """The stage with the session set to batches of few bytes. The caller writes what a stage returns
    later, so the session stays that way."""

    @wraps(stage)
    def in_session(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCHES.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return in_session


STAGES: list[tuple[str, Stage]] = [
    ("language", _in_small_batches(identify_language)),
    ("near_copies", _in_small_batches(drop_near_copies)),
    ("decontamination", _in_small_batches(remove_leaks)),
    ("mixing", _in_small_batches(mix_sources)),
    ("tokens", _in_small_batches(write_tokens)),
]

# A trained model, similarity search and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one but the last is written and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
