"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biorec.llm import dedup, jaccard, mixing, pieces, toxicity
from biorec.llm.common import free, materialize, scratch, small_batches, table

#: SQL cannot express a trained classifier or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None

_left: dict[str, list[str]] = {}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage in small batches. What the stages before left in the shared folder is deleted first, as far as ``docs`` doesn't read it."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        app = spark.sparkContext.applicationId
        free(spark, _left.pop(app, []), docs)
        with scratch() as paths:
            out = f(spark, docs, sf_dir)
        _left[app] = paths
        return out

    return run_stage


@stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return dedup.keep_one_copy(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each n-gram Jaccard component stays."""
    return jaccard.keep_one_per_component(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate takes it."""
    return mixing.mix_sources(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_chunks and the pieces' identifiers of every row."""
    out = pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "n_chunks", "ids")


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("ngram_jaccard", near), ("source_mix", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = materialize(f(spark, docs, sf_dir), name)
    return docs
