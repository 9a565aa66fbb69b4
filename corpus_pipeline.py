"""Stages that clean a corpus and pack it into training sequences."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, language, packing, simhash, suffix_dedup
from lectern.llm.common import delete_path, drop_scratch, left, reads_scratch, scratch, scratch_dir, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Where the scratch of the stage that was called last begins and ends.
_LAST = [0, 0]


def stage(f: Stage) -> Stage:
    """A stage's result is written before the next stage is called; what it wrote for itself goes then, unless docs reads it."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _LAST[1] == left() and not reads_scratch(docs, *_LAST):
            drop_scratch(spark, *_LAST)
        begin = left()
        small_batches(spark)
        out = f(spark, docs, sf_dir)
        _LAST[:] = begin, left()
        return out

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; the others get the language that the model tells."""
    return language.known_language(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose shingles of five words are alike by four fifths, the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


@stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds are cut out; every document stays, if only with an empty text."""
    return suffix_dedup.without_repeats(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its ids, its sequence and its place there."""
    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("suffix_dedup", passages),
    ("best_fit_packing", pack),
]
#: The stages are not a matter of SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage's result is written and read again; then what the stage wrote for itself goes, and what it read."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES:
        path = f"{scratch_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            f(spark, docs, sf_dir).write.parquet(path)
        if read:
            delete_path(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
