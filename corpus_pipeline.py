"""Corpus pipeline: drop poor documents and copies, mix the sources, pack the rest."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsnap.llm import exact_dedup, mixing, near_dedup, packing, quality
from lexsnap.llm.queries import SOURCE_WEIGHTS, table
from lexsnap.session import materialize, release, scratch_paths

# Words that the packing keeps: few, for its workers share an executor's memory with what
# the stages before it have left there.
KNOWN_WORDS = 1 << 14

# Scratch tables of the stage that ran last, by application.
_LEFT: dict[str, list[str]] = {}


def stage(function: Callable) -> Callable:
    """A stage that first releases the scratch tables of the one before it.

    By then the predecessor's rows have been written and are reread as ``docs``.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, _LEFT.pop(app, []))
        before = len(scratch_paths(spark))
        out = function(spark, docs, sf_dir)
        _LEFT[app] = scratch_paths(spark)[before:]
        return out

    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return near_dedup.deduplicated(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by which the sources have their target weights, shuffled."""
    # Columns that mixing would replace by its own are carried under other names.
    own = {c: f"_documents_{c}" for c in ("copy", "n_copies") if c in docs.columns}
    mixed = mixing.mixed(docs.withColumnsRenamed(own), SOURCE_WEIGHTS).drop("copy", "n_copies")
    return mixed.withColumnsRenamed({other: c for c, other in own.items()})


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, as pieces of documents."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), KNOWN_WORDS)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near-duplicate removal", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

# The classifier, the signatures and the packing cannot be expressed in SQL; the tests
# hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over all that its predecessor kept, stored in between.

    Whatever the rows hold, each stage treats them as its operator's docstring says: null
    and empty texts are scored, compared and packed as empty, null sources are one source,
    rows that repeat a doc_id are rows of their own until one of equal texts stays, and
    other columns are carried along up to the packing, which does not read them. An empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = materialize(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
