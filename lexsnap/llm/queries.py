"""The registered queries of this subpackage: thin calls of its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsnap.llm import exact_dedup, filter_audit, jaccard_join, licenses, mixing, near_dedup, neighbours, packing, pii, quality, substring_dedup, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


@query
def op8_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, d, "documents"))


@query
def op9_superminhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, d, "documents"))


@query
def op1_relative_lempel_ziv(spark: SparkSession, d: str) -> DataFrame:
    parsed = substring_dedup.factor_duplicates(table(spark, d, "documents"), with_text=False)
    return parsed.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_window_packing(spark: SparkSession, d: str) -> DataFrame:
    pieces = packing.pack(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op2_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archived_pages(spark, warc.archive_pages(table(spark, d, "pages")))


# Sources not named here have weight 1.
SOURCE_WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}


@query
def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), SOURCE_WEIGHTS)


@query
def op4_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, d, "documents")).drop("matches")


@query
def op5_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_quality(table(spark, d, "documents"), table(spark, d, "labels")).drop("text_key")


@query
def op10_nn_descent(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return neighbours.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0)


# A sample key; in use it comes from a secret store.
PSEUDONYM_KEY = "sample-key-1"


@query
def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.pseudonymised(table(spark, d, "documents"), PSEUDONYM_KEY)


@query
def op11_block_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whitened(table(spark, d, "embeddings"))


@query
def op12_filter_tries(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op13_rare_first_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.similar_sets(table(spark, d, "documents"))
