"""The vector table: building, upserting, updating, deleting, looking up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.schemas import KEY, METADATA_COLUMNS
from lexsnap.session import sent

# Metadata that follows the regulation table; text and vector never do.
FOLLOWING = ("status_dokumen", "topik", "jenis_peraturan", "nomor_peraturan")


def vector_documents(qa: DataFrame, regulations: DataFrame) -> DataFrame:
    """QA rows with their regulation: ``(id, metadata, document)``.

    The id is ``permalink#id`` and null if either part is null.
    """
    about = regulations.select(KEY, *FOLLOWING)
    return qa.join(about, KEY).select(
        F.concat(KEY, F.lit("#"), F.col("id").cast("string")).alias("id"),
        F.struct(*METADATA_COLUMNS).alias("metadata"),
        F.col("question").alias("document"),
    )


def get_where(vectors: DataFrame, permalink: str) -> DataFrame:
    """Records of one document; the predicate reaches the Parquet scan."""
    return vectors.filter(F.col("metadata.permalink") == permalink)


def get_where_in(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of many documents, by a table of keys."""
    wanted = keys.select(F.col(KEY).alias("_key")).distinct()
    return vectors.join(wanted, F.col("metadata.permalink") == F.col("_key"), "left_semi")


def delete_where_in(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the records of the given documents."""
    gone = keys.select(F.col(KEY).alias("_key"))
    return vectors.join(gone, F.col("metadata.permalink") == F.col("_key"), "left_anti")


def upsert(vectors: DataFrame, records: DataFrame, ids_are_few: bool = False) -> DataFrame:
    """Replace records with the same id and add the others.

    With ``ids_are_few`` their ids are sent to all executors, and the table stays in place.
    """
    ids = sent(records.select(F.col("id").alias("_id")), ids_are_few)
    kept = vectors.join(ids, F.col("id") == F.col("_id"), "left_anti")
    return kept.unionByName(records)


def update_metadata(vectors: DataFrame, regulations: DataFrame) -> DataFrame:
    """Set the following metadata for all records of the given (changed) rows."""
    changed = regulations.select(
        F.col(KEY).alias("_key"), F.struct(*FOLLOWING).alias("_now")
    )
    metadata = F.col("metadata")
    for name in FOLLOWING:
        metadata = metadata.withField(name, F.col(f"_now.{name}"))
    joined = vectors.join(changed, F.col("metadata.permalink") == F.col("_key"), "left")
    return joined.withColumn(
        "metadata",
        F.when(F.col("_key").isNotNull(), metadata).otherwise(F.col("metadata")),
    ).select(*vectors.columns)


def apply_changes(
    vectors: DataFrame,
    records: DataFrame,
    changed: DataFrame,
    gone: DataFrame,
    keys_are_few: bool = False,
    ids_are_few: bool = False,
) -> DataFrame:
    """Upsert, metadata update and delete over one scan of the table.

    The same as the three operators in turn. Changes and deletes share one join
    on the permalink; each side that is small is broadcast, so that the vectors
    themselves stay where they are; with ``keys_are_few`` that of the changes always,
    and with ``ids_are_few`` that of the new ids.
    """
    touched = changed.select(
        F.col(KEY).alias("_key"),
        F.struct(*FOLLOWING).alias("_now"),
        F.lit(False).alias("_gone"),
    ).unionByName(
        gone.select(F.col(KEY).alias("_key"), F.lit(True).alias("_gone")),
        allowMissingColumns=True,
    )
    metadata = F.col("metadata")
    for name in FOLLOWING:
        metadata = metadata.withField(name, F.col(f"_now.{name}"))
    upserted = upsert(vectors, records, ids_are_few)
    return (
        upserted.join(sent(touched, keys_are_few), F.col("metadata.permalink") == F.col("_key"), "left")
        .filter(F.col("_gone").isNull() | ~F.col("_gone"))
        .withColumn(
            "metadata",
            F.when(F.col("_key").isNotNull(), metadata).otherwise(F.col("metadata")),
        )
        .select(*vectors.columns)
    )
