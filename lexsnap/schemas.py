"""Explicit schemas: nothing in the library infers a type from data."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "permalink"

TOPIC = T.StructType(
    [T.StructField("uuid", T.IntegerType()), T.StructField("keterangan", T.StringType())]
)

LISTING = T.StructType(
    [
        T.StructField("permalink", T.StringType()),
        T.StructField("perihal", T.StringType()),
        T.StructField("tanggal_efektif", T.StringType()),
        T.StructField("status_dokumen", T.StringType()),
        T.StructField("topik", T.ArrayType(TOPIC)),
    ]
)

LISTING_PAGE = T.StructType(
    [
        T.StructField("page", T.LongType()),
        T.StructField(
            "data", T.StructType([T.StructField("search_data", T.ArrayType(LISTING))])
        ),
        T.StructField(
            "pagination", T.StructType([T.StructField("total_page", T.LongType())])
        ),
    ]
)

_LINK = T.StructType([T.StructField("permalink", T.StringType())])

# Order of the relation columns is the column order of the regulation table.
RELATION_COLUMNS = ("peraturan_terbaru", "peraturan_sebelumnya", "peraturan_relevan")

DETAIL_RECORD = T.StructType(
    [
        T.StructField("jenis_peraturan", T.StringType()),
        T.StructField("nomor_peraturan", T.StringType()),
        T.StructField("body_final", T.StringType()),
        *(T.StructField(name, T.ArrayType(_LINK)) for name in RELATION_COLUMNS),
        T.StructField("meta", T.StructType([T.StructField("keywords", T.StringType())])),
    ]
)

# One landed detail response per permalink: the record is the first of `data`.
DETAIL_RESPONSE = T.StructType(
    [
        T.StructField("permalink", T.StringType()),
        T.StructField("data", T.ArrayType(DETAIL_RECORD)),
    ]
)

# Columns that come with the listing and can change in place ...
LISTING_COLUMNS = ("perihal", "tanggal_efektif", "status_dokumen", "topik")
# ... and those looked up once per document.
DETAIL_COLUMNS = (
    "jenis_peraturan",
    "nomor_peraturan",
    "body_final",
    *RELATION_COLUMNS,
    "keywords",
)
REGULATION_COLUMNS = (KEY, *LISTING_COLUMNS, *DETAIL_COLUMNS)

REGULATION = T.StructType(
    [
        T.StructField(
            name, T.DateType() if name == "tanggal_efektif" else T.StringType()
        )
        for name in REGULATION_COLUMNS
    ]
)

QA_ITEM = T.StructType(
    [T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())]
)

QA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("permalink", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)

METADATA_COLUMNS = (
    "answer",
    "permalink",
    "status_dokumen",
    "topik",
    "jenis_peraturan",
    "nomor_peraturan",
)

VECTOR_DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType([T.StructField(n, T.StringType()) for n in METADATA_COLUMNS]),
        ),
        T.StructField("document", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

# Documents whose generation failed: ``attempts`` in all, ``rounds`` of them (one per run
# of a job), and when the next round may start.
FAILURE = T.StructType(
    [
        T.StructField("permalink", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("rounds", T.LongType()),
        T.StructField("next_try", T.TimestampType()),
    ]
)
