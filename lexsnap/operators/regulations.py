"""The regulation table: detail lookup, cleaning, topic dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsnap.functions.nested import flatten_links
from lexsnap.functions.text import clean_body
from lexsnap.schemas import DETAIL_COLUMNS, KEY, LISTING_COLUMNS, RELATION_COLUMNS


def first_record(responses: DataFrame) -> DataFrame:
    """Landed detail responses to ``(permalink, detail)``; no record gives null."""
    return responses.select(KEY, F.get("data", F.lit(0)).alias("detail"))


def with_detail(listing: DataFrame, responses: DataFrame) -> DataFrame:
    """Add each row's detail record; rows without one keep a null struct.

    Needs one response per permalink. The strategy is left to the planner: the
    thin listing side is broadcast when it is small, as on a daily run.
    """
    return listing.join(first_record(responses), KEY, "left")


def looked_up(index: DataFrame, listing: DataFrame) -> DataFrame:
    """The rows of a thin index of the details whose keys are listed.

    Put it before the join that attaches the bodies: then only the bodies of listed
    documents are shuffled. Keys alone are compared, and broadcast while they are few.
    """
    return index.join(listing.select(KEY), KEY, "left_semi")


def detail_fields(detail: str = "detail") -> list[Column]:
    """The record's columns, with the keywords taken from ``meta``."""
    plain = [F.col(f"{detail}.{c}").alias(c) for c in DETAIL_COLUMNS if c != "keywords"]
    return [*plain, F.col(f"{detail}.meta.keywords").alias("keywords")]


def clean_regulations(enriched: DataFrame, default_empty: bool = False) -> DataFrame:
    """Listing columns plus detail struct to the flat regulation table."""
    return (
        enriched.select(KEY, *LISTING_COLUMNS, *detail_fields())
        .withColumn("body_final", clean_body(F.col("body_final")))
        .withColumns(
            {c: flatten_links(F.col(c), default_empty) for c in RELATION_COLUMNS}
        )
    )


def topic_dimension(listing: DataFrame) -> DataFrame:
    """Distinct topics, sorted by code; an empty list shows as a null row."""
    return listing.select(F.inline_outer("topik")).distinct().orderBy("uuid")
