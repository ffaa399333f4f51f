"""Listing ingest: dedupe, flatten topics, keep the wanted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.functions.dates import parse_listing_date
from lexsnap.functions.nested import flatten_codes
from lexsnap.operators.numbering import row_index
from lexsnap.schemas import KEY

# Income tax and value-added tax. A substring match on the joined codes, so
# "12" or "30" match as well; see ``with_any_code`` for whole codes.
WANTED_TOPICS = "2|3"

_SHALLOW_ROWS = 100_000


def dedupe(df: DataFrame, key: str = KEY, latest_by: str | None = None) -> DataFrame:
    """One row per key: the latest by a column, else any row.

    "Any" is the smallest row, so that a recomputed task picks the same one. The
    aggregate combines before the shuffle: copies of a hot key collapse in the
    map tasks.
    """
    rest = [c for c in df.columns if c != key]
    row = F.struct(*rest)
    if latest_by is None:
        kept = F.min(row)
    else:
        kept = F.max_by(row, F.struct(latest_by, *rest))
    return (
        df.groupBy(key).agg(kept.alias("kept")).select(key, "kept.*").select(*df.columns)
    )


def topic_filter(
    df: DataFrame, column: str = "topik", pattern: str = WANTED_TOPICS
) -> DataFrame:
    """Keep rows whose joined codes match ``pattern``."""
    return df.filter(F.col(column).rlike(pattern))


def wanted_rows(listing: DataFrame, pattern: str = WANTED_TOPICS) -> DataFrame:
    """Nested listing rows whose topics match ``pattern``, still nested."""
    return listing.filter(flatten_codes(F.col("topik")).rlike(pattern))


def with_any_code(df: DataFrame, codes: list[str], column: str = "topik") -> DataFrame:
    """Keep rows that hold one of the codes as a whole code."""
    wanted = F.array(*[F.lit(c) for c in codes])
    return df.filter(F.arrays_overlap(F.split(column, " "), wanted))


def ingest_listing(
    listing: DataFrame, pattern: str = WANTED_TOPICS, latest_by: str | None = None
) -> DataFrame:
    """Nested listing rows to flat ones with a unique permalink.

    Where any copy may be kept, flattening and filtering come first: the shuffle
    then carries flat rows of wanted topics only. With an order the latest copy
    decides, also on whether the topic is wanted.
    """
    columns = [
        F.col(KEY),
        F.col("perihal"),
        parse_listing_date(F.col("tanggal_efektif")).alias("tanggal_efektif"),
        F.col("status_dokumen"),
        flatten_codes(F.col("topik")).alias("topik"),
    ]
    if latest_by is None:
        return dedupe(topic_filter(listing.select(*columns), pattern=pattern))
    latest = dedupe(listing, latest_by=latest_by)
    return topic_filter(latest.select(*columns), pattern=pattern)


def listing_page(
    df: DataFrame, page: int, limit: int, by: str = "tanggal_efektif", key: str = KEY
) -> DataFrame:
    """Page ``page`` (from 1) of the table sorted by date, newest first.

    Shallow pages are a top-n. A deep page would make every task keep, and the
    driver gather, all rows before it; there the rows are numbered instead.
    """
    first = (page - 1) * limit
    order = [F.desc(by), F.asc(key)]
    if first + limit <= _SHALLOW_ROWS:
        return df.orderBy(*order).offset(first).limit(limit)
    indexed = row_index(df, order)
    wanted = F.col("row_index").between(first + 1, first + limit)
    return indexed.filter(wanted).drop("row_index").orderBy(*order)
