"""Date parsing and run stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_listing_date(text: Column, strict: bool = True) -> Column:
    """``dd-MM-yyyy`` to date; a bad value is an error unless ``strict`` is off."""
    return (F.to_date if strict else F.try_to_date)(text, "dd-MM-yyyy")


def parse_iso_date(text: Column, strict: bool = True) -> Column:
    return (F.to_date if strict else F.try_to_date)(text, "yyyy-MM-dd")


def jakarta_stamp(ts: Column) -> Column:
    """UTC wall clock (``timestamp_ntz``) to ``yyyyMMddHHmmss`` in Asia/Jakarta.

    Both zones are named, so the session time zone has no say.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Jakarta"), ts)
    return F.date_format(local, "yyyyMMddHHmmss")
