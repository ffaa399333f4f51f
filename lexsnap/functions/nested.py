"""List columns: per-element field access, sort, join, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element_field(items: Column, field: str) -> Column:
    """``array<struct>`` to ``array<string>`` of one field."""
    return F.transform(items, lambda item: item[field].cast("string"))


def sorted_join(values: Column, separator: str = " ") -> Column:
    """Sort strings as text and join them; nulls inside are skipped.

    An empty list gives ``""`` and a null list gives null.
    """
    return F.array_join(F.sort_array(values), separator)


def flatten_codes(topics: Column) -> Column:
    """Topic list to sorted, space-separated codes (``"10"`` before ``"2"``)."""
    return sorted_join(element_field(topics, "uuid"))


def flatten_links(relations: Column, default_empty: bool = False) -> Column:
    """Relation list to sorted, space-separated permalinks."""
    links = element_field(relations, "permalink")
    return sorted_join(default_if_empty(links) if default_empty else links)


def default_if_empty(values: Column, default: str = "") -> Column:
    """An empty list becomes a list of one default; a null list stays null."""
    return F.when(F.size(values) == 0, F.array(F.lit(default))).otherwise(values)
