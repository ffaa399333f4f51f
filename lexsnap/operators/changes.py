"""Snapshot diff and merge."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.operators.regulations import clean_regulations, with_detail
from lexsnap.schemas import DETAIL_COLUMNS, KEY, LISTING_COLUMNS, REGULATION_COLUMNS
from lexsnap.session import sent

OPERATIONS = ("insert", "update", "delete", "same")


def require_keys(df: DataFrame, key: str = KEY, unique: bool = True) -> None:
    """Raise if a key is null or, when ``unique``, occurs twice.

    A null key matches nothing, so it would count as inserted and deleted.
    """
    if unique:
        df = df.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1))
    else:
        df = df.filter(F.col(key).isNull())
    wrong = df.select(key).first()
    if wrong is not None:
        if wrong[key] is None:
            raise ValueError(f"{key} is null in some row")
        raise ValueError(f"{key} {wrong[key]!r} is not unique")


def compare_snapshots(
    old: DataFrame,
    new: DataFrame,
    compare: tuple[str, ...] = LISTING_COLUMNS,
    key: str = KEY,
    null_safe: bool = False,
) -> DataFrame:
    """``(op, key, compared columns)`` for every key of either snapshot.

    One full outer join over the key and the compared columns; wide columns stay
    out of the shuffle. Presence is told by flags, because data may be null.
    Inserted, updated and unchanged rows show new values, deleted ones old values.
    A change from or to null is no update by itself, unless ``null_safe``.
    """
    was = old.select(F.col(key).alias("_key"), F.struct(*compare).alias("_old"))
    left = new.select(key, *compare, F.lit(True).alias("_in_new"))
    right = was.withColumn("_in_old", F.lit(True))
    both = left.join(right, F.col(key) == F.col("_key"), "full_outer")

    def differs(column: str):
        if null_safe:
            return ~F.col(column).eqNullSafe(F.col(f"_old.{column}"))
        return F.col(column) != F.col(f"_old.{column}")

    op = (
        F.when(F.col("_in_old").isNull(), "insert")
        .when(F.col("_in_new").isNull(), "delete")
        .when(reduce(or_, map(differs, compare)), "update")
        .otherwise("same")
    )
    gone = F.col("_in_new").isNull()
    return both.select(
        op.alias("op"),
        F.when(gone, F.col("_key")).otherwise(F.col(key)).alias(key),
        *(
            F.when(gone, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c)
            for c in compare
        ),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """The change set: rows of ``compare_snapshots`` that are not the same."""
    return compare_snapshots(old, new, **options).filter("op <> 'same'")


def change_summary(compared: DataFrame) -> DataFrame:
    """Row count per operation, zeros included, as ``(op, n)``."""
    counts = compared.agg(*(F.count_if(F.col("op") == op).alias(op) for op in OPERATIONS))
    return counts.unpivot([], list(OPERATIONS), "op", "n")


def inserted(changes: DataFrame) -> DataFrame:
    """Inserted rows in the regulation layout, detail columns still empty."""
    return (
        changes.filter("op = 'insert'")
        .withColumns({c: F.lit("") for c in DETAIL_COLUMNS})
        .select(*REGULATION_COLUMNS)
    )


def updated(changes: DataFrame, old: DataFrame, keys_are_few: bool = False) -> DataFrame:
    """Changed rows: listing columns are new, detail columns are the stored ones.

    With ``keys_are_few`` the keys are sent to all executors, and only the stored rows
    that have changed are shuffled.
    """
    listing = changes.filter("op = 'update'").select(KEY, *LISTING_COLUMNS)
    if keys_are_few:
        old = old.join(sent(listing.select(KEY), True), KEY, "left_semi")
    return listing.join(old.select(KEY, *DETAIL_COLUMNS), KEY).select(*REGULATION_COLUMNS)


def deleted(changes: DataFrame) -> DataFrame:
    """Keys that are gone."""
    return changes.filter("op = 'delete'").select(KEY)


def with_details(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Look up and clean the detail columns of inserted (or changed) rows."""
    listing = rows.select(KEY, *LISTING_COLUMNS)
    return clean_regulations(with_detail(listing, responses), default_empty=True)


def snapshot_merge(
    old: DataFrame,
    changes: DataFrame,
    fresh: DataFrame,
    refresh_updates: bool = False,
    changed: DataFrame | None = None,
    keys_are_few: bool = False,
) -> DataFrame:
    """The next regulation table.

    ``fresh`` holds the complete inserted rows. The stored table is read once and
    joined with the keys to update or delete; while these are few, Spark
    broadcasts them and the wide table is not shuffled. Stored rows whose key is
    null match no change and stay. With ``refresh_updates`` the updated rows are
    in ``fresh`` too and replace the stored ones whole. Where the updated rows are stored
    already, give them as ``changed``: then the keys alone are compared, and sent to
    all executors if they are few, and no text is shuffled.
    """
    if changed is not None:
        keys = changes.filter("op in ('update', 'delete')").select(KEY)
        kept = old.join(sent(keys, keys_are_few), KEY, "left_anti").select(*REGULATION_COLUMNS)
        if not refresh_updates:
            kept = kept.unionByName(changed.select(*REGULATION_COLUMNS))
        return kept.unionByName(fresh.select(*REGULATION_COLUMNS))
    touched = changes.filter("op in ('update', 'delete')").select(
        F.col(KEY).alias("_key"),
        F.col("op").alias("_op"),
        F.struct(*LISTING_COLUMNS).alias("_new"),
    )
    stays = F.col("_op").isNull()
    if not refresh_updates:
        stays = stays | (F.col("_op") == "update")
    is_update = F.col("_op") == "update"
    kept = (
        old.join(touched, F.col(KEY) == F.col("_key"), "left")
        .filter(stays)
        .select(
            KEY,
            *(
                F.when(is_update, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
                for c in LISTING_COLUMNS
            ),
            *DETAIL_COLUMNS,
        )
    )
    return kept.unionByName(fresh.select(*REGULATION_COLUMNS))
