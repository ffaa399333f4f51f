"""Running counts and row numbers that survive hot keys."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexsnap.session import materialize


def running_sum(
    df: DataFrame,
    key: str,
    order: str,
    value: Column,
    out: str,
    rows_per_slice: int | None = None,
    slice_by: Column | None = None,
) -> DataFrame:
    """Running sum of ``value`` per key, in ``order``, the row itself included.

    ``order`` is unique within its key. A key's rows are cut into slices along it,
    summed up within the slice, and moved up by the total of the earlier slices, so
    no task ever holds all rows of a hot key. The slices are ranges of (key, order)
    of about equal row counts, stored once, whatever gaps the order has. Where the
    order is a whole number without gaps, ``rows_per_slice`` cuts it by value, and
    ``slice_by`` may be any expression that never decreases along it: then nothing is
    stored.
    """
    if slice_by is None and rows_per_slice is not None:
        slice_by = F.expr(f"`{order}` div {rows_per_slice}")
    if slice_by is None:
        ranged = df.withColumn("_value", value).repartitionByRange(key, order)
        sliced = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    else:
        sliced = df.withColumns({"_slice": slice_by, "_value": value})

    earlier = Window.partitionBy(key).orderBy("_slice")
    before = (
        sliced.groupBy(key, "_slice")
        .agg(F.sum("_value").alias("_total"))
        .withColumn(
            "_before",
            F.sum("_total").over(earlier.rowsBetween(Window.unboundedPreceding, -1)),
        )
        # Only keys that span slices are left, so this side is small as a rule.
        .filter("_before <> 0")
        .select(F.col(key).alias("_key"), F.col("_slice").alias("_s"), "_before")
    )

    within = Window.partitionBy(key, "_slice").orderBy(order)
    summed = sliced.withColumn(
        "_within", F.sum("_value").over(within.rowsBetween(Window.unboundedPreceding, 0))
    )
    same_slice = (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_s"))
    total = F.col("_within") + F.coalesce("_before", F.lit(0))
    return (
        summed.join(before, same_slice, "left")
        .withColumn(out, total)
        .select(*df.columns, out)
    )


def running_count(
    df: DataFrame, key: str, order: str, out: str = "id", **slicing
) -> DataFrame:
    """1-based running count of non-null keys per key, in ``order``."""
    counted = F.col(key).isNotNull().cast("int")
    return running_sum(df, key, order, counted, out, **slicing)


def row_index(df: DataFrame, order: list[Column], out: str = "row_index") -> DataFrame:
    """1-based position of each row in a total order.

    The rows are range-partitioned and written once with their place inside the
    partition; then the partition sizes, one number per partition, give each
    partition its offset. No window over the whole table.
    """
    spark = df.sparkSession
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "row-index",
    )
    # monotonically_increasing_id: partition number above bit 33, row below.
    located = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn(
        "_pos", F.col("_place").bitwiseAND((1 << 33) - 1)
    )
    sizes = sorted(map(tuple, located.groupBy("_part").count().collect()))
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = spark.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)],
        "_part long, _start long",
    )
    return (
        located.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_start") + F.col("_pos") + 1)
        .select(*df.columns, out)
    )


def batch_number(
    df: DataFrame, order: list[Column], max_rows: int, out: str = "batch"
) -> DataFrame:
    """0-based number of the slice of ``max_rows`` rows a row falls into."""
    indexed = row_index(df, order, "_row")
    return indexed.withColumn(
        out, F.floor((F.col("_row") - 1) / max_rows).cast("long")
    ).drop("_row")
