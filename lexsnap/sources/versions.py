"""Versioned Parquet tables published together, rewritten by buckets.

Plain Parquet has no MERGE, and a path cannot be overwritten while it is read. A publish
writes new directories and then appends one row to a small log, so readers see all of
the new tables or none of them. A failed publish leaves directories that no log row
names; the next one rewrites them.

A table is either whole, one directory per version, or in buckets: its rows are dealt to
a fixed number of buckets by their key, and the log row says for each bucket which
version wrote it last. A change set then rewrites the buckets that it touches and all
other directories stay as they are, so the cost of a publish follows the changes and not
the table.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("tables", T.MapType(T.StringType(), T.StringType())),
        T.StructField("buckets", T.MapType(T.StringType(), T.ArrayType(T.LongType()))),
    ]
)

# Tables of a publish that are written at the same time.
_WRITERS = 4

# Of rows that are dealt in place: to a file of a bucket, and in all to a task.
FILE_BYTES = 8 << 20
TASK_BYTES = 96 << 20


@dataclass(frozen=True)
class Version:
    """``tables``: the directory of each table. ``buckets``: of the tables in buckets, the
    version that wrote each bucket, 0 for one without rows."""

    number: int = 0
    snapshot_id: str | None = None
    tables: dict[str, str] = field(default_factory=dict)
    buckets: dict[str, list[int]] = field(default_factory=dict)


@dataclass(frozen=True)
class Rewrite:
    """The next rows of the touched buckets of a table, whole.

    ``key``, a column or the path of a field, deals them out, and sorts them in each file.
    With ``in_place`` they are not shuffled for it: each task writes its rows of a bucket,
    as suits rows that are read from buckets, or come in few partitions.
    """

    rows: DataFrame
    key: str
    touched: Iterable[int]
    in_place: bool = False


def in_few_tasks(rows: DataFrame, stored: int, buckets: int) -> DataFrame:
    """``rows``, of about ``stored`` bytes, in partitions of some size for each bucket.

    A partition stays small enough to be sorted in memory.
    """
    return rows.coalesce(max(1, -(-stored // min(TASK_BYTES, buckets * FILE_BYTES))))


def bucket_of(key: Column | str, buckets: int) -> Column:
    """The bucket of a key. Stable over versions of Spark; null keys are in bucket 0."""
    key = F.col(key) if isinstance(key, str) else key
    number = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return F.coalesce(number % buckets, F.lit(0).cast("long"))


def touched_buckets(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets in which the keys lie: at most ``buckets`` numbers."""
    rows = keys.select(bucket_of(key, buckets).alias("bucket")).distinct()
    return sorted(row["bucket"] for row in rows.collect())


def current_version(spark: SparkSession, root: str) -> Version:
    """The last published version; number 0 when there is none."""
    try:
        log = spark.read.schema(_LOG).json(f"{root}/log")
        last = log.agg(F.max_by(F.struct("*"), "version").alias("last")).first()["last"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        return Version()
    return Version(
        last["version"], last["snapshot_id"], dict(last["tables"]), dict(last["buckets"] or {})
    )


def bucket_paths(
    version: Version, table: str, buckets: Iterable[int] | None = None
) -> dict[int, str]:
    """The directory of each bucket that has rows; of the given buckets only."""
    written = version.buckets[table]
    wanted = range(len(written)) if buckets is None else sorted(set(buckets))
    return {
        bucket: f"{version.tables[table]}/v{written[bucket]:08d}/bucket={bucket}"
        for bucket in wanted
        if written[bucket]
    }


def read_version(
    spark: SparkSession,
    version: Version,
    table: str,
    schema: T.StructType,
    buckets: Iterable[int] | None = None,
) -> DataFrame:
    """A table of a version; empty when the version does not have it.

    With ``buckets`` only these buckets are read, of a table that is kept in buckets.
    """
    # Known to be empty when a query is planned, so that joins with it need no shuffle.
    nothing = spark.createDataFrame([], schema).limit(0)
    if table not in version.tables:
        return nothing
    if table not in version.buckets:
        return spark.read.schema(schema).parquet(version.tables[table])
    paths = list(bucket_paths(version, table, buckets).values())
    if not paths:
        return nothing
    return spark.read.schema(schema).parquet(*paths)


def read_keys(
    spark: SparkSession,
    version: Version,
    table: str,
    schema: T.StructType,
    key: str,
    keys: DataFrame,
) -> DataFrame:
    """The rows of a table in buckets whose ``key`` is in ``keys``, a table of one column.

    Only the buckets that can hold them are opened.
    """
    if table not in version.buckets:
        rows, wanted = read_version(spark, version, table, schema), keys
    else:
        wanted = keys.toDF("_key").filter("_key is not null").distinct()
        touched = touched_buckets(wanted, "_key", len(version.buckets[table]))
        rows = read_version(spark, version, table, schema, touched)
    wanted = wanted.toDF("_key")
    return rows.join(wanted, F.col(key) == F.col("_key"), "left_semi")


def publish(
    spark: SparkSession,
    root: str,
    tables: dict[str, DataFrame],
    snapshot_id: str,
    max_rows_per_file: int = 0,
    rewrites: dict[str, Rewrite] | None = None,
    buckets: int = 1,
    before: Version | None = None,
) -> Version:
    """Write all tables, then make them current with one log row.

    ``tables`` are written whole, ``rewrites`` in their touched buckets. Tables that are
    named in neither stay as they are. ``buckets`` is the number of buckets of a table
    that is new; later its log row has it. ``before`` is the current version, if it is
    known already.
    """
    before = current_version(spark, root) if before is None else before
    number = before.number + 1
    rewrites = rewrites or {}

    def whole(name: str) -> tuple[str, None]:
        path = f"{root}/{name}/v{number:08d}"
        (
            tables[name]
            .write.mode("overwrite")
            .option("maxRecordsPerFile", max_rows_per_file)
            .parquet(path)
        )
        return path, None

    def by_bucket(name: str) -> tuple[str, list[int]]:
        rewrite = rewrites[name]
        written = list(before.buckets.get(name, [0] * buckets))
        touched = set(rewrite.touched)
        if touched:
            path = f"{root}/{name}/v{number:08d}"
            dealt = rewrite.rows.withColumn("bucket", bucket_of(rewrite.key, len(written)))
            # Sorted, and with a Bloom filter of the key: of a bucket that has grown to
            # several row groups, a lookup reads one.
            if not rewrite.in_place:
                dealt = dealt.hint("rebalance", "bucket")
            (
                dealt.sortWithinPartitions("bucket", rewrite.key)
                .write.mode("overwrite")
                .option("compression", "zstd")
                .option("maxRecordsPerFile", max_rows_per_file)
                .option(f"parquet.bloom.filter.enabled#{rewrite.key}", "true")
                .option("parquet.bloom.filter.adaptive.enabled", "true")
                .partitionBy("bucket")
                .parquet(path)
            )
            stored = spark.read.schema(dealt.schema).parquet(path)
            filled = {row["bucket"] for row in stored.select("bucket").distinct().collect()}
            if not filled <= touched:
                raise ValueError(f"{name} has rows in buckets that are not rewritten")
            for bucket in touched:
                written[bucket] = number if bucket in filled else 0
        return f"{root}/{name}", written

    with ThreadPoolExecutor(_WRITERS) as writers:
        jobs = {name: writers.submit(by_bucket, name) for name in rewrites}
        jobs |= {name: writers.submit(whole, name) for name in tables}
        done = {name: job.result() for name, job in jobs.items()}
    paths = before.tables | {name: path for name, (path, _) in done.items()}
    in_buckets = {n: b for n, b in before.buckets.items() if n not in done}
    in_buckets |= {n: b for n, (_, b) in done.items() if b is not None}
    entry = spark.createDataFrame([(number, snapshot_id, paths, in_buckets)], _LOG)
    entry.coalesce(1).write.mode("append").json(f"{root}/log")
    return Version(number, snapshot_id, paths, in_buckets)
