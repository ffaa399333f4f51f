"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime re-planning does the sizing: AQE merges shuffle partitions to the advisory
# size and splits skewed ones. It cannot split ordinary ones, so give ``build_session``
# the input's size, from which it takes their number.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 128 << 20) -> int:
    """Initial shuffle partition count for an input of the given size."""
    return max(8, -(-input_bytes // target_bytes))


def build_session(
    app_name: str = "lexsnap",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    input_bytes: int | None = None,
    **settings: str,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions is None and input_bytes is not None:
        shuffle_partitions = shuffle_partitions_for(input_bytes)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**CLUSTER_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_WORKSPACES: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a private
    folder made, once per application.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    shared = shared or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    app_id = spark.sparkContext.applicationId
    if app_id not in _LOCAL_WORKSPACES:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _LOCAL_WORKSPACES[app_id] = tempfile.mkdtemp(prefix="lexsnap-")
    return _LOCAL_WORKSPACES[app_id]


# Scratch paths given out, by application, for jobs that release theirs.
_GIVEN_OUT: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the workspace."""
    path = f"{workspace(spark)}/lexsnap/{label}-{uuid.uuid4().hex}"
    scratch_paths(spark).append(path)
    return path


def scratch_paths(spark: SparkSession) -> list[str]:
    """The scratch paths given out so far in this application, in order."""
    return _GIVEN_OUT.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    given_out = scratch_paths(spark)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path not in given_out:
            raise ValueError(f"{path} is no scratch path of this application")
        given_out.remove(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(hadoop).delete(folder, True)


def materialize(
    df: DataFrame, label: str, by: str | None = None, codec: str | None = None
) -> DataFrame:
    """Write ``df`` once to the workspace and read it back.

    Cuts the lineage in storage that outlives executors, keeps costly or
    order-dependent work from running twice, and gives the planner true sizes,
    so that it broadcasts a change set only when the set is in fact small.

    With ``by`` the rows lie in Spark's buckets of that column, one per shuffle partition:
    tables stored by the same column are joined on it without a shuffle. ``codec``
    compresses the files, with zstd much more than without.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if codec:
        writer = writer.option("compression", codec)
    if by is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    # The catalog is only the way to name the buckets: what is resolved needs no entry.
    name = f"lexsnap_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def stored_bytes(df: DataFrame) -> int:
    """About the size of a stored table, or of what Spark expects of other rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# Rows of keys that are sent to all executors at most: some 100 to 200 MB.
MAX_SENT_KEYS = 1 << 20


def few(df: DataFrame, most_rows: int = MAX_SENT_KEYS) -> bool:
    """Has this stored table of short rows so few that all executors can hold them?"""
    return df.limit(most_rows + 1).count() <= most_rows


def sent(df: DataFrame, small: bool) -> DataFrame:
    """Marked for broadcast if it is small, whatever Spark's threshold is."""
    return F.broadcast(df) if small else df


# Of text that goes to a Python worker at a time.
BATCH_BYTES = 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands texts to Python in batches of BATCH_BYTES at most.

    The session's setting is lowered where it is higher: a batch exists in the JVM and
    in the worker at once, several times while it is copied. No result depends on it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if size_in_bytes(str(conf.get(key))) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def size_in_bytes(setting: str) -> int:
    """A size as Spark's settings give it: ``4194304``, ``64m``, ``1gb``."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << (10 * (" kmgtp".index(unit) if unit else 0))
