"""Flat tables as CSV, JSON and Parquet."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsnap.sources.framing import CsvFraming, JsonArrayFraming, framed, parsed

# Quoted fields may hold newlines and quotes, so records can span lines. The
# line separator is named: detection would take a CR inside a text for one.
_CSV_FORMAT = {"header": "true", "escape": '"', "lineSep": "\n"}
_CSV_READ = {
    **_CSV_FORMAT,
    "multiLine": "true",
    # An unquoted empty field is null and a quoted one is empty text. The marker
    # stands for the unquoted one while reading and cannot occur in data.
    "nullValue": "\u0001null\u0001",
    "mode": "FAILFAST",
}
_CSV_WRITE = {
    **_CSV_FORMAT,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, splittable: bool = False
) -> DataFrame:
    """CSV with a header, whose quoted fields may hold line ends.

    One task reads each file, unless ``splittable``: then a large file is dealt to many,
    for one more pass over the text beforehand.
    """
    if not splittable:
        return spark.read.schema(schema).options(**_CSV_READ).csv(path)
    records = framed(spark, path, CsvFraming).filter(~F.col("first"))
    names = [f.name for f in _struct(schema).fields]
    options = {k: v for k, v in _CSV_READ.items() if k not in ("header", "lineSep")}
    return parsed(records, F.from_csv("text", _ddl(schema), options)).select(*names)


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _ddl(schema: T.StructType | str) -> str:
    if isinstance(schema, str):
        return schema
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.options(**_CSV_WRITE).mode(mode).csv(path)


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    array_of_rows: bool = False,
    splittable: bool = False,
) -> DataFrame:
    """JSON lines, or with ``array_of_rows`` files that hold one array of objects each.

    One task reads each array, unless ``splittable``: then a large one is dealt to many,
    for one more pass over the text beforehand.
    """
    if array_of_rows and splittable:
        records = framed(spark, path, JsonArrayFraming)
        return parsed(records, F.from_json("text", _struct(schema), {"mode": "FAILFAST"}))
    return (
        spark.read.schema(schema)
        .option("multiLine", array_of_rows)
        .option("mode", "FAILFAST")
        .json(path)
    )


def write_json(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partition_by: str | None = None,
    array_of_rows: bool = False,
    compression: str | None = None,
) -> None:
    """JSON lines, or with ``array_of_rows`` files that hold one array each."""
    if array_of_rows:
        rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        rows.mapInArrow(_as_array, "value string").write.mode(mode).text(path)
        return
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.json(path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of an array: each row behind a bracket or a comma."""
    before = "["
    for batch in batches:
        if batch.num_rows:
            marks = pa.array([before] + [","] * (batch.num_rows - 1))
            lines = pc.binary_join_element_wise(marks, batch.column("value"), "")
            yield pa.RecordBatch.from_arrays([lines], ["value"])
            before = ","
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], ["value"])


def json_rows(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Rows given as JSON text in a column, to columns of the given types."""
    return df.withColumn(
        column, F.from_json(column, schema, {"mode": "FAILFAST"})
    ).select(*[c for c in df.columns if c != column], f"{column}.*")


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    array_of_rows: bool = False,
    cache: bool = False,
) -> DataFrame:
    """Read a table by the suffix of its path: ``.csv`` or ``.json``.

    ``cache`` keeps a small, often used table (such as the topics) in memory.
    """
    match PurePosixPath(path).suffix:
        case ".csv":
            table = read_csv(spark, path, schema)
        case ".json":
            table = read_json(spark, path, schema, array_of_rows)
        case _:
            raise ValueError(f"Unsupported file extension: {path}")
    return table.cache() if cache else table


def promote(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Publish a cleaned table under a new path."""
    table = spark.read.parquet(source)
    table.write.mode("errorifexists").parquet(target)
    return spark.read.schema(table.schema).parquet(target)
