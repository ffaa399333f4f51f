"""Nearest records by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsnap.session import materialize

# Largest query set sent to every task.
MAX_SENT_QUERIES = 4096
MAX_SENT_BYTES = 128 << 20
_BLOCK = 128
# Tasks whose finds meet before those of all tasks do.
TASKS_PER_GROUP = 256


class _Best:
    """The k nearest records so far, for each of a bounded set of queries.

    A matrix product gives rough distances. Whatever lies within its rounding
    error of the k-th place is measured again, difference by difference, so that
    equal vectors get equal distances and ties fall to the smaller id.
    """

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors = vectors
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.k = k
        empty = np.empty(0)
        self.distances = [empty] * len(vectors)
        self.ids: list[np.ndarray | None] = [None] * len(vectors)
        self.limits = np.full(len(vectors), np.inf)

    def add(
        self,
        ids: np.ndarray,
        matrix: np.ndarray,
        admitted: Callable[[slice], np.ndarray] | None = None,
    ) -> None:
        """Take in records; ``admitted`` masks them per block of queries."""
        norms = np.einsum("ij,ij->i", matrix, matrix)
        largest = norms.max(initial=0.0)
        for start in range(0, len(self.vectors), _BLOCK):
            block = slice(start, start + _BLOCK)
            rough = norms - 2.0 * (self.vectors[block] @ matrix.T)
            rough += self.norms[block, None]
            if admitted is not None:
                rough[~admitted(block)] = np.inf
            slack = 1e-9 * (largest + self.norms[block])
            limit = self.limits[block]
            if len(ids) > self.k:
                kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
                limit = np.minimum(limit, kth + slack)
            near = (rough <= (limit + slack)[:, None]) & np.isfinite(rough)
            for q in np.flatnonzero(near.any(axis=1)):
                rows = np.flatnonzero(near[q])
                self._keep(start + q, ids[rows], matrix[rows])

    def _keep(self, q: int, ids: np.ndarray, matrix: np.ndarray) -> None:
        difference = matrix - self.vectors[q]
        distances = (difference * difference).sum(axis=1)
        if self.ids[q] is not None:
            distances = np.concatenate([self.distances[q], distances])
            ids = np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, distances))[: self.k]
        self.distances[q], self.ids[q] = distances[order], ids[order]
        if len(order) == self.k:
            self.limits[q] = distances[order[-1]]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _values(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _batches(best: _Best, query_ids: pa.Array, names: list) -> Iterator[pa.RecordBatch]:
    for q, ids in enumerate(best.ids):
        if ids is not None:
            columns = [
                pa.array([query_ids[q].as_py()] * len(ids), query_ids.type),
                pa.array(ids),
                pa.array(best.distances[q]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


def _comparable(vector: str) -> Column:
    """Has the vector no null, NaN or infinite element?"""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def incomparable(docs: DataFrame, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Ids of the rows that a search passes over: no vector, or one that is not finite."""
    return docs.filter(~_comparable(vector)).select(id_col)


def _query_blocks(
    queries: DataFrame, query_id: str, vector: str, max_rows: int
) -> list[DataFrame]:
    """The queries in blocks of about ``max_rows`` rows and MAX_SENT_BYTES at most.

    Their number and width are aggregated first, so nothing large is fetched.
    """
    count, width = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    most = max(1, min(max_rows, MAX_SENT_BYTES // (8 * (width or 0) + 64)))
    if count <= most:
        return [queries]
    queries = materialize(queries, "queries")
    blocks = -(-2 * count // most)
    number = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    return [queries.filter(number == block) for block in range(blocks)]


def _ranked(found: DataFrame, query_id: str, id_col: str, k: int) -> DataFrame:
    """k rows per query: first of each group of tasks, then of all groups."""
    order = ["distance", id_col]
    grouped = found.withColumn("_group", F.floor(F.spark_partition_id() / TASKS_PER_GROUP))
    some = Window.partitionBy(query_id, "_group").orderBy(*order)
    grouped = grouped.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    every = Window.partitionBy(query_id).orderBy(*order)
    return (
        grouped.withColumn("rank", F.row_number().over(every))
        .filter(F.col("rank") <= k)
        .select(query_id, F.col("rank").cast("long").alias("rank"), id_col, "distance")
    )


def _per_block(blocks: list[DataFrame], search: Callable[[pa.Table], DataFrame]) -> DataFrame:
    """The search for each block; of several, each result is stored before the next."""
    if len(blocks) == 1:
        return search(blocks[0].toArrow().combine_chunks())
    found = [materialize(search(block.toArrow().combine_chunks()), "found") for block in blocks]
    return reduce(DataFrame.union, found)


def nearest(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    query_id: str = "query_id",
    vector: str = "embedding",
    max_sent_queries: int = MAX_SENT_QUERIES,
) -> DataFrame:
    """The exact k nearest records per query: ``(query_id, rank, id, distance)``.

    Filter ``docs`` beforehand for a filtered search. The records are neither
    shuffled nor paired with the queries: each task scans its records once and
    hands on k rows per query. That needs all queries of a block in each task, so a
    block's size is bounded before it is fetched; a larger set takes several scans.
    Vectors that are not finite are passed over, see ``incomparable``.
    """
    docs = docs.select(id_col, vector).filter(_comparable(vector))
    queries = queries.select(query_id, vector).filter(_comparable(vector))
    schema = T.StructType(
        [
            queries.schema[query_id],
            docs.schema[id_col],
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def search(sent: pa.Table) -> DataFrame:
        found = _scan(docs, sent, k, id_col, query_id, vector, schema)
        return _ranked(found, query_id, id_col, k)

    return _per_block(_query_blocks(queries, query_id, vector, max_sent_queries), search)


def _scan(docs, sent, k, id_col, query_id, vector, schema) -> DataFrame:
    spark = docs.sparkSession
    if sent.num_rows == 0:
        return spark.createDataFrame([], schema)
    query_ids = sent[query_id].combine_chunks()
    # A broadcast, because a closure would be sent with every task.
    query_matrix = spark.sparkContext.broadcast(_matrix(sent[vector]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(query_matrix.value, k)
        for batch in batches:
            if batch.num_rows:
                best.add(_values(batch.column(id_col)), _matrix(batch.column(vector)))
        yield from _batches(best, query_ids, schema.names)

    return docs.mapInArrow(scan, schema)


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Random directions, ``tables x bits x dim``."""
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def _sign_codes(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Per row and table, the signs of the projections as one number."""
    tables, bits, dim = planes.shape
    signs = (matrix @ planes.reshape(tables * bits, dim).T) > 0
    return signs.reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def build_lsh_index(
    docs: DataFrame,
    path: str,
    dim: int,
    id_col: str = "id",
    vector: str = "embedding",
    tables: int = 4,
    bits: int = 6,
    seed: int = 42,
) -> DataFrame:
    """Write the records once per hash table, in a directory per code.

    A search then reads only the directories of its own codes.
    """
    docs = docs.select(id_col, vector).filter(_comparable(vector))
    planes = hyperplanes(dim, tables, bits, seed)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = _sign_codes(_matrix(batch.column(vector)), planes)
                offsets = np.arange(0, codes.size + 1, tables, dtype=np.int32)
                lists = pa.ListArray.from_arrays(offsets, codes.ravel())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, lists], [*batch.schema.names, "codes"]
                )

    placed = docs.mapInArrow(encode, schema).select(
        "*", F.posexplode("codes").alias("tbl", "code")
    )
    placed.write.partitionBy("tbl", "code").mode("errorifexists").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def nearest_lsh(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    id_col: str = "id",
    query_id: str = "query_id",
    vector: str = "embedding",
    tables: int = 4,
    bits: int = 6,
    seed: int = 42,
    max_sent_queries: int = MAX_SENT_QUERIES,
) -> DataFrame:
    """Approximate k nearest: the nearest among records that share a code.

    An optional search over a stored index, which reads only the directories of
    the queries' codes. It can miss neighbours (see ``recall``); ``nearest`` is the
    exact search. As there, queries go in blocks of bounded size, and a task hands on
    k rows per query, however full a directory is. A record counts in the first table
    where it meets the query.
    """
    queries = queries.select(query_id, vector).filter(_comparable(vector))

    def search(sent: pa.Table) -> DataFrame:
        found = _scan_codes(index, sent, k, dim, id_col, query_id, vector, tables, bits, seed)
        return _ranked(found, query_id, id_col, k)

    return _per_block(_query_blocks(queries, query_id, vector, max_sent_queries), search)


def _scan_codes(
    index, sent, k, dim, id_col, query_id, vector, tables, bits, seed
) -> DataFrame:
    query_schema = index.sparkSession.createDataFrame(sent.slice(0, 0)).schema
    schema = T.StructType(
        [
            query_schema[query_id],
            index.schema[id_col],
            T.StructField("distance", T.DoubleType()),
        ]
    )
    if sent.num_rows == 0:
        return index.sparkSession.createDataFrame([], schema)
    query_ids = sent[query_id].combine_chunks()
    query_codes = _sign_codes(_matrix(sent[vector]), hyperplanes(dim, tables, bits, seed))
    # At most 2 ** bits codes per table, whatever the number of queries.
    wanted = reduce(
        or_,
        (
            (F.col("tbl") == t) & F.col("code").isin(np.unique(query_codes[:, t]).tolist())
            for t in range(tables)
        ),
    )
    shared = index.sparkSession.sparkContext.broadcast((_matrix(sent[vector]), query_codes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_matrix, asked = shared.value
        best = _Best(query_matrix, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _matrix(batch.column("codes")).astype(np.int64)
            table = _values(batch.column("tbl"))

            def admitted(block: slice) -> np.ndarray:
                same = asked[block, None, :] == codes[None, :, :]
                return same.any(axis=2) & (same.argmax(axis=2) == table[None, :])

            ids, matrix = _values(batch.column(id_col)), _matrix(batch.column(vector))
            best.add(ids, matrix, admitted)
        yield from _batches(best, query_ids, schema.names)

    found = index.filter(wanted).select(id_col, vector, "codes", "tbl")
    return found.mapInArrow(scan, schema)


def recall(
    exact: DataFrame, approximate: DataFrame, query_id: str, id_col: str
) -> DataFrame:
    """Share of the exact neighbours found, per query: ``(query_id, recall)``."""
    hits = approximate.select(query_id, id_col, F.lit(1).alias("_hit"))
    return (
        exact.join(hits, [query_id, id_col], "left")
        .groupBy(query_id)
        .agg((F.count("_hit") / F.count("*")).alias("recall"))
    )
