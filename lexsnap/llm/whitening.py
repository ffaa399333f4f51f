"""Whitening of embeddings with MLlib's BlockMatrix.

The entries are made whole numbers first, so that sums, means and deviations are exact
and equal vectors count once whatever their order. The distinct vectors, less their
mean, are indexed and dealt out as blocks of a BlockMatrix; its transpose times itself
is the scatter. The eigenvectors of that small matrix are found on the driver, and the
rows times the whitening matrix, again as blocks, are the whitened vectors.

The middle dimension of the scatter's product is split, so that no task receives the
blocks of the whole table (MLlib's own default would send them all to one).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexsnap.session import materialize

SCALE, SHIFT = 64, 1_000_000
MOST = float(1 << 52)  # scaled entries beyond it take this bound: they have no whole-number digits left
COMPONENTS = 16
BLOCK_ROWS, BLOCK_COLUMNS = 4096, 1024
BLOCKS_PER_TASK = 8  # of the scatter's product: 16 MB a side at 64 dimensions
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)``: the vectors of finite entries as whole numbers.

    Left out are null vectors, those with null, NaN or infinite entries and those
    without entries.
    """
    entries = F.col("embedding").cast("array<double>")
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bounded = F.transform("_v", lambda c: F.least(F.greatest(c * SCALE, F.lit(-MOST)), F.lit(MOST)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("_v"))
    rows = rows.where((F.size("_v") > 0) & finite)
    return rows.select("vec_id", F.transform(bounded, lambda c: F.floor(c).cast("long") + SHIFT).alias("x"))


def _indexed(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored, with ``index``: its rows numbered from 0 without gaps."""
    stored = materialize(df.withColumn("_at", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # a row per task
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("index", F.col("_before") + place)
        .drop("_at", "_part", "_before")
    )


class _Fit:
    """Count, sums and mean of the distinct vectors of one width."""

    def __init__(self, fit: DataFrame):
        sums = fit.select(F.posexplode("x").alias("dim", "value")).groupBy("dim")
        sums = sums.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).orderBy("dim").collect()
        self.n, self.sums = sums[0].n, [int(r.total) for r in sums]
        self.width = len(sums)

    def _offsets(self, x: str = "x"):
        """n * x - S per entry, null where it does not fit in a long."""
        fits = [s if abs(s) < 1 << 63 else None for s in self.sums]
        sums = F.array(*(F.lit(s).cast("long") for s in fits))
        return F.zip_with(x, sums, lambda a, s: F.try_subtract(F.try_multiply(a, F.lit(self.n).cast("long")), s))

    def deviation(self):
        squares = F.transform(self._offsets(), lambda y: F.try_multiply(y, y))
        return F.aggregate(squares, F.lit(0).cast("long"), F.try_add)

    def centred(self, rows: DataFrame) -> IndexedRowMatrix:
        """The rows less the mean; the difference is taken in whole numbers where they fit."""
        means = F.array(*(F.lit(s / self.n) for s in self.sums))
        plain = F.zip_with("x", means, lambda a, m: a.cast("double") - m)
        exact = F.transform(self._offsets(), lambda y: y.cast("double") / self.n)
        entries = F.zip_with(exact, plain, lambda e, p: F.coalesce(e, p))
        rows = rows.select(F.col("index"), array_to_vector(entries).alias("vector"))
        return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector"), numCols=self.width)


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix itself, the middle dimension split among tasks."""
    splits = max(1, blocks.numRowBlocks // BLOCKS_PER_TASK)
    factor = blocks._java_matrix_wrapper
    # PySpark's multiply does not pass on the number of splits that MLlib's has.
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", factor._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _local(spark: SparkSession, matrix: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A small matrix as a BlockMatrix, cut along its rows."""
    parts = [
        ((k, 0), Matrices.dense(len(part), matrix.shape[1], part.flatten(order="F").tolist()))
        for k, part in enumerate(np.split(matrix, range(rows_per_block, len(matrix), rows_per_block)))
    ]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), rows_per_block, matrix.shape[1], *matrix.shape)


def _whitening(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors over their square roots, a column each.

    A component without variance has the eigenvalue 0 and a column of zeros.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    values = np.where(values > values[0] * len(covariance) * np.finfo(float).eps, values, 0.0)
    lengths = np.sqrt(np.where(values > 0, values, 1.0))
    return values, vectors * np.where(values > 0, 1 / lengths, 0.0)


def _whitened(rows: DataFrame, components: int) -> DataFrame:
    """The rows ``(vec_id, x)`` of one width."""
    spark = rows.sparkSession
    distinct = _indexed(rows.select("x").distinct(), "fit")
    fit = _Fit(distinct)
    columns = min(BLOCK_COLUMNS, fit.width)
    blocks = fit.centred(distinct).toBlockMatrix(BLOCK_ROWS, columns)
    covariance = _scatter(blocks) / fit.n
    values, matrix = _whitening(covariance, min(components, fit.width))
    factor = _local(spark, matrix, columns)

    # Measured on the whitened vectors themselves, not on the matrices they come from.
    told = np.flatnonzero(values > 0)
    spread = (_scatter(blocks.multiply(factor)) / fit.n)[np.ix_(told, told)]
    error = float(np.abs(spread - np.eye(len(told))).max(initial=0.0))

    numbered = _indexed(rows, "vectors")
    projected = fit.centred(numbered).toBlockMatrix(BLOCK_ROWS, columns).multiply(factor).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).toDF("index", "vector")
    trace = float(np.trace(covariance))
    known = F.array(*(F.lit(bool(v > 0)) for v in values))
    shares = F.array(*(F.lit(float(v / trace) if trace > 0 else 0.0) for v in values))
    return (
        numbered.select("index", "vec_id", fit.deviation().alias("deviation"))
        .join(projected, "index")
        .select("vec_id", "deviation", F.posexplode(vector_to_array("vector")).alias("_place", "_value"))
        .select(
            "vec_id",
            (F.col("_place") + 1).alias("component"),
            F.lit(fit.n).cast("long").alias("n"),
            "deviation",
            F.when(F.get(known, F.col("_place")), F.col("_value")).alias("whitened"),
            F.get(shares, F.col("_place")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per row of ``(vec_id, embedding, …)`` and component, up to ``components``.

    ``(vec_id, component, n, deviation, whitened, explained, identity_error)``. Each entry
    is floor(64 * entry) + 1,000,000; the fit is over the n distinct vectors. Unusable
    vectors (see ``quantised``) have no rows; those that share a vec_id, or have none,
    each have their own. Vectors of different lengths are fitted and whitened apart. A
    component without variance has the whitened value null and explains 0;
    ``identity_error`` is over the others. ``deviation`` is exact, and null where it does
    not fit in a long. Other columns are not read; a table without usable vectors gives
    no rows.
    """
    rows = materialize(quantised(vectors), "quantised")
    widths = [r.width for r in rows.groupBy(F.size("x").alias("width")).count().orderBy("width").collect()]
    parts = [_whitened(rows.where(F.size("x") == w), components) for w in widths]
    if not parts:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
