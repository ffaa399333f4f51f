"""Connected components by union-find inside tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.session import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task; each node but a root points to its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for high, low in zip(batch.column("high").to_pylist(), batch.column("low").to_pylist()):
            a, b = root(high), root(low)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    roots = [root(x) for x in nodes]
    for start in range(0, len(nodes), 1 << 16):
        part = slice(start, start + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(nodes[part], np.int64)), pa.array(np.array(roots[part], np.int64))], ["high", "low"]
        )


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest one around it."""
    around = links.select(F.col("high").alias("node"), F.col("low").alias("other")).union(
        links.select(F.col("low").alias("node"), F.col("high").alias("other"))
    )
    least = around.groupBy("node").agg(F.min("other").alias("least"))
    least = materialize(least, "least")  # stored, so that the join can split a hot node
    moved = around.join(least, "node").where("other > node")
    return moved.select(F.col("other").alias("high"), F.least("node", "least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    least = materialize(least, "least")
    moved = links.join(least, "high").where("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (two long columns) but the roots.

    ``component`` is the smallest node reachable. Nodes without links, and each
    component's smallest node, have no row. Null ends are no links.
    """
    one, other = links.columns
    links = links.select(F.greatest(one, other).alias("high"), F.least(one, other).alias("low"))
    links = links.where(F.col("high").isNotNull() & F.col("low").isNotNull() & (F.col("high") > F.col("low")))
    links = materialize(links.mapInArrow(_forest, "high long, low long"), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low") % 1_000_003)).first()
        if state == before or not state[0]:
            return links.select(F.col("high").alias("node"), F.col("low").alias("component"))
        before = state
        links = materialize(_small_star(_large_star(links)), "links")
