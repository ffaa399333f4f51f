"""Mixing sources to target weights by Poisson replication, in native functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsnap.session import materialize

# A rate above PART_RATE is drawn as the sum of independent parts below it. Beyond
# LAST_COUNT a part's distribution has less than the 2^-52 that a draw can tell apart.
PART_RATE = 32
LAST_COUNT = 127


def uniform(*parts: Column) -> Column:
    """A hash of the parts as a double in [0, 1)."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _distribution(rate: Column) -> Column:
    """Cumulated Poisson probabilities of 0, 1, … LAST_COUNT."""
    empty = F.lit(None).cast("array<double>")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("sums"))

    def add(state: Column, k: Column) -> Column:
        p = state.p * rate / k
        return F.struct(p.alias("p"), (state.total + p).alias("total"), F.concat(state.sums, F.array(state.total + p)).alias("sums"))

    counts = F.sequence(F.lit(1), F.lit(LAST_COUNT))
    return F.coalesce(F.aggregate(counts, start, add, lambda s: s.sums), empty)


def repetition_rates(docs: DataFrame, weights: Mapping[str, int], default: int = 1, epochs: int = 1) -> DataFrame:
    """``(group_key, rate, parts, sums)`` per source.

    A source's share of the mixture is its weight over the weights of all sources that
    occur; the mixture is ``epochs`` times as long as the input. A document's length is
    its characters plus one. Weights are whole numbers, so shares do not depend on the
    order of a sum. A rate is the mean number of copies of each document of the source.
    """
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("size")
    sizes = docs.groupBy(F.col("source").cast("string").alias("group_key")).agg(size)
    weight = F.lit(default)
    for name, value in weights.items():
        weight = F.when(F.col("group_key") == name, F.lit(value)).otherwise(weight)
    sizes = materialize(sizes.withColumn("weight", weight.cast("long")), "source-sizes")
    total = sizes.agg(F.sum("size"), F.sum("weight")).first()
    length, shares = (total[0] or 0) * epochs, total[1] or 1
    rate = (F.col("weight") * F.lit(length)).cast("double") / (F.col("size") * F.lit(shares)).cast("double")
    parts = F.greatest(F.ceil(rate / PART_RATE), F.lit(1))
    rates = sizes.select("group_key", rate.alias("rate"), parts.cast("int").alias("parts"))
    return materialize(rates.withColumn("sums", _distribution(F.col("rate") / F.col("parts"))), "rates")


def mixed(
    docs: DataFrame, weights: Mapping[str, int], default: int = 1, epochs: int = 1, seed: int = 17
) -> DataFrame:
    """Copies of ``(doc_id, text, source, …)`` in shuffled order, sources at their weights.

    A document's number of copies is the inverse of its source's Poisson distribution at
    a uniform draw, a hash of seed and doc_id: the same document has the same number in
    every run and at every size. All columns come back, with ``copy`` (from 1) and
    ``n_copies``; columns of these names in the input are replaced.

    Rows without a copy are gone, as the distribution has it. A null source is a source
    with the default weight. A null doc_id draws by its text. Repeated rows draw alike.
    An empty table gives no rows.
    """
    docs = docs.drop("copy", "n_copies")
    columns = docs.columns
    # In a struct, so that no name can clash with those made here.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"))
    rates = repetition_rates(docs, weights, default, epochs)
    key = F.coalesce(F.col("doc.doc_id").cast("string"), F.md5(F.coalesce("doc.text", F.lit("")).cast("binary")))
    joined = rows.join(rates, F.col("doc.source").cast("string").eqNullSafe(F.col("group_key")))

    def part_count(part: Column) -> Column:
        draw = uniform(F.lit(seed), key, part)
        return F.size(F.filter("sums", lambda total: total <= draw))

    counts = F.transform(F.sequence(F.lit(1), F.col("parts")), part_count)
    joined = joined.withColumn("n_copies", F.aggregate(counts, F.lit(0), lambda a, b: a + b))
    copies = joined.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    place = uniform(F.lit(seed), F.lit("place"), key, F.col("copy"))
    shuffled = copies.select("doc", "copy", "n_copies", place.alias("place")).repartition("place").sortWithinPartitions("place")
    return shuffled.select(*(F.col("doc").getField(c).alias(c) for c in columns), "copy", "n_copies")
