"""Exact dedup by composable polynomial fingerprints.

The fingerprint of bytes b[0..n) is the sum of b[i] * BASE^(n-1-i) modulo each of
MODULI. It composes: the fingerprint of a whole is the sum of its chunks'
fingerprints, each shifted by BASE^(bytes after the chunk). So chunks are hashed
apart, in any task, and met again by a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.llm.words import in_small_batches, sent_when_small
from lexsnap.session import materialize

CHUNK_BYTES = 1 << 18
BLOCK_BYTES = 1 << 10
# The four largest primes below 2^31, and one fixed base below all of them.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASE = 1181783497

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _powers(step: int, count: int, moduli: tuple[int, ...]) -> np.ndarray:
    """BASE^(step * k) modulo each modulus, for k below ``count``."""
    table = np.empty((count, len(moduli)), np.uint64)
    for column, p in enumerate(moduli):
        value, factor = 1, pow(BASE, step, p)
        for k in range(count):
            table[k, column] = value
            value = value * factor % p
    return table


def fingerprints(chunks: list[bytes], moduli: tuple[int, ...] = MODULI) -> np.ndarray:
    """One row of residues per chunk.

    Chunks are right-aligned in blocks of BLOCK_BYTES (leading zeros add nothing).
    A block's sum stays below 2^8 * 2^31 * 2^10, so the float product is exact.
    """
    p = np.array(moduli, np.uint64)
    out = np.zeros((len(chunks), len(moduli)), np.uint64)
    blocks = np.array([-(-len(c) // BLOCK_BYTES) for c in chunks], np.int64)
    most = int(blocks.max(initial=0))
    if not most:
        return out
    inner = _powers(1, BLOCK_BYTES, moduli)[::-1].astype(np.float64)
    outer = _powers(BLOCK_BYTES, most, moduli)
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * BLOCK_BYTES, np.uint8)
    for chunk, end in zip(chunks, ends * BLOCK_BYTES):
        data[end - len(chunk) : end] = np.frombuffer(chunk, np.uint8)
    sums = (data.reshape(-1, BLOCK_BYTES).astype(np.float64) @ inner).astype(np.uint64) % p
    after = np.repeat(ends, blocks) - 1 - np.arange(ends[-1])
    shifted = sums * outer[after] % p
    full = np.flatnonzero(blocks)
    out[full] = np.add.reduceat(shifted, (ends - blocks)[full], axis=0) % p
    return out


def shift(residues: np.ndarray, after: np.ndarray, moduli: tuple[int, ...] = MODULI) -> np.ndarray:
    """Residues as they count when ``after`` bytes follow."""
    out = residues.copy()
    for row in np.flatnonzero(after):
        for column, p in enumerate(moduli):
            out[row, column] = int(out[row, column]) * pow(BASE, int(after[row]), p) % p
    return out


def _hash_chunks(moduli: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few chunks at a time: the float copy is eight times their bytes.
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                chunks = part.column("chunk").to_pylist()
                after = part.column("after").to_numpy(zero_copy_only=False)
                residues = shift(fingerprints(chunks, moduli), after, moduli).astype(np.int64)
                columns = [part.column(c) for c in ("doc_id", "text_sha256", "n_bytes", "chunk_no")]
                columns += [pa.array(residues[:, k]) for k in range(len(moduli))]
                names = ["doc_id", "text_sha256", "n_bytes", "chunk_no"]
                names += [f"h{k}" for k in range(len(moduli))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def normalised(docs: DataFrame) -> DataFrame:
    """``(doc_id, body, text_sha256)``: body is the text with A-Z lower-cased, as UTF-8."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("body")).withColumn(
        "text_sha256", F.sha2("body", 256)
    )


def _chunks(texts: DataFrame, chunk_bytes: int, *keys: str) -> DataFrame:
    """One row per chunk; an empty body has one empty chunk."""
    size = F.octet_length("body").cast("long")
    last = F.greatest(F.ceil(size / chunk_bytes), F.lit(1)) - 1
    rows = texts.select("*", size.alias("n_bytes"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
    return rows.select(
        *keys,
        "n_bytes",
        "chunk_no",
        F.expr(f"substring(body, cast(chunk_no * {chunk_bytes} as int) + 1, {chunk_bytes})").alias("chunk"),
        F.greatest(F.col("n_bytes") - (F.col("chunk_no") + 1) * chunk_bytes, F.lit(0)).alias("after"),
    )


def fingerprinted(
    docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, moduli: tuple[int, ...] = MODULI
) -> DataFrame:
    """``(doc_id, text_sha256, n_bytes, copies, h0, h1, …)``, a row per doc_id and text.

    ``copies`` counts repeated rows. Their chunks add up alike, so the sum divides.
    """
    names = [f"h{k}" for k in range(len(moduli))]
    schema = "doc_id long, text_sha256 string, n_bytes long, chunk_no long, "
    schema += ", ".join(f"{n} long" for n in names)
    hashed = in_small_batches(_chunks(normalised(docs), chunk_bytes, "doc_id", "text_sha256")).mapInArrow(_hash_chunks(moduli), schema)
    summed = hashed.groupBy("doc_id", "text_sha256", "n_bytes").agg(
        F.count_if(F.col("chunk_no") == 0).alias("copies"), *(F.sum(n).alias(n) for n in names)
    )
    return summed.select(
        "doc_id",
        "text_sha256",
        "n_bytes",
        "copies",
        *(F.expr(f"{n} div copies % {p}").alias(n) for n, p in zip(names, moduli)),
    )


def exact_groups(
    docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, moduli: tuple[int, ...] = MODULI
) -> DataFrame:
    """Which documents have equal texts, after lower-casing A-Z?

    Takes ``(doc_id, text, …)``; other columns are not read. One row comes back per
    row given: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    1. Fingerprints, one thin row per document.
    2. Where several share fingerprint and length, their chunks are compared place by
       place: the smallest and largest chunk of each place must be the same. Copies
       meet inside the tasks first, so a hot group moves a few chunks per task.
    3. Groups that fail (equal fingerprints, unequal bytes) are split by SHA-256.

    Null text counts as empty, so all such rows are one group. Of rows with the same
    doc_id and text, one stays. A null doc_id is smaller than any other; a group of
    null ids only has keep_id null.
    """
    names = [f"h{k}" for k in range(len(moduli))]
    key = [*names, "n_bytes"]
    prints = materialize(fingerprinted(docs, chunk_bytes, moduli), "fingerprints")
    sizes = prints.groupBy(*key).agg(F.sum("copies").alias("size"), F.count("*").alias("members"))
    shared = sizes.where("members > 1").select(*key)
    suspects = materialize(
        prints.join(shared, key, "left_semi").select("doc_id", "text_sha256", *names), "suspects"
    )

    # Texts of suspects only; (doc_id, digest) names the row, Spark broadcasts it when small.
    texts = normalised(docs)
    same_row = texts.doc_id.eqNullSafe(suspects.doc_id) & (texts.text_sha256 == suspects.text_sha256)
    bodies = texts.join(suspects, same_row).select("body", texts.doc_id, texts.text_sha256, *names)
    compared = _chunks(bodies, chunk_bytes, *names).groupBy(*key, "chunk_no").agg(
        F.min("chunk").alias("low"), F.max("chunk").alias("high")
    )
    unequal = materialize(compared.where("low != high").select(*key).distinct(), "unequal")

    unequal = unequal.withColumn("split", F.lit(True))
    prints = prints.join(unequal, key, "left").withColumn("part", F.when(F.col("split"), F.col("text_sha256")).otherwise(""))
    group = [*key, "part"]
    groups = prints.groupBy(*group).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = materialize(groups, "groups")  # stored, so that the join can split a hot group
    rows = prints.join(groups, group).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of the rows that stay: of equal texts the one with the largest doc_id."""
    groups = materialize(exact_groups(docs), "groups")
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha256")
    )
    gone = sent_when_small(materialize(gone.distinct(), "gone"))
    body = F.translate(F.coalesce(docs.text, F.lit("")), UPPER, LOWER).cast("binary")
    same = docs.doc_id.cast("long").eqNullSafe(gone.gone_id) & (F.sha2(body, 256) == gone.gone_sha256)
    rest = docs.join(gone, same, "left_anti")
    # Rows that repeat a doc_id and its text: one of them stays.
    again = groups.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if again.isEmpty():
        return rest
    rest = rest.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rest = rest.withColumn("body", F.translate(F.coalesce("doc.text", F.lit("")), UPPER, LOWER).cast("binary"))
    number = F.expr("row_number() OVER (PARTITION BY doc.doc_id, sha2(body, 256) ORDER BY doc.text)")
    rest = rest.withColumn("number", number).where("number = 1")
    return rest.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
