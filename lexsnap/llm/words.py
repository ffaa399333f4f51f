"""Word hashing shared by the text operators, vectorised over a batch of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.session import in_small_batches, size_in_bytes  # noqa: F401  (taken from here)

MAX_KNOWN_WORDS = 1 << 17
# Rows of a side that is sent to all executors: two longs each, some 16 MB at most.
MAX_SENT_ROWS = 1 << 19

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROLL = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hash of each word met; starts over when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def draws(seeds: np.ndarray, number: int) -> np.ndarray:
    """The ``number``-th pseudo-random 64-bit value of each seed."""
    with np.errstate(over="ignore"):
        return mixed(seeds + _GAMMA * np.uint64(number + 1))


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """One hash per run of ``size`` words, in order of their starts."""
    count = max(0, len(hashes) - size + 1)
    out = np.full(count, size + (seed << 8), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _ROLL + hashes[k : k + count]
        return mixed(out)


def row_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20):
    """Slices of the batches whose texts hold about ``most_bytes``, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size) + 64
        if start < batch.num_rows:
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def sent_when_small(df: DataFrame, most_rows: int = MAX_SENT_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if it has few rows; else leave it to Spark."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
