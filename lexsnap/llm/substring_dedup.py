"""Substring dedup by a relative Lempel-Ziv parse of every document.

The reference is all text that starts earlier (smaller doc_id, or earlier in the same
document). A duplicate is WINDOW_WORDS words that the reference holds too.

Reference blocks are chosen by content: of the 16 five-word blocks in a window, the one
with the smallest hash. Equal windows choose the same block, so every duplicate lies on
a block that is indexed for both places. Consecutive windows of one block form a
stretch (at most 16 windows, 35 words). Lookups go from coarse to fine:

1. Index: blocks held by two documents at least.
2. Stretches on such blocks, whole: the smallest document that holds the same words.
3. Of the stretches that are first of their kind (the places where factors begin or
   end), each window by itself.

The greedy parse of a document then runs along its windows: a factor starts at a window
with a source, grows while the next window has the same source, and ends at the
boundary where it has another one or none; windows across a boundary have been looked
up themselves. A factor of k windows spans WINDOW_WORDS + k - 1 words.

Windows are compared by 64-bit hashes: with n windows on shared blocks, some n^2 / 2^65
are expected to be taken for one another.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.llm.words import WordHashes, draws, grams, in_small_batches, mixed, row_slices, word_hashes
from lexsnap.session import materialize

WINDOW_WORDS = 20
BLOCK_WORDS = 5
_BLOCKS = WINDOW_WORDS - BLOCK_WORDS + 1  # blocks in a window, a power of two
# The index filter: 16 bits per shared block, 32 MB at most. A fuller filter lets more
# stretches through to the lookups; the result stays the same.
_MOST_FILTER_BITS = 1 << 28
_BITMAP_BITS = 1 << 15  # of one native bitmap
_LEAST = -(1 << 63)


class Windows:
    """Windows and stretches of the documents of a slice."""

    def __init__(self, hashes: list[np.ndarray]):
        lengths = np.array([len(h) for h in hashes])
        owner = np.repeat(np.arange(len(hashes)), lengths)
        together = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        count = max(0, len(together) - WINDOW_WORDS + 1)
        inside = np.flatnonzero(owner[:count] == owner[WINDOW_WORDS - 1 :][:count])
        blocks = grams(together, BLOCK_WORDS)
        whole = np.zeros(count, np.uint64)
        for start in range(0, WINDOW_WORDS, BLOCK_WORDS):
            whole = mixed(whole ^ blocks[start : start + count])
        least = blocks
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        first = np.cumsum(lengths) - lengths
        self.owner = owner[inside]
        self.place = inside - first[self.owner] if len(inside) else inside
        self.window = whole[inside]
        self.block = least[inside]
        fresh = np.ones(len(inside), bool)
        fresh[1:] = (self.block[1:] != self.block[:-1]) | (self.owner[1:] != self.owner[:-1])
        begin = np.flatnonzero(fresh)
        along = np.arange(len(inside)) - np.repeat(begin, np.diff(np.append(begin, len(inside))))
        self.start = np.flatnonzero(along % _BLOCKS == 0)
        self.size = np.diff(np.append(self.start, len(inside)))
        last = self.start + self.size - 1
        # Its first and last window cover a stretch, as it has 16 windows at most.
        ends = mixed(self.window[self.start] ^ mixed(self.window[last] ^ self.size.astype(np.uint64)))
        self.stretch = draws(ends, 0)


def _words(part: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column("text").to_pylist()]


def _windows(part: pa.RecordBatch, known: WordHashes) -> Windows:
    return Windows([word_hashes(w, known) for w in _words(part)])


def _unique_per_owner(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where the first of each (value, owner) lies; owner must ascend."""
    order = np.argsort(values, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return np.sort(order[fresh])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for part in row_slices(batches, "text"):
        w = _windows(part, known)
        block, owner = w.block[w.start], w.owner[w.start]
        block = block[_unique_per_owner(block, owner)]
        yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64))], ["block"])


def _stretches(index_filter, with_windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        bits = np.frombuffer(index_filter.value, np.uint8)
        mask = np.uint64(len(bits) * 8 - 1)
        for part in row_slices(batches, "text"):
            w = _windows(part, known)
            bit = (w.block[w.start] & mask).astype(np.int64)
            shared = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            shared = shared[_unique_per_owner(w.stretch[shared], w.owner[w.start[shared]])]
            rank = part.column("rank").to_numpy(zero_copy_only=False)
            columns = [pa.array(w.stretch[shared].view(np.int64)), pa.array(rank[w.owner[w.start[shared]]])]
            names = ["hash", "rank"]
            if with_windows:
                sizes = w.size[shared]
                offsets = np.append(0, np.cumsum(sizes))
                rows = np.repeat(w.start[shared] - offsets[:-1], sizes) + np.arange(offsets[-1])
                values = pa.array(w.window[rows].view(np.int64))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values))
                names.append("windows")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _bit_filter(blocks: DataFrame) -> bytearray:
    """Bits of the block hashes, built from native bitmaps; its size has a fixed bound."""
    count = blocks.count()
    bits = min(_MOST_FILTER_BITS, max(_BITMAP_BITS, 1 << math.ceil(math.log2(16 * count + 1))))
    bit = F.col("block").bitwiseAND(F.lit(bits - 1))
    maps = blocks.select(
        (bit / _BITMAP_BITS).cast("long").alias("part"), (bit % _BITMAP_BITS).alias("bit")
    ).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    out = bytearray(bits // 8)
    step = _BITMAP_BITS // 8
    for row in maps.toLocalIterator():
        out[row.part * step : (row.part + 1) * step] = row.bitmap
    return out


def parse(
    window: np.ndarray, place: np.ndarray, sources: np.ndarray, own: int
) -> list[tuple[int, int, int]]:
    """Greedy factors ``(start, length, source)`` of one document.

    ``sources`` has each window's earliest document; ``own`` marks none, unless the
    same window starts earlier in the document.
    """
    _, first = np.unique(window, return_index=True)
    again = np.ones(len(window), bool)
    again[first] = False
    held = again | (sources != own)
    factors: list[tuple[int, int, int]] = []
    rows = np.flatnonzero(held)
    if not len(rows):
        return factors
    cut = np.flatnonzero((np.diff(rows) > 1) | (np.diff(sources[rows]) != 0))
    for begin, end in zip(np.append(0, cut + 1), np.append(cut, len(rows) - 1)):
        start = int(place[rows[begin]])
        factors.append((start, int(rows[end] - rows[begin]) + WINDOW_WORDS, int(sources[rows[begin]])))
    return factors


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in row_slices(batches, "text"):
            words = _words(part)
            w = Windows([word_hashes(x, known) for x in words])
            bounds = np.searchsorted(w.owner, np.arange(len(words) + 1))
            starts = np.searchsorted(w.start, bounds)
            ranks = part.column("rank").to_pylist()
            hashes, refs = part.column("hashes"), part.column("refs")
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "factors": [], "kept_text": []}
            for row, mine in enumerate(words):
                at = slice(bounds[row], bounds[row + 1])
                sources = np.full(at.stop - at.start, ranks[row], np.int64)
                if hashes[row].is_valid and len(sources):
                    known_hash = np.array(hashes[row].values.to_numpy(zero_copy_only=False))
                    known_ref = np.array(refs[row].values.to_numpy(zero_copy_only=False))
                    order = np.argsort(known_hash)
                    known_hash, known_ref = known_hash[order], known_ref[order]

                    def lookup(values: np.ndarray) -> np.ndarray:
                        values = values.view(np.int64)
                        spot = np.minimum(np.searchsorted(known_hash, values), len(known_hash) - 1)
                        return np.where(known_hash[spot] == values, known_ref[spot], ranks[row])

                    runs = slice(starts[row], starts[row + 1])
                    whole = np.repeat(lookup(w.stretch[runs]), w.size[runs])
                    alone = lookup(w.window[at])
                    sources = np.where(whole != ranks[row], whole, alone)
                factors = parse(w.window[at], w.place[at], sources, ranks[row])
                keep = np.ones(len(mine), bool)
                for start, length, _ in factors:
                    keep[start : start + length] = False
                kept = b" ".join([x for x, k in zip(mine, keep) if k] if factors else mine)
                out["n_words"].append(len(mine))
                out["n_removed"].append(len(mine) - int(keep.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["factors"].append(
                    [{"start": s, "length": n, "ref_doc_id": None if r == _LEAST else r} for s, n, r in factors]
                )
                out["kept_text"].append(kept.decode("utf-8", "surrogatepass") if with_text else None)
            types = [t for _, t in _OUT]
            columns = [pa.array(v, t) for v, t in zip(out.values(), types)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *out])

    return run


_OUT = [
    ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("kept_sha256", pa.string()),
    ("factors", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_doc_id", pa.int64())]))),
    ("kept_text", pa.string()),
]
_OUT_SCHEMA = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, "
    "factors array<struct<start: long, length: long, ref_doc_id: long>>, kept_text string"
)


def _first_holders(rows: DataFrame) -> DataFrame:
    """``(hash, ref)``: the smallest rank of each hash that several ranks hold.

    Stored, so that a join with it can split a hot hash.
    """
    heads = rows.groupBy("hash").agg(F.min("rank").alias("ref"), F.max("rank").alias("last"))
    return materialize(heads.where("ref < last").select("hash", "ref"), "holders")


def factor_duplicates(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Parse ``(doc_id, text, …)`` and cut out what earlier text holds.

    ``(doc_id, n_words, n_removed, kept_sha256, factors, kept_text)`` per row: factors
    are ``(start, length, ref_doc_id)`` in words, kept_text the words left, joined by
    one space (null unless ``with_text``). Words are runs of anything but ASCII white
    space, unchanged; null text has none. A null doc_id is the smallest. Rows that
    share a doc_id are none earlier than the other: each is judged against smaller ids
    and itself. Other columns are not read.
    """
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("rank")
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), rank, "text")
    blocks = texts.mapInArrow(_blocks, "block long").groupBy("block").count().where("count > 1")
    bits = _bit_filter(materialize(blocks.select("block"), "blocks"))
    index_filter = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def stretches(with_windows: bool) -> DataFrame:
        schema = "hash long, rank long" + ", windows array<long>" * with_windows
        return texts.mapInArrow(_stretches(index_filter, with_windows), schema)

    found = stretches(True).join(_first_holders(stretches(False)), "hash", "left")
    found = materialize(
        found.select(
            "rank",
            "hash",
            F.when(F.col("ref") < F.col("rank"), F.col("ref")).alias("ref"),
            F.when(F.coalesce(F.col("ref") < F.col("rank"), F.lit(False)), None).otherwise(F.col("windows")).alias("windows"),
        ),
        "stretches",
    )
    alone = found.where("ref is null").select("rank", F.explode("windows").alias("hash"))
    alone = alone.join(_first_holders(alone), "hash").where("ref < rank")
    known = found.where("ref is not null").select("rank", "hash", "ref").union(alone.select("rank", "hash", "ref"))
    per_doc = known.groupBy("rank").agg(F.collect_list(F.struct("hash", "ref")).alias("known"))
    per_doc = per_doc.select("rank", F.col("known.hash").alias("hashes"), F.col("known.ref").alias("refs"))
    joined = texts.join(per_doc, "rank", "left").select("doc_id", "rank", "text", "hashes", "refs")
    return joined.mapInArrow(_finish(with_text), _OUT_SCHEMA)
