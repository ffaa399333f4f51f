"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash gives every element a random permutation of the signature's places; in
round j the element offers its j-th place the value j + uniform. The ranks of one
element differ from place to place, which lowers the variance against independent
minima, and a document is ready as soon as every place has a value of a round gone
by: later rounds offer only larger ones. Rounds run for all elements of many
documents at once. The first places of a permutation are worked out from the
swaps before; only short documents, which need many rounds, get it in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsnap.llm.components import components
from lexsnap.llm.jaccard_join import block_wise
from lexsnap.llm.words import WordHashes, draws, grams, in_small_batches, mixed, row_slices, sent_when_small, word_hashes
from lexsnap.session import materialize

SHINGLE_WORDS = 5
PERCENT = 75
# A pair at the threshold shares no band with probability (1 - 0.75^5)^40 = 2e-5.
BANDS, BAND_ROWS = 40, 5
PLACES = 320  # the bands take the first 200; the rest sharpens the estimate
# Six bits per place, as six planes of one bit per place. At the threshold 79 of 320
# places differ; their number's deviation grows with the union of the two sets, as
# SuperMinHash has it. Five deviations are allowed for: (union up to, places apart).
MOST_APART = ((100, 106), (200, 107), (400, 108), (800, 111), (1600, 114))
MOST_APART_BEYOND = 118
_PLANES, _PLANE_LONGS = 6, -(-PLACES // 64)
_SKETCH = _PLANES * _PLANE_LONGS
_LAZY_ROUNDS = 12
_RANK_BITS = np.uint64(52)
_EMPTY = np.uint64(2**64 - 1)


def shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words, known)
    return np.unique(grams(hashes, min(SHINGLE_WORDS, len(words))))


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures of non-empty sets, one row each: round in the high bits, then its draw."""
    sizes = np.array([len(s) for s in sets])
    seeds = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out = np.full((len(sets), places), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    swaps: list[np.ndarray] = []
    order = None
    for rank in range(places):
        value = draws(seeds, 2 * rank)
        swap = rank + (draws(seeds, 2 * rank + 1) % np.uint64(places - rank)).astype(np.int64)
        if rank == _LAZY_ROUNDS:
            order = _order(swaps, len(seeds), places)
        if order is None:
            place = _at(swap, swaps)
            swaps.append(swap)
        else:
            rows = np.arange(len(seeds))
            place = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[:, rank]
        np.minimum.at(flat, owner * places + place, (np.uint64(rank) << _RANK_BITS) | (value >> np.uint64(12)))
        open_docs = out.max(axis=1) >= np.uint64(rank + 1) << _RANK_BITS
        if not open_docs.any():
            break
        left = open_docs[owner]
        if not left.all():
            swaps = [s[left] for s in swaps]
            order = None if order is None else order[left]
            seeds, owner = seeds[left], owner[left]
    return out


def _at(index: np.ndarray, swaps: list[np.ndarray]) -> np.ndarray:
    """What lies at ``index`` after step i of each element has put its place i at swaps[i]."""
    index = index.copy()
    for step in range(len(swaps) - 1, -1, -1):
        index[index == swaps[step]] = step
    return index


def _order(swaps: list[np.ndarray], count: int, places: int) -> np.ndarray:
    """The permutations so far in full, for the few elements of short documents."""
    order = np.broadcast_to(np.arange(places, dtype=np.uint16), (count, places)).copy()
    for step, swap in enumerate(swaps):
        order[np.arange(count), swap] = order[:, step]
    return order


def bands_and_sketches(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per band, and the bit planes of the places, packed into longs."""
    parts = signatures[:, : BANDS * BAND_ROWS].reshape(len(signatures), BANDS, BAND_ROWS)
    bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        bands = mixed(bands ^ parts[:, :, k])
    spread = mixed(signatures)
    planes = np.zeros((len(signatures), _PLANES, _PLANE_LONGS * 64), np.uint8)
    for k in range(_PLANES):
        planes[:, k, :PLACES] = (spread >> np.uint64(k)) & np.uint64(1)
    return bands.astype(np.int64), np.packbits(planes.reshape(len(signatures), -1), axis=1).view(np.int64)


def _sets(part: pa.RecordBatch, known: WordHashes) -> list[np.ndarray]:
    return [shingle_set(text, known) for text in part.column("text").to_pylist()]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for part in row_slices(batches, "text", 2 << 20):
        sets = _sets(part, known)
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        full = [k for k, s in enumerate(sets) if len(s)]
        bands = np.zeros((len(sets), BANDS), np.int64)
        sketches = np.zeros((len(sets), _SKETCH), np.int64)
        if full:
            bands[full], sketches[full] = bands_and_sketches(superminhash([sets[k] for k in full]))
        columns = [
            part.column("doc_id"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(keys, pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1))),
            *(pa.array(sketches[:, k]) for k in range(_SKETCH)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "bands", *_BITS])


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for part in row_slices(batches, "text"):
        sets = [s.view(np.int64) for s in _sets(part, known)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"]
        )


_BITS = [f"s{k}" for k in range(_SKETCH)]
_SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{b} long" for b in _BITS)


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, set_key, bands, s0…)`` per row; set_key names the whole set."""
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_sign, _SIGNED)


def _could_link(a: str, b: str):
    """Size bound (exact) and signature distance of a pair."""
    apart = F.lit(0)
    for word in range(_PLANE_LONGS):
        planes = [_BITS[k * _PLANE_LONGS + word] for k in range(_PLANES)]
        differs = [F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")) for s in planes]
        apart = apart + F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), differs))
    sizes = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    union = (sizes[0] + sizes[1]) / (1 + PERCENT / 100)
    most = F.lit(MOST_APART_BEYOND)
    for size, places in reversed(MOST_APART):
        most = F.when(union <= size, places).otherwise(most)
    return (F.least(*sizes) * 100 >= F.greatest(*sizes) * PERCENT) & (apart <= most)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(low, high)`` that reach the threshold on their full sets."""
    low = sets.select(F.col("doc_id").alias("low"), F.col("shingles").alias("low_set"))
    high = sets.select(F.col("doc_id").alias("high"), F.col("shingles").alias("high_set"))
    both = pairs.join(high, "high").join(low, "low")
    shared = F.size(F.array_intersect("low_set", "high_set")).cast("long")
    union = F.size("low_set") + F.size("high_set") - shared
    return both.where(shared * 100 >= union * PERCENT).select("low", "high").distinct()


def _likely(pairs: DataFrame, traits: DataFrame) -> DataFrame:
    low = traits.select(F.col("doc_id").alias("low"), F.struct("n_shingles", *_BITS).alias("a"))
    high = traits.select(F.col("doc_id").alias("high"), F.struct("n_shingles", *_BITS).alias("b"))
    likely = pairs.join(high, "high").join(low, "low").where(_could_link("a", "b"))
    return materialize(likely.select("low", "high"), "pairs")


def _seated(members: DataFrame, group: DataFrame) -> DataFrame:
    """Members with their components, of the buckets that hold several components."""
    of = group.select(F.col("node").alias("doc_id"), "component")
    seats = members.join(of, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    seats = materialize(seats, "seats")
    spread = seats.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    split = materialize(spread.where("least < most").select("bucket"), "split")
    return materialize(seats.join(split, "bucket", "left_semi"), "seats")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``(doc_id, text, …)``.

    1. Rows with equal shingle sets are linked through the smallest doc_id; only that
       one goes on.
    2. Documents that share a band (a bucket) are candidates. Each is first held against
       the smallest document of all its buckets, and components are formed; then against
       the smallest of each bucket in which that one is of another component.
    3. In buckets that still hold several components, all members are compared across
       components, in blocks of a bounded size on their full sets. So no link between
       components is left out, while a large group of copies costs one check per member.
    4. Components again, over all links.

    A doc_id is one node: rows that repeat it share their links. Rows without words are
    linked with nothing. A row without doc_id is linked with nothing, its component_id
    is null and it is kept. Other columns are not read.
    """
    signed = materialize(signatures(docs), "signatures")
    able = signed.where("n_shingles > 0 and doc_id is not null")
    first = able.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = materialize(first.where("first < last"), "first")
    copies = able.select("doc_id", "set_key").join(first, "set_key").where("doc_id > first")
    copies = materialize(copies.select("doc_id", "set_key", F.col("first").alias("low")).distinct(), "copies")
    single = able.join(copies.select("doc_id", "set_key"), ["doc_id", "set_key"], "left_anti")

    banded = single.select("doc_id", F.explode("bands").alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("last"))
    heads = materialize(heads.where("low < last").select("bucket", "low"), "heads")
    members = materialize(banded.join(heads, "bucket"), "members")
    needed = materialize(members.select("doc_id").distinct(), "needed")
    needed = sent_when_small(needed)
    traits = materialize(single.select("doc_id", "n_shingles", *_BITS).join(needed, "doc_id", "left_semi"), "traits")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(_hash_sets, "doc_id long, shingles array<long>"), "sets")

    # One check per document, then one per document and bucket that is still split.
    pairs = members.where("low < doc_id").groupBy(F.col("doc_id").alias("high")).agg(F.min("low").alias("low"))
    first_pairs = _likely(pairs, traits)
    links = materialize(_linked(first_pairs, sets), "links")
    seats = _seated(members, components(links))
    apart = seats.join(seats.where("doc_id = low").select("bucket", F.col("component").alias("head")), "bucket")
    pairs = apart.where("component != head").select("low", F.col("doc_id").alias("high")).distinct()
    later_pairs = _likely(pairs, traits)
    links = links.union(materialize(_linked(later_pairs, sets), "links"))
    seats = _seated(seats.drop("component"), components(links))

    # Near misses are left: compared in blocks, which give links and not pairs.
    open_docs = materialize(seats.select("doc_id").distinct(), "open")
    whole = sets.join(open_docs, "doc_id", "left_semi").dropDuplicates(["doc_id", "shingles"])
    whole = whole.select(F.col("doc_id").alias("set_id"), F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("grams"))
    seats = seats.select(F.col("bucket").alias("gram"), F.col("doc_id").alias("set_id"), F.col("low").alias("head"), "component")
    more = materialize(block_wise(seats, whole, PERCENT).select("low", "high"), "links")
    every = links.union(more).union(copies.select("low", F.col("doc_id").alias("high")))
    group = components(every).select(F.col("node").alias("doc_id"), "component")

    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return signed.select("doc_id", "n_shingles").join(group, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of the rows that stay: of each group the document with the smallest doc_id."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"))
    gone = sent_when_small(materialize(gone.distinct(), "gone"))
    return docs.join(gone, docs.doc_id.cast("long") == gone.gone_id, "left_anti")
