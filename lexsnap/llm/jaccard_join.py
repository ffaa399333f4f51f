"""Jaccard join on word n-grams by rare-first prefix filtering.

Two sets that reach the threshold share so many grams that, whatever order all grams
are put in, each must hold one of the shared ones among its first few: its prefix. With
rare grams first, prefixes meet seldom.

1. Copies of a set count as one. Of the others, by hash order, the prefixes that must
   share not one gram but a fifth of them are counted: a set whose prefix holds too few
   grams that any other set has, too, is linked with nothing and goes no further.
2. The grams of the remaining sets are counted and put in order, rare ones first; those
   of one set only come before all others and need no place in an index.
3. Sets that share a prefix gram (a bucket) are candidates. Each set is first held
   against one other, the least of all its buckets, then against the least of each bucket
   that still holds several components. A pair is taken at its first shared gram, has to
   pass the length, positional and suffix filters, and is then verified.
4. What is left are near misses. A bucket is not paired out: its sets belong to the cell
   of their least bucket, cells that share a bucket are compared in blocks, and a block
   gives links, not pairs. As sets are named by hashes, few sets of a bucket have another
   cell than most of it, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsnap.llm.components import components
from lexsnap.llm.words import WordHashes, grams, in_small_batches, row_slices, sent_when_small, word_hashes
from lexsnap.session import materialize

GRAM_WORDS = 5
PERCENT = 80
# Shared grams that the first prefixes must hold: a fifth of the smaller set.
SHARED_PART = 5
# A gram's place in the order: the power of two of its frequency above bits of its hash.
HASH_BITS = 58
SUFFIX_DEPTH = 4
# Sets of a block, and grams in all of them, about.
BLOCK_SETS, BLOCK_GRAMS = 256, 1 << 20
BLOCK_COLUMNS = 4096
MAX_KNOWN_SETS = 1 << 17


def gram_set(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; a shorter text is one gram, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(grams(word_hashes(words, known), min(GRAM_WORDS, len(words))))


def _name(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    high, low = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), ">i8")
    return int(high), int(low)


def least_shared(n):
    """Grams that a set of ``n`` shares at least with one that it is linked with."""
    return -(-n * PERCENT // 100)


def least_overlap(n, m, percent=PERCENT):
    """Grams that linked sets of ``n`` and ``m`` share at least."""
    return -(-(n + m) * percent // (100 + percent))


def _shared_in_prefix(n):
    return np.maximum(1, n // SHARED_PART)


def _first_prefix(n):
    return n - least_shared(n) + _shared_in_prefix(n)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for part in row_slices(batches, "text"):
        sets = [gram_set(text, known) for text in part.column("text").to_pylist()]
        names = [_name(s) for s in sets]
        columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                   pa.array([h for h, _ in names], pa.int64()), pa.array([k for _, k in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "set_more"])


def _prefix_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first prefix of each set, a row per gram; of copies in a task, mostly one."""
    known, seen = WordHashes(), set()
    for part in row_slices(batches, "text"):
        prefixes, names = [], []
        for text in part.column("text").to_pylist():
            values = gram_set(text, known)
            name = _name(values)[0]
            if len(values) and name not in seen:
                if len(seen) >= MAX_KNOWN_SETS:
                    seen.clear()
                seen.add(name)
                prefixes.append(values[: int(_first_prefix(len(values)))])
                names.append(name)
        if names:
            owners = np.repeat(np.array(names, np.int64), [len(p) for p in prefixes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes).view(np.int64)), pa.array(owners)], ["gram", "set_id"])


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for part in row_slices(batches, "text"):
        sets = [gram_set(text, known) for text in part.column("text").to_pylist()]
        columns = [part.column("doc_id"), pa.array([_name(s)[0] for s in sets], pa.int64()),
                   pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set_id", "grams"])


def _could_have_partner(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The sets whose first prefix holds enough grams that the first prefix of another holds."""
    rows = texts.mapInArrow(_prefix_grams, "gram long, set_id long")
    owners = rows.groupBy("gram").agg(F.min("set_id").alias("set_id"), F.max("set_id").alias("_last"))
    alone = owners.where("set_id = _last").groupBy("set_id").agg(F.count("*").alias("_alone"))
    n = F.col("n")
    shared = _least_shared("n")
    in_prefix = F.greatest(F.lit(1), F.expr(f"n div {SHARED_PART}"))
    of_smallest = F.greatest(F.lit(1), F.floor(shared / SHARED_PART))
    met = n - shared + in_prefix - F.coalesce("_alone", F.lit(0))
    return sets.join(alone, "set_id", "left").where(met >= of_smallest).drop("_alone")


def _least_shared(n: str) -> Column:
    return F.expr(f"({n} * {PERCENT} + 99) div 100")


def _in_order(sets: DataFrame) -> DataFrame:
    """``(set_id, rep, n, grams)``: the grams that several sets have, rare ones first.

    Only sets that can still be linked: with few enough grams of their own.
    """
    rows = sets.select("set_id", F.explode("grams").alias("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    often = often.select(F.col("gram").alias("_gram"), F.floor(F.log2("n")).cast("long").alias("_rank"))
    hashed = F.col("gram").bitwiseAND((1 << HASH_BITS) - 1)
    place = F.shiftleft("_rank", HASH_BITS).bitwiseOR(hashed)
    ranked = rows.join(often, F.col("gram") == F.col("_gram")).groupBy("set_id")
    ranked = ranked.agg(F.sort_array(F.collect_list(place)).alias("grams"))
    about = sets.select("set_id", "rep", "n")
    return about.join(ranked, "set_id").where(F.size("grams") >= _least_shared("n"))


def _members(ordered: DataFrame) -> DataFrame:
    """``(gram, set_id, n, pos, head, head_n, head_pos)`` of the buckets that several sets share."""
    own = F.col("n") - F.size("grams")
    indexed = F.slice("grams", 1, (F.col("n") - _least_shared("n") + 1 - own).cast("int"))
    prefix = ordered.select("set_id", "n", F.posexplode(indexed).alias("pos", "gram"))
    heads = prefix.groupBy("gram").agg(F.min(F.struct("set_id", "n", "pos")).alias("_head"), F.max("set_id").alias("_last"))
    heads = heads.where("_head.set_id < _last").select(
        "gram", F.col("_head.set_id").alias("head"), F.col("_head.n").alias("head_n"), F.col("_head.pos").alias("head_pos")
    )
    return prefix.join(heads, "gram")


def _pairs(members: DataFrame) -> DataFrame:
    """Sets and the heads of their buckets, once each, at the first gram that they share."""
    a, b = F.col("n"), F.col("head_n")
    lengths = (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT) & (F.col("head") < F.col("set_id"))
    at = F.min(F.struct("pos", "head_pos")).alias("at")
    return members.where(lengths).groupBy("set_id", "head").agg(at).select("set_id", "head", "at.pos", "at.head_pos")


def apart(a: np.ndarray, b: np.ndarray, depth: int = SUFFIX_DEPTH) -> int:
    """A lower bound of the number of grams that only one of two ordered lists has."""
    if depth == 0 or not len(a) or not len(b):
        return abs(len(a) - len(b))
    middle = len(b) // 2
    k = int(np.searchsorted(a, b[middle]))
    found = k < len(a) and a[k] == b[middle]
    return apart(a[:k], b[:middle], depth - 1) + apart(a[k + found :], b[middle + 1 :], depth - 1) + (not found)


def linked(a: np.ndarray, b: np.ndarray, n: int, m: int, i: int, j: int) -> bool:
    """Do sets of ``n`` and ``m`` grams, whose first shared one is a[i] = b[j], reach the threshold?"""
    need = least_overlap(n, m)
    rest_a, rest_b = a[i + 1 :], b[j + 1 :]
    if 1 + min(len(rest_a), len(rest_b)) < need:  # positional filter
        return False
    if apart(rest_a, rest_b) > len(rest_a) + len(rest_b) - 2 * (need - 1):  # suffix filter
        return False
    return 1 + len(np.intersect1d(rest_a, rest_b, assume_unique=True)) >= need


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = {c: batch.column(c) for c in ("grams", "head_grams")}
        n, m, i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "head_n", "pos", "head_pos"))
        hold = [
            linked(lists["grams"][k].values.to_numpy(), lists["head_grams"][k].values.to_numpy(), int(n[k]), int(m[k]), int(i[k]), int(j[k]))
            for k in range(batch.num_rows)
        ]
        kept = batch.select(["set_id", "head"]).filter(pa.array(hold, pa.bool_()))
        yield kept.rename_columns(["high", "low"])


def _links(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """The pairs that reach the threshold, as ``(high, low)``, stored."""
    head = ordered.select(F.col("set_id").alias("head"), F.col("n").alias("head_n"), F.col("grams").alias("head_grams"))
    both = pairs.join(ordered.select("set_id", "n", "grams"), "set_id").join(head, "head")
    both = both.select("set_id", "head", "n", "head_n", "pos", "head_pos", "grams", "head_grams")
    return materialize(both.mapInArrow(_verify, "high long, low long"), "links")


def _still_split(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members, with their components, of the buckets that hold several components."""
    group = components(links).select(F.col("node").alias("set_id"), "component")
    seats = members.drop("component").join(group, "set_id", "left")
    seats = materialize(seats.withColumn("component", F.coalesce("component", "set_id")), "seats")
    spread = seats.groupBy("gram").agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
    split = materialize(spread.where("_least < _most").select("gram"), "split")
    return materialize(seats.join(split, "gram", "left_semi"), "seats")


def _block_links(sides: list[pa.StructArray], percent: int) -> pa.RecordBatch:
    """Links between the components of two blocks (or within one), a tree of them at most."""
    ids, group, sizes = (
        np.concatenate([side.field(c).to_numpy(zero_copy_only=False) for side in sides]) for c in ("set_id", "component", "n")
    )
    flat = np.concatenate([side.field("grams").flatten().to_numpy(zero_copy_only=False) for side in sides])
    lengths = np.concatenate([side.field("grams").value_lengths().to_numpy(zero_copy_only=False) for side in sides])
    owner = np.repeat(np.arange(len(ids)), lengths)
    values, places, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)  # only these can be in an intersection
    column = np.full(len(values), -1, np.int64)
    column[shared] = np.arange(len(shared))
    places = column[places]
    owner, places = owner[places >= 0], places[places >= 0]
    order = np.argsort(places, kind="stable")
    owner, places = owner[order], places[order]
    left = np.arange(len(sides[0]))
    right = np.arange(len(left), len(ids)) if len(sides) > 1 else left
    overlap = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24
    for start in range(0, len(shared), BLOCK_COLUMNS):
        a, b = np.searchsorted(places, [start, start + BLOCK_COLUMNS])
        held = np.zeros((len(ids), BLOCK_COLUMNS), np.float32)
        held[owner[a:b], places[a:b] - start] = 1
        overlap += held[left] @ held[right].T
    need = least_overlap(sizes[left][:, None], sizes[right][None, :], percent)
    rows, columns = np.nonzero((overlap >= need) & (group[left][:, None] != group[right][None, :]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            x = up
        return x

    out = []
    for x, y in zip(left[rows].tolist(), right[columns].tolist()):
        p, q = root(int(group[x])), root(int(group[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
    high, low = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["high", "low"])


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("members"), batch.column("others")):
                yield _block_links([side.values for side in (left, right) if side.is_valid], percent)

    return run


def block_wise(seats: DataFrame, ordered: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All links ``(high, low)`` between components that share a bucket, compared block by block.

    ``seats`` are ``(gram, set_id, head, component)``, a row per set and bucket (``gram``),
    ``head`` the bucket's smallest set; ``ordered`` has ``(set_id, n, grams)``.
    """
    cells = seats.groupBy("set_id").agg(F.min("head").alias("cell"), F.min("component").alias("component"))
    cells = materialize(cells, "cells")
    met = seats.join(cells.select("set_id", "cell"), "set_id").select("gram", "cell").distinct()
    met = materialize(met, "met")
    cell_pairs = met.join(met.withColumnRenamed("cell", "other"), "gram").where("cell <= other").select("cell", "other").distinct()

    # A row per block, of a bounded size however many sets a cell has and however long they are.
    members = materialize(cells.join(ordered.select("set_id", "n", "grams"), "set_id"), "cell-sets")
    by_count, by_size = F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.size("grams")) / BLOCK_GRAMS)
    sizes = materialize(members.groupBy("cell").agg(F.greatest(by_count, by_size).alias("blocks")), "sizes")
    placed = members.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("set_id", "grams"), F.col("blocks")))
    blocks = placed.groupBy("cell", "block").agg(F.collect_list(F.struct("set_id", "component", "n", "grams")).alias("members"))
    blocks = materialize(blocks, "blocks")

    numbers = sizes.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    others = numbers.select(F.col("cell").alias("other"), F.col("block").alias("other_block"))
    tasks = cell_pairs.join(numbers, "cell").join(others, "other").where("cell < other or block <= other_block")
    # A block that meets itself is sent once.
    alone = (F.col("cell") == F.col("other")) & (F.col("block") == F.col("other_block"))
    tasks = tasks.withColumn("other", F.when(~alone, F.col("other")))
    second = blocks.select(F.col("cell").alias("other"), F.col("block").alias("other_block"), F.col("members").alias("others"))
    both = tasks.join(blocks, ["cell", "block"]).join(second, ["other", "other_block"], "left")
    return both.select("members", "others").mapInArrow(_compare(percent), "high long, low long")


def similar_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``(doc_id, text, …)``.

    Linked are documents whose sets of n-grams have a Jaccard similarity of PERCENT or
    more; grams are compared by 58 bits of a hash. ``component_id`` is the smallest doc_id
    that links lead to, the row's own included. A null text has no words; documents without
    words are linked with nothing. A doc_id is one node: rows that repeat it share their
    links. A row without doc_id is linked with nothing and its component_id is null. Other
    columns are not read.
    """
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialize(texts.mapInArrow(_describe, "doc_id long, n_shingles long, set_id long, set_more long"), "described")
    able = described.where("n_shingles > 0 and doc_id is not null")
    sets = able.groupBy("set_id", "set_more").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last"), F.first("n_shingles").alias("n"))
    sets = materialize(sets, "sets")
    several = sets.where("rep < _last").select("set_id", "set_more", "rep")
    copies = able.select("doc_id", "set_id", "set_more").join(several, ["set_id", "set_more"]).where("rep < doc_id").select("doc_id", "rep")

    open_sets = materialize(_could_have_partner(sets.select("set_id", "rep", "n"), texts), "open")
    wanted = sent_when_small(materialize(open_sets.select(F.col("rep").alias("doc_id")).distinct(), "wanted"))
    held = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_gram_sets, "doc_id long, set_id long, grams array<long>")
    held = held.withColumnRenamed("doc_id", "rep").dropDuplicates(["set_id", "rep"])
    ordered = materialize(_in_order(materialize(held.join(open_sets, ["set_id", "rep"]), "grams")), "ordered")

    members = materialize(_members(ordered), "members")
    nearest = _pairs(members).groupBy("set_id").agg(F.min(F.struct("head", "pos", "head_pos")).alias("one"))
    links = _links(nearest.select("set_id", "one.head", "one.pos", "one.head_pos"), ordered)
    seats = _still_split(members, links)
    heads = seats.where("set_id = head").select(F.col("set_id").alias("_head"), F.col("component").alias("_of")).distinct()
    others = seats.join(heads, F.col("head") == F.col("_head")).where("component != _of")
    links = links.union(_links(_pairs(others.select(*members.columns)), ordered))
    seats = _still_split(seats, links)
    links = links.union(materialize(block_wise(seats, ordered), "links"))

    reps = ordered.select("set_id", "rep")
    ends = links.join(reps.select(F.col("set_id").alias("high"), F.col("rep").alias("one")), "high")
    ends = ends.join(reps.select(F.col("set_id").alias("low"), F.col("rep").alias("other")), "low").select("one", "other")
    group = components(ends.union(copies)).select(F.col("node").alias("doc_id"), "component")
    return described.select("doc_id", "n_shingles").join(group, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
