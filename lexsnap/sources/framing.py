"""Records of files whose records span lines, read by many tasks.

A split of such a file starts somewhere inside a record, and from the split alone it
cannot be told where: whether a line end or a bracket counts depends on all quotes before
it. So each split first says what it does to the state, for either state it might start
in; these effects are combined along the file into the state at each split's start; then
every split frames its records. The pieces of records that cross a split's end, two per
split at most, are put together last.

Splits are Spark's own: the file is read as text, cut at a separator behind which a
record may end (a line end in CSV, a closing brace in JSON).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexsnap.session import materialize

# A row of four longs per split is broadcast: 128 MB for this many splits.
MAX_SPLITS = 1 << 22

_BEFORE, _ALL = Window.unboundedPreceding, Window.currentRow


class CsvFraming:
    """A record ends at a line end outside quotes; doubled quotes cancel out.

    Fields that hold quotes or line ends must be quoted, as RFC 4180 has it.
    """

    separator = "\n"
    closing = ""  # the part of the separator that belongs to the record

    @staticmethod
    def effect(text: str) -> tuple[int, int, int]:
        return text.count('"'), 0, 0

    @staticmethod
    def between(inside: int, depth: int) -> bool:
        """May a record begin in this state?"""
        return not inside

    ends = between

    @staticmethod
    def record(text: str, first: bool) -> str | None:
        return text or None


class JsonArrayFraming:
    """A record is an object of the array that the file holds; it ends at depth 1."""

    separator = closing = "}"
    _escaped = re.compile(r"\\.", re.DOTALL)

    @classmethod
    def effect(cls, text: str) -> tuple[int, int, int]:
        """Quotes; change of depth outside strings, if none is open before and if one is."""
        if "\\" in text:
            text = cls._escaped.sub("", text)
        pieces = text.split('"')
        deltas = [0, 0]
        for place, piece in enumerate(pieces):
            deltas[place & 1] += piece.count("{") + piece.count("[") - piece.count("]")
        quotes = len(pieces) - 1
        deltas[quotes & 1] -= 1  # the separator itself
        return quotes, *deltas

    @staticmethod
    def between(inside: int, depth: int) -> bool:
        return not inside and depth <= 1

    @staticmethod
    def ends(inside: int, depth: int) -> bool:
        """Has a separator that leads to this state ended a record?"""
        return not inside and depth == 1

    @staticmethod
    def record(text: str, first: bool) -> str | None:
        text = text.lstrip(" \t\r\n,")
        if first:
            text = text.removeprefix("[").lstrip(" \t\r\n")
        return text if text.strip(" \t\r\n]") else None


Framing = type[CsvFraming] | type[JsonArrayFraming]

_SPLIT = "file string, start long"
_FRAME = f"{_SPLIT}, first boolean, kind string, text string"


def _splits(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """``(file, start, *columns, texts)`` for each run of rows of one split, texts in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = batch.column("start").to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
        for at, stop in itertools.pairwise([0, *turns.tolist(), batch.num_rows]):
            about = [batch.column(c)[at].as_py() for c in ("file", "start", *columns)]
            yield *about, batch.column("value").slice(at, stop - at).to_pylist()


def _summarise(framing: Framing) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, int], list[int]] = {}
        for file, start, texts in _splits(batches):
            state = rows.setdefault((file, start), [0, 0, 0])
            for text in texts:
                quotes, closed, open_ = framing.effect(text)
                turned = state[0] & 1
                state[1 + turned] += closed
                state[2 - turned] += open_
                state[0] += quotes
        yield pa.RecordBatch.from_pylist(
            [
                {"file": f, "start": s, "quotes": q, "closed": a, "open": b}
                for (f, s), (q, a, b) in rows.items()
            ],
            pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("start", "quotes", "closed", "open"))]),
        )

    return run


def _frame(framing: Framing) -> Callable:
    """Whole records, and the pieces of those that a split's start or end cuts."""
    names = ["file", "start", "first", "kind", "text"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, inside, depth, begun, first = None, [], 0, 0, True, False
        out: list[tuple] = []

        def piece(kind: str) -> None:
            nonlocal first
            text = framing.separator.join(held)
            held.clear()
            if kind == "whole":  # pieces are trimmed when they are together
                text = framing.record(text + framing.closing, first)
            if text is not None:
                out.append((*split, first, kind, text))
                first = False

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return done

        for file, start, state, level, texts in _splits(batches, "inside", "depth"):
            if (file, start) != split:
                if split is not None and held:
                    piece("head" if begun else "middle")
                split, inside, depth = (file, start), state, level
                begun = framing.between(inside, depth)
                first = start == 0
            for text in texts:
                quotes, closed, open_ = framing.effect(text)
                depth += open_ if inside else closed
                inside ^= quotes & 1
                held.append(text)
                if framing.ends(inside, depth):
                    piece("whole" if begun else "tail")
                    begun = True
            if out:
                yield batch()
        if split is not None and held:
            piece("head" if begun else "middle")
        if out:
            yield batch()

    return run


def framed(spark: SparkSession, path: str, framing: Framing) -> DataFrame:
    """``(file, start, first, text)``: the text of each record, whichever splits it lies in.

    ``first`` marks the first record of a file; ``start`` is that of the split in which
    the record begins.
    """
    lines = spark.read.option("lineSep", framing.separator).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
    )
    effects = lines.mapInArrow(_summarise(framing), f"{_SPLIT}, quotes long, closed long, open long")
    effects = materialize(effects.groupBy("file", "start").agg(*(F.sum(c).alias(c) for c in ("quotes", "closed", "open"))), "splits")
    along = Window.partitionBy("file").orderBy("start").rowsBetween(_BEFORE, -1)
    states = effects.withColumn("inside", F.coalesce(F.sum("quotes").over(along) % 2, F.lit(0).cast("long")))
    moved = F.when(F.col("inside") == 0, F.col("closed")).otherwise(F.col("open"))
    states = states.withColumn("moved", moved).withColumn("depth", F.coalesce(F.sum("moved").over(along), F.lit(0).cast("long")))
    states = states.filter("start > 0").select(
        F.xxhash64("file").alias("_file"), F.col("start").alias("_start"), "inside", "depth"
    )
    if states.count() > MAX_SPLITS:
        raise ValueError("too many splits: raise spark.sql.files.maxPartitionBytes")
    here = (F.xxhash64("file") == F.col("_file")) & (F.col("start") == F.col("_start"))
    placed = lines.join(F.broadcast(states), here, "left").select(
        "file", "start", "value", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("inside", "depth"))
    )
    frames = placed.mapInArrow(_frame(framing), _FRAME)
    whole = frames.filter("kind = 'whole'").select("file", "start", "first", "text")
    if effects.groupBy("file").count().filter("count > 1").isEmpty():
        ends = frames.filter("kind <> 'whole'")  # only what is left at a file's end
    else:
        ends = materialize(frames.filter("kind <> 'whole'"), "pieces")
    return whole.unionByName(_joined(ends, framing))


def _joined(pieces: DataFrame, framing: Framing) -> DataFrame:
    """Records out of their pieces: a head, the splits it spans, and a tail."""
    is_head = F.col("kind") == "head"
    order = [F.col("start"), is_head]
    thin = pieces.select("file", "start", "kind")
    begins = F.last(F.when(is_head, F.col("start")), ignorenulls=True)
    begins = begins.over(Window.partitionBy("file").orderBy(*order).rowsBetween(_BEFORE, _ALL))
    owned = thin.withColumn("begins", begins)
    parts = pieces.join(owned, ["file", "start", "kind"]).groupBy("file", "begins").agg(
        F.sort_array(F.collect_list(F.struct("start", is_head.alias("head"), "text"))).alias("parts"),
        F.max("first").alias("first"),
        F.max(F.col("kind") == "tail").alias("ended"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), framing.separator)
    together = parts.select("file", F.col("begins").alias("start"), "first", text.alias("text"), "ended")
    return _trimmed(together, framing)


def _trimmed(records: DataFrame, framing: Framing) -> DataFrame:
    if framing is CsvFraming:
        return records.filter("text <> ''").drop("ended")
    closed = F.when(F.col("ended"), F.concat("text", F.lit(framing.closing))).otherwise(F.col("text"))
    bare = F.regexp_replace(closed, r"^[ \t\r\n,]+", "")
    bare = F.when(F.col("first"), F.regexp_replace(bare, r"^\[[ \t\r\n]*", "")).otherwise(bare)
    return records.withColumn("text", bare).filter(F.trim("text", F.lit(" \t\r\n]")) != "").drop("ended")


def parsed(records: DataFrame, value: Column) -> DataFrame:
    return records.select(value.alias("_row")).select("_row.*")
