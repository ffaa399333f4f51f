"""How text filters interact: what each removes in every order in which they can run.

Four filters look at a text alone. The fifth, duplicates, needs the whole table: texts
are dealt out by ranges of prefixes, which are lengthened where many texts share one,
and whole texts are put into compressed radix tries that hold the smallest id at each
text's end. A walk over a trie tells which texts stand elsewhere under a smaller id.

A task writes each text once, however many of its rows hold it, and thin rows that name
the text's group; so copies of one text are few wherever texts are sent. What a document
fails is a mask of five bits, and the masks are counted. All 120 orders follow from the
32 counts of a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsnap.llm.words import in_small_batches, row_slices, sent_when_small
from lexsnap.session import materialize

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 2  # percent of the characters
MARKUP = b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")

GROUP_BYTES = 16 << 20  # of texts that a task holds to find copies among them
RANGE_BYTES = 64 << 20  # of texts in a range, about
TRIE_BYTES = 16 << 20  # after which a trie is walked and dropped at the next prefix
FIRST_PREFIX, LONGER = 8, 8  # bytes, and how many times longer the next prefix is

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NOT_FIRST = bytes(range(0x80, 0xC0))  # bytes of a character after its first


def text_mask(text: bytes) -> int:
    """Which of the first four filters a text (UTF-8) fails, a bit each."""
    words = text.split()
    characters = len(text) - _count(text, _NOT_FIRST)
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * _count(text, _CAPITALS) > MOST_CAPITALS * characters,
        _count(text, MARKUP) > 0,
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


_MARKED = "group long, text binary, least long, doc_id long, part string, mask int, later boolean"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per different text held at a time, and a row per document that names its text's row."""
    first = TaskContext.get().partitionId() << 40
    names = ["group", "text", "least", "doc_id", "part", "mask", "later"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
    groups: dict[bytes, int] = {}
    least: list[int | None] = []
    masks: list[int] = []
    docs: list[tuple[int, int | None, str]] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal first, held
        texts = list(groups)
        for part in range(0, len(texts), 512):
            some = texts[part : part + 512]
            count = len(some)
            columns = [range(first + part, first + part + count), some, least[part : part + count], *[[None] * count] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
        for part in range(0, len(docs), 1 << 14):
            some = docs[part : part + (1 << 14)]
            later = [i is not None and i > least[g] for g, i, _ in some]
            columns = [[first + g for g, _, _ in some], [None] * len(some), [None] * len(some), [i for _, i, _ in some],
                       [p for _, _, p in some], [masks[g] for g, _, _ in some], later]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        first += len(texts)
        held = 0
        for kept in (groups, least, masks, docs):
            kept.clear()

    for batch in row_slices(batches, "text"):
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part")))
        for doc_id, text, part in rows:
            group = groups.get(text)
            if group is None:
                group = groups[text] = len(groups)
                least.append(None)
                masks.append(text_mask(text))
                held += len(text)
            if doc_id is not None and (least[group] is None or doc_id < least[group]):
                least[group] = doc_id
            docs.append((group, doc_id, part))
            held += 64
        if held >= GROUP_BYTES:
            yield from flush()
    yield from flush()


class Trie:
    """A compressed radix trie over bytes; a text's end holds its smallest id and its groups."""

    __slots__ = ("label", "children", "least", "groups")

    def __init__(self, label: bytes = b""):
        self.label = label
        self.children: dict[int, Trie] = {}
        self.least: int | None = None
        self.groups: list[tuple[int, int]] = []

    def insert(self, text: bytes, least: int, group: int) -> None:
        node, at = self, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Trie(text[at:])
            elif not text.startswith(child.label, at):
                child = node.split(child, _shared(child.label, text, at))
            at += len(child.label)
            node = child
        node.least = least if node.least is None else min(least, node.least)
        node.groups.append((group, least))

    def split(self, child: Trie, length: int) -> Trie:
        """Put a node of the first ``length`` bytes between this node and its child."""
        middle = Trie(child.label[:length])
        child.label = child.label[length:]
        middle.children[child.label[0]] = child
        self.children[middle.label[0]] = middle
        return middle

    def repeated(self) -> Iterator[int]:
        """Groups whose text stands under a smaller id than any of theirs."""
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield from (group for group, least in node.groups if least > node.least)
            waiting.extend(node.children.values())


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the longest beginning that ``label`` and ``text[at:]`` share."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated groups of texts that come in the order of their prefixes."""
    trie, held, prefix = Trie(), 0, None

    def found(trie: Trie) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(trie.repeated()), pa.int64())], ["group"])

    for batch in row_slices(batches, "text"):
        rows = zip(*(batch.column(c).to_pylist() for c in ("prefix", "text", "least", "group")))
        for begins, text, least, group in rows:
            if held >= TRIE_BYTES and begins != prefix:
                yield found(trie)
                trie, held = Trie(), 0
            prefix = begins
            trie.insert(text, least, group)
            held += len(text) + 200
    yield found(trie)


def with_prefixes(texts: DataFrame, most_bytes: int) -> DataFrame:
    """``texts``, a stored table, with ``prefix``: few enough bytes of texts share one.

    Only where a prefix stands for more than ``most_bytes`` is it lengthened, as often as
    it takes; a text that is no longer than its prefix cannot be told apart any further.
    """
    length = FIRST_PREFIX
    rows = texts.withColumn("prefix", F.substring("text", 1, length))
    while True:
        open_rows = rows.where((F.length("prefix") == length) & (F.length("text") > length))
        sizes = open_rows.groupBy("prefix").agg(F.sum(F.length("text")).alias("_bytes"))
        heavy = materialize(sizes.where(F.col("_bytes") > most_bytes).select(F.col("prefix").alias("_heavy")), "prefixes")
        if heavy.isEmpty():
            return rows
        length *= LONGER
        longer = F.when(F.col("_heavy").isNotNull(), F.substring("text", 1, length)).otherwise(F.col("prefix"))
        joined = rows.join(sent_when_small(heavy), F.col("prefix") == F.col("_heavy"), "left")
        rows = joined.withColumn("prefix", longer).drop("_heavy")


def _repeated(texts: DataFrame) -> DataFrame:
    """``group`` of each text row that has the same text as a row with a smaller id."""
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # A prefix that holds more than a range's share would fill several.
    dealt = with_prefixes(texts, max(1, size // ranges)).repartitionByRange(ranges, "prefix").sortWithinPartitions("prefix")
    return dealt.select("prefix", "text", "least", "group").mapInArrow(_walk, "group long")


def failure_masks(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask)`` for every row of ``(doc_id, text, source, …)``.

    Bit k of the mask is set when the row fails filter k of FILTERS. A null text counts as
    empty, a null source as the part ``''``. A row without doc_id repeats nothing and is
    repeated by nothing; rows that share a doc_id do not repeat each other.
    """
    rows = in_small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        F.coalesce("source", F.lit("")).alias("part"),
    )
    marked = materialize(rows.mapInArrow(_mark, _MARKED), "marked")
    texts = marked.where("text is not null and least is not null").select("group", "text", "least")
    repeated = materialize(_repeated(texts), "repeated").withColumn("_repeated", F.lit(True))
    thin = marked.where("part is not null").select("group", "doc_id", "part", "mask", "later")
    duplicate = F.col("doc_id").isNotNull() & (F.col("later") | F.col("_repeated").isNotNull())
    mask = F.col("mask").bitwiseOR(F.when(duplicate, DUPLICATE).otherwise(0))
    return thin.join(repeated, "group", "left").select("doc_id", "part", mask.alias("mask"))


def _total(counts: str, taken) -> Column:
    """Sum of the counts of the masks that ``taken`` takes."""
    picked = F.transform(counts, lambda n, mask: F.when(taken(mask), n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda total, n: total + n)


def _turns() -> list[tuple[int, int, list[str]]]:
    """For each filter and set of filters before it: both as bits, and the orders that have them."""
    turns: dict[tuple[int, int], list[str]] = {}
    for order in permutations(FILTERS):
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            turns.setdefault((bit, before), []).append("".join(order))
            before |= bit
    return [(bit, before, orders) for (bit, before), orders in sorted(turns.items())]


def interactions(counts: DataFrame) -> DataFrame:
    """The audit, from ``(part, mask, n, good, toxic)``: rows by part and mask."""
    masks = range(1 << len(FILTERS))
    tables = [
        F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in masks)).alias(f"_{c}")
        for c in ("n", "good", "toxic")
    ]
    parts = counts.groupBy("part").agg(*tables)
    turns = F.array(*(
        F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before"), F.array(*map(F.lit, orders)).alias("orders"))
        for bit, before, orders in _turns()
    ))
    rows = parts.select("*", F.inline(turns))
    bit, before = F.col("bit"), F.col("before")
    every = len(list(permutations(FILTERS)))
    # Of the filters that a document fails, each comes first in the same number of orders.
    shares = F.array(*(F.lit(every // max(1, m.bit_count())).cast("long") for m in masks))
    weighted = F.transform("_n", lambda n, m: n * F.get(shares, m))

    def removed(m: Column) -> Column:
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    measured = rows.withColumn("_weighted", weighted).select(
        "part",
        (F.bit_count("before") + 1).cast("int").alias("step"),
        "orders",
        _total("_n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        _total("_n", removed).alias("removed"),
        _total("_n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        _total("_n", lambda m: m == bit).alias("unique_fails"),
        _total("_good", removed).alias("good_lost"),
        _total("_toxic", removed).alias("toxic_lost"),
        _total("_weighted", lambda m: m.bitwiseAND(bit) != 0).alias("shapley"),
    )
    columns = [c for c in measured.columns if c not in ("part", "orders", "step")]
    return measured.select("part", F.explode("orders").alias("filter_order"), "step", *columns)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes in every order: a row per part, order and step.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley)``; see ``failure_masks`` for what a row of ``docs`` fails. A
    document is good (toxic) when any row of ``labels`` with its doc_id has quality
    (toxic) 1. Rows that repeat a doc_id are counted each. Other columns are not read; an
    empty table has no parts and gives no rows.
    """
    masks = failure_masks(docs)
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"),
    )
    labelled = masks.join(told, "doc_id", "left").na.fill(0, ["good", "toxic"])
    counts = labelled.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    return interactions(counts)
