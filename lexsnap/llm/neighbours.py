"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search in it.

Graph: every node starts with neighbours from blocks of rows that lie together along
random hyperplane signs. Then, round by round, the neighbours and reverse neighbours of
a node meet: each pair of them of which one is new is compared, and whoever gets a
better neighbour keeps it. Search: from its own node a query goes on along the edges (both
ways) of the best nodes that it has seen and not visited, until its best ones have all
been visited.

Nodes are numbered along the first table of random signs and dealt out in parts, runs of
their numbers. What a part holds or sends to another is one row of packed arrays, so that
Spark moves a few large rows in a round and no row for each edge, meeting or comparison.

Every comparison is of the original vectors, in double precision. Nothing but the data
ends the rounds: those of the graph when few edges are new, those of a query when its
best nodes stay the same. How many these are grows with the number of nodes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from lexsnap.llm.words import draws
from lexsnap.session import in_small_batches, materialize, release, scratch_paths

EFFORT_ROWS = 50_000  # up to which the least neighbours, beam and visits do
NEIGHBOURS, MORE_NEIGHBOURS = 40, 8  # the second for each doubling beyond EFFORT_ROWS
BEAM, VISITS, MORE_VISITS = 160, 64, 64
REVERSE = 16
TABLES, SIGNS, LINE_BITS = 8, 24, 38
BLOCK_ROWS = 4096
START_NEIGHBOURS = 16  # per table
OFFERS = 8  # that a meeting makes to each who takes part
SETTLED = 0.02  # share of new edges below which the rounds end
SEED = 7
PART_ROWS, LEAST_PART, LEAST_PARTS = 4096, 256, 32  # nodes of a part, below 2^16; parts, if they are not too small
PART_BYTES = 1 << 28  # of vectors that meet in a part
MOST_OFFERS = 1 << 21  # held by a task before it drops those that are not needed
GROUP_QUERIES = 128
RANGE_ROWS = 50_000
ROUNDING = 1e-9  # more than two orders of summing can differ by


def _doublings(count: int) -> float:
    return max(0.0, float(np.log2(max(1, count) / EFFORT_ROWS)))


def neighbours_of(count: int) -> int:
    """Edges that a node keeps in a graph of ``count`` nodes."""
    return NEIGHBOURS + round(MORE_NEIGHBOURS * _doublings(count))


def visits_of(count: int) -> int:
    """Best nodes of a query that must all have been visited before it ends."""
    return VISITS + round(MORE_VISITS * _doublings(count))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square is lost or infinite."""
    rows = vectors.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _from_binary(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of one binary column without nulls, of the numpy type ``kind``."""
    column = column if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width)


def _to_binary(vectors: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in vectors], pa.binary())


def _encode(width: int, kind: str = "f4"):
    """The vectors as bytes, and per table the signs and, below them, the place along a line.

    The line orders what no plane parts, such as large groups of near copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(SEED)
        planes = random.normal(size=(width, TABLES * SIGNS))
        lines = random.normal(size=(width, TABLES))
        lines /= np.linalg.norm(lines, axis=0)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(-1, width).astype(kind)
            unit = _unit(vectors)
            signs = (unit @ planes > 0).reshape(-1, TABLES, SIGNS)
            keys = signs @ (1 << np.arange(SIGNS, dtype=np.int64)[::-1])
            place = ((unit @ lines + 1) * (1 << LINE_BITS - 1)).astype(np.int64)
            keys = (keys << LINE_BITS) + np.clip(place, 0, (1 << LINE_BITS) - 1)
            offsets = pa.array(np.arange(0, keys.size + 1, TABLES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), _to_binary(vectors), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                ["node", "code", "keys"],
            )

    return run


# What passes between the parts of the nodes and the groups of the queries, as packed arrays.
MESSAGE = "part int, kind int, source int, n long, a binary, b binary, c binary, d binary"
COLUMNS = [column.split()[0] for column in MESSAGE.split(", ")]
CODES, GRAPH, OFFERS_TO, BACK, MEMBERS, ASKED, ANSWERED, EDGES, WAYS, BEAMS, VISITS_TO, LED, REACHED, FOUND = range(14)
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SENT_BYTES = 4 << 20  # of a batch that a task gives back


def _ids(count: int) -> str:
    """The numpy type that numbers of nodes travel in."""
    return "i4" if count < 1 << 31 else "i8"


def part_rows(count: int, width: int) -> int:
    """Nodes of a part: a task holds the vectors of all of their surroundings in doubles."""
    rows = max(LEAST_PART, min(PART_ROWS, -(-count // LEAST_PARTS)))
    return max(1, min(rows, PART_BYTES // ((neighbours_of(count) + REVERSE) * width * 12)))


def _numbers(buffer: pa.Buffer, kind: str) -> np.ndarray:
    return np.frombuffer(buffer, kind) if buffer.size else np.empty(0, kind)


def _received(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], list[tuple]]:
    """The messages of a task by part and kind: ``(source, a, b, c, d)``, in order of their sources."""
    found: dict[tuple[int, int], list[tuple]] = {}
    for batch in batches:
        columns = [batch.column(c) for c in "abcd"]
        for row, key in enumerate(zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist())):
            found.setdefault(key, []).append((batch.column("source")[row].as_py(), *(c[row].as_buffer() for c in columns)))
    for rows in found.values():
        rows.sort(key=lambda row: row[0])
    return found


def _sent(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of messages ``(part, kind, source, n, *arrays)``."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds)], COLUMNS)

    for part, kind, source, n, *arrays in rows:
        data = [x.tobytes() for x in arrays] + [b""] * (4 - len(arrays))
        held.append((part, kind, source, n, *data))
        size += sum(map(len, data)) + 64
        if size >= SENT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _by_part(parts: np.ndarray, kind: int, source: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """One message for each part that rows go to."""
    order = _sorted_by(parts)
    parts, arrays = parts[order], [x[order] for x in arrays]
    for start, length in zip(*_runs(parts)):
        yield int(parts[start]), kind, source, int(length), *(x[start : start + length] for x in arrays)


def _dealt(frames: list[DataFrame], parts: int) -> DataFrame:
    """The messages, all of a part in one task."""
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    return in_small_batches(every.repartitionById(parts, "part"))


def _stored(messages: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A stored table and its path.

    The shuffles behind it go as soon as it is written: left to the driver's collection
    of garbage, those of all rounds could lie on disk at a time.
    """
    conf = messages.sparkSession.conf
    was = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        stored = materialize(messages, label)
    finally:
        conf.set(SHUFFLES_GO, was)
    return stored, scratch_paths(stored.sparkSession)[-1]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, int)
    return starts, np.diff(np.append(starts, len(values)))


def _sorted_by(groups: np.ndarray) -> np.ndarray:
    """A stable order; small numbers need no comparisons."""
    low = int(groups.min()) if len(groups) else 0
    few = len(groups) and int(groups.max()) - low < 1 << 16
    return np.argsort((groups - low).astype("u2") if few else groups, kind="stable")


def _leading(count: int, groups: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Where the first ``count`` rows of each group are, by group and ``order``."""
    index = np.argsort(order[-1], kind="stable")
    for key in order[-2::-1]:
        index = index[np.argsort(key[index], kind="stable")]
    index = index[_sorted_by(groups[index])]
    starts, lengths = _runs(groups[index])
    return index[np.arange(len(index)) - np.repeat(starts, lengths) < count]


def _kept(count: int, groups: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The same rows, in no order; only groups of more rows are sorted by ``order``."""
    index = np.argsort(groups)
    _, lengths = _runs(groups[index])
    many = np.repeat(lengths > count, lengths)
    rows = index[many]
    return np.append(index[~many], rows[_leading(count, groups[rows], *(x[rows] for x in order))])


def _single(keys: np.ndarray) -> np.ndarray:
    """Where one row of each key is, by key."""
    index = np.argsort(keys)
    return index[_runs(keys[index])[0]]


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the sorted different values are among some others?"""
    found = np.zeros(len(values), bool)
    at = np.searchsorted(values, some)
    there = at < len(values)
    there[there] = values[at[there]] == some[there]
    found[at[there]] = True
    return found


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the stretches, one stretch after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _pack_codes(width: int, kind: str):
    """The vectors of a part as one message, in order of the nodes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = [(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "node")), _from_binary(b.column("code"), width, kind)) for b in batches if b.num_rows]
        if held:
            parts, nodes, codes = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(nodes)
            yield from _by_part(parts[order], CODES, 0, codes[order])

    return lambda batches: _sent(rows(batches))


def _packed_codes(codes: DataFrame, count: int, width: int, kind: str) -> tuple[DataFrame, str]:
    rows = part_rows(count, width)
    dealt = codes.select((F.col("node") / rows).cast("int").alias("part"), "node", "code").repartitionById(-(-count // rows), "part")
    return _stored(in_small_batches(dealt).mapInArrow(_pack_codes(width, kind), MESSAGE), "vectors-of-parts")


def _best(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``count`` largest of each row."""
    others = max(0, scores.shape[1] - count)
    best = np.argpartition(scores, others, axis=1)[:, others:]
    return best, scores[np.arange(len(best))[:, None], best]


def _compare_blocks(width: int, kind: str, part: int, ids: str):
    """Best neighbours within blocks of consecutive rows of one table."""

    def block(nodes: np.ndarray, codes: np.ndarray) -> Iterator[tuple]:
        if len(nodes) < 2:
            return
        unit, near, value = _unit(codes), [], []
        for start in range(0, len(nodes), 128):
            scores = unit[start : start + 128] @ unit.T
            scores[np.arange(len(scores)), np.arange(start, start + len(scores))] = -9
            best, high = _best(scores, min(START_NEIGHBOURS, len(nodes) - 1))
            near.append(best)
            value.append(high)
        near, value = np.concatenate(near), np.concatenate(value)
        who = np.repeat(nodes, near.shape[1])
        yield from _by_part(who // part, OFFERS_TO, 0, (who % part).astype("i4"), nodes[near.reshape(-1)].astype(ids), value.reshape(-1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, table = 0, None

        def flush() -> Iterator[tuple]:
            nonlocal rows
            if held:
                yield from block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held.clear()
            rows = 0

        for batch in batches:
            tables = batch.column("table").to_numpy(zero_copy_only=False)
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            codes = _from_binary(batch.column("code"), width, kind)
            start = 0
            while start < len(nodes):
                if tables[start] != table or rows >= BLOCK_ROWS:
                    yield from flush()
                    table = tables[start]
                same = int(np.searchsorted(tables[start:], table, side="right")) + start
                stop = min(same, start + BLOCK_ROWS - rows)
                held.append((nodes[start:stop], codes[start:stop]))
                rows += stop - start
                start = stop
        yield from flush()

    return lambda batches: _sent(rows(batches))


def _merge(kept: int, part: int, count: int, ids: str):
    """The edges of a part with the offers that are good enough; what it had is no longer fresh."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found = _received(batches)
        for number in sorted({key[0] for key in found}):
            size = min(part, count - number * part)
            own, other, score, fresh = [], [], [], []
            for _, a, b, c, _ in found.get((number, GRAPH), []):
                others = _numbers(a, ids)
                there = others >= 0
                own.append(np.repeat(np.arange(len(others) // kept, dtype="i4"), kept)[there])
                other.append(others[there])
                score.append(_numbers(b, "f8")[there])
                fresh.append(np.zeros(there.sum(), bool))
            for _, a, b, c, _ in found.pop((number, OFFERS_TO), []):
                own.append(_numbers(a, "i4"))
                other.append(_numbers(b, ids))
                score.append(_numbers(c, "f8"))
                fresh.append(np.ones(len(own[-1]), bool))
            own, other, score, fresh = (np.concatenate(x) for x in (own, other, score, fresh))
            pair = (own * np.int64(count) + other) * 2 + fresh
            single = np.argsort(pair)
            single = single[_runs(pair[single] >> 1)[0]]
            own, other, score, fresh = (x[single] for x in (own, other, score, fresh))
            best = _leading(kept, own, -score)  # of equal ones the smaller number, for they are in that order
            own, other, score, fresh = (x[best] for x in (own, other, score, fresh))
            place = np.arange(len(own)) - np.searchsorted(own, own)
            others, scores, new = np.full((size, kept), -1, ids), np.full((size, kept), -2.0), np.zeros((size, kept), bool)
            others[own, place], scores[own, place], new[own, place] = other, score, fresh
            yield number, GRAPH, 0, int(new.sum()), others, scores, new

    return lambda batches: _sent(rows(batches))


def _edges_of(part: int, kept: int, ids: str, row: tuple, number: int) -> tuple[np.ndarray, ...]:
    """``(node, other, score, fresh)`` of a part's message."""
    others = _numbers(row[1], ids)
    there = others >= 0
    nodes = np.repeat(number * part + np.arange(len(others) // kept), kept)
    return nodes[there], others[there].astype("i8"), _numbers(row[2], "f8")[there], _numbers(row[3], "?")[there]


def _turned(node: np.ndarray, member: np.ndarray, turn: int) -> np.ndarray:
    """An order of the pairs that is another one in each round."""
    with np.errstate(over="ignore"):
        return draws(node.astype("u8") * np.uint64(0x9E3779B97F4A7C15) ^ member.astype("u8"), turn)


def _back(kept: int, part: int, ids: str, turn: int):
    """Edges to the part of the node that they lead to, no more for a node than it takes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (number, _), messages in _received(batches).items():
            node, other, _, fresh = _edges_of(part, kept, ids, messages[0], number)
            best = _kept(REVERSE, other, ~fresh, _turned(other, node, turn), node)
            node, other, fresh = node[best], other[best], fresh[best]
            yield from _by_part(other // part, BACK, number, (other % part).astype("i4"), node.astype(ids), fresh)

    return lambda batches: _sent(rows(batches))


def _surround(kept: int, part: int, count: int, ids: str, turn: int):
    """Who meets at each node of a part, and the vectors that this takes, asked of their parts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found = _received(batches)
        for number in sorted({key[0] for key in found}):
            edges = [_edges_of(part, kept, ids, row, number) for row in found.get((number, GRAPH), [])]
            back = found.get((number, BACK), [])
            own = np.concatenate([_numbers(row[1], "i4") for row in back] or [np.empty(0, "i4")])
            member = np.concatenate([_numbers(row[2], ids) for row in back] or [np.empty(0, ids)]).astype("i8")
            fresh = np.concatenate([_numbers(row[3], "?") for row in back] or [np.empty(0, "?")])
            best = _kept(REVERSE, own, ~fresh, _turned(own + np.int64(number) * part, member, turn), member)
            own = np.concatenate([own[best], *((e[0] % part).astype("i4") for e in edges)])
            member = np.concatenate([member[best], *(e[1] for e in edges)])
            fresh = np.concatenate([fresh[best], *(e[3] for e in edges)])
            pair = (own * np.int64(count) + member) * 2 + ~fresh
            single = np.argsort(pair)
            single = single[_runs(pair[single] >> 1)[0]]
            own, member, fresh = own[single], member[single], fresh[single]
            # Old members alone have met before.
            some = np.bincount(own, fresh, part)[own] > 0
            some &= np.bincount(own, minlength=part)[own] > 1
            own, member, fresh = own[some], member[some], fresh[some]
            if len(own):
                wanted = np.unique(member)
                yield number, MEMBERS, 0, len(own), own, np.searchsorted(wanted, member).astype("i4"), fresh, wanted.astype(ids)
                yield from _by_part(wanted // part, ASKED, number, (wanted % part).astype("i4"))

    return lambda batches: _sent(rows(batches))


def _answer(kept: int, part: int, width: int, kind: str, ids: str):
    """Vectors to the parts that asked for them, and the score that an offer must exceed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found = _received(batches)
        for number in sorted({key[0] for key in found}):
            codes = _numbers(found[number, CODES][0][1], kind).reshape(-1, width)
            graph = found[number, GRAPH][0]
            full = _numbers(graph[1], ids).reshape(-1, kept)[:, -1] >= 0
            worst = np.where(full, _numbers(graph[2], "f8").reshape(-1, kept)[:, -1], -2.0)
            for asker, a, *_ in found.get((number, ASKED), []):
                wanted = _numbers(a, "i4")
                yield asker, ANSWERED, number, len(wanted), worst[wanted], codes[wanted]

    return lambda batches: _sent(rows(batches))


def _meet(kept: int, part: int, width: int, kind: str, ids: str):
    """The members of each node's surroundings compare each other."""

    def offers(unit: np.ndarray, worst: np.ndarray, fresh: np.ndarray) -> Iterator[tuple]:
        """Best partners among the members of one node, of pairs with a fresh one."""
        new, old = np.flatnonzero(fresh), np.flatnonzero(~fresh)
        scores = unit[new] @ unit.T
        scores[np.arange(len(new)), new] = -9
        for who, others, value in ((new, np.arange(len(unit)), scores), (old, new, scores[:, old].T)):
            value = np.where(value > worst[who][:, None], value, -9)
            some = np.flatnonzero(value.max(axis=1) > -9)
            if len(some):
                best, value = _best(value[some], OFFERS)
                row, column = np.nonzero(value > -9)
                yield who[some[row]], others[best[row, column]], value[row, column]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found = _received(batches)
        for number in sorted({key[0] for key in found}):
            if (number, MEMBERS) not in found:
                continue
            _, a, b, c, d = found[number, MEMBERS][0]
            own, place, fresh, wanted = _numbers(a, "i4"), _numbers(b, "i4"), _numbers(c, "?"), _numbers(d, ids).astype("i8")
            unit, worst, at = np.empty((len(wanted), width)), np.empty(len(wanted)), 0
            answers = found.pop((number, ANSWERED))[::-1]
            while answers:  # in order of their parts, as the nodes wanted are
                _, low, code, *_ = answers.pop()
                low = _numbers(low, "f8")
                worst[at : at + len(low)] = low
                unit[at : at + len(low)] = _unit(_numbers(code, kind).reshape(-1, width))
                at += len(low)

            held: list[tuple[np.ndarray, ...]] = []

            def best_held() -> None:
                """Of the offers to a member no more than it can take."""
                who, other, value = (np.concatenate(x) for x in zip(*held))
                single = _single(who * np.int64(len(wanted)) + other)
                who, other, value = who[single], other[single], value[single]
                best = _kept(kept, who, -value, other)
                held[:] = [(who[best], other[best], value[best])]

            size = 0
            for start, length in zip(*_runs(own)):
                who = place[start : start + length]
                for to, other, value in offers(unit[who], worst[who], fresh[start : start + length]):
                    held.append((who[to], who[other], value))
                    size += len(to)
                if size > MOST_OFFERS:
                    best_held()
                    size = len(held[0][0]) // 2
            if held:
                best_held()
                who, other, value = held[0]
                who = wanted[who]
                yield from _by_part(who // part, OFFERS_TO, number, (who % part).astype("i4"), wanted[other].astype(ids), value)

    return lambda batches: _sent(rows(batches))


def _edge_rows(kept: int, part: int, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number, _), messages in _received(batches).items():
            columns = _edges_of(part, kept, ids, messages[0], number)
            for start in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + (1 << 16)]) for c in columns], ["node", "other", "score", "fresh"])

    return run


def neighbour_graph(codes: DataFrame, width: int, kind: str = "f4") -> DataFrame:
    """``(node, other, score, fresh)``: about the nearest ``neighbours_of`` nodes of each.

    ``codes`` is a stored table ``(node, code, keys)`` of different vectors, whose
    components ``code`` holds as the numpy type ``kind``; nodes are numbered from 0 without
    gaps. A part is a run of node numbers: its edges are one packed row, and in a round a
    vector goes once to each part that has a meeting of its node.
    """
    spark = codes.sparkSession
    count = codes.count()
    kept, part, ids = neighbours_of(count), part_rows(count, width), _ids(count)
    parts = -(-count // part)
    vectors, vectors_path = _packed_codes(codes, count, width, kind)
    blocks = max(1, -(-count * TABLES // BLOCK_ROWS))
    spread = codes.select("node", "code", F.posexplode("keys").alias("table", "key"))
    spread = spread.repartitionByRange(blocks, "table", "key").sortWithinPartitions("table", "key", "node")
    offers = in_small_batches(spread.select("table", "node", "code")).mapInArrow(_compare_blocks(width, kind, part, ids), MESSAGE)
    none = vectors.select("part", F.lit(GRAPH).alias("kind"), "source", "n", *(F.lit(b"").alias(c) for c in "abcd"))
    merge = _merge(kept, part, count, ids)
    graph, path = _stored(_dealt([none, offers], parts).mapInArrow(merge, MESSAGE), "graph")

    # Ends by itself: a round with fresh edges has made the graph better.
    for turn in itertools.count():
        back = in_small_batches(graph).mapInArrow(_back(kept, part, ids, turn), MESSAGE)
        around, around_path = _stored(_dealt([graph, back], parts).mapInArrow(_surround(kept, part, count, ids, turn), MESSAGE), "around")
        answers = _dealt([vectors, graph, around.where(F.col("kind") == ASKED)], parts).mapInArrow(_answer(kept, part, width, kind, ids), MESSAGE)
        offers = _dealt([around.where(F.col("kind") == MEMBERS), answers], parts).mapInArrow(_meet(kept, part, width, kind, ids), MESSAGE)
        better, better_path = _stored(_dealt([graph, offers], parts).mapInArrow(merge, MESSAGE), "graph")
        release(spark, [path, around_path])
        graph, path = better, better_path
        if (graph.agg(F.sum("n")).first()[0] or 0) <= SETTLED * count * kept:
            break
    release(spark, [vectors_path])
    return in_small_batches(graph).mapInArrow(_edge_rows(kept, part, ids), "node long, other long, score double, fresh boolean")


def _pack_edges(kept: int, part: int, ids: str):
    """Edges to the parts of both their ends; of those that lead to a node, its best."""

    def packed(held: list[tuple]) -> Iterator[tuple]:
        node, other, score = (np.concatenate(c) for c in zip(*held))
        yield from _by_part(node // part, EDGES, 0, (node % part).astype("i4"), other.astype(ids))
        best = _kept(kept, other, -score, node)
        node, other, score = node[best], other[best], score[best]
        yield from _by_part(other // part, BACK, 0, (other % part).astype("i4"), node.astype(ids), score)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "other", "score")])
            size += batch.num_rows
            if size >= MOST_OFFERS:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return lambda batches: _sent(rows(batches))


def _ways(kept: int, part: int, count: int, ids: str):
    """For each node of a part the nodes that an edge joins it with, either way."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found = _received(batches)
        for number in sorted({key[0] for key in found}):
            size = min(part, count - number * part)
            there, back = found.get((number, EDGES), []), found.get((number, BACK), [])
            none = [(0, *[pa.py_buffer(b"")] * 4)]
            own, other, score = (np.concatenate([_numbers(row[k], t) for row in back or none]) for k, t in ((1, "i4"), (2, ids), (3, "f8")))
            best = _kept(kept, own, -score, other)
            own = np.concatenate([own[best], *(_numbers(row[1], "i4") for row in there)])
            other = np.concatenate([other[best], *(_numbers(row[2], ids) for row in there)])
            single = _single(own * np.int64(count) + other)
            yield number, WAYS, 0, size, np.bincount(own[single], minlength=size), other[single]

    return lambda batches: _sent(rows(batches))


class _Beams:
    """The best nodes of each query of a group, and which of them it has visited."""

    def __init__(self, row: tuple, width: int, kind: str, ids: str):
        self.queries, self.lengths = _numbers(row[1], "i8").reshape(2, -1)
        self.codes = _numbers(row[2], kind).reshape(-1, width)
        self.nodes, self.scores = _numbers(row[3], ids), None
        data = _numbers(row[4], "u1")
        self.scores, self.visited = data[: 8 * len(self.nodes)].view("f8"), data[8 * len(self.nodes) :].view("?")
        self.owner = np.repeat(np.arange(len(self.queries)), self.lengths)
        self.place = np.arange(len(self.nodes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def next(self, visits: int) -> np.ndarray:
        """Those of the best nodes that are to be visited now."""
        return (self.place < visits) & ~self.visited


def _beams_row(group: int, queries: np.ndarray, codes: np.ndarray, owner, nodes, scores, visited, visits: int) -> tuple:
    """The message that ``_Beams`` reads; rows are in order of their owners, best first."""
    lengths = np.bincount(owner, minlength=len(queries))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = int(((place < visits) & ~visited).sum())
    data = np.concatenate([np.ascontiguousarray(scores, "f8").view("u1"), visited.view("u1")])
    return group, BEAMS, 0, left, np.stack([queries, lengths]).astype("i8"), codes, nodes, data


def _first_beams(width: int, kind: str, ids: str, visits: int):
    """Each query starts at its own node."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = [(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "query")), _from_binary(b.column("code"), width, kind)) for b in batches if b.num_rows]
        parts, queries, codes = (np.concatenate(c) for c in zip(*held)) if held else ([], [], [])
        for group, _, _, count, queries, codes in _by_part(parts, BEAMS, 0, queries, codes) if held else ():
            yield _beams_row(group, queries, codes, np.arange(count), queries.astype(ids), np.full(count, 2.0), np.zeros(count, bool), visits)

    return lambda batches: _sent(rows(batches))


def _visit(width: int, kind: str, part: int, ids: str, visits: int):
    """Asks the parts of the nodes to be visited where they lead."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (group, _), messages in _received(batches).items():
            beams = _Beams(messages[0], width, kind, ids)
            nodes = np.unique(beams.nodes[beams.next(visits)])
            yield from _by_part(nodes // part, VISITS_TO, group, nodes)

    return lambda batches: _sent(rows(batches))


def _lead(part: int, ids: str):
    """Where the nodes visited lead, once for each group of queries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found = _received(batches)
        for number in sorted({key[0] for key in found}):
            _, a, b, *_ = found[number, WAYS][0]
            lengths, others = _numbers(a, "i8"), _numbers(b, ids)
            starts = np.cumsum(lengths) - lengths
            for group, nodes, *_ in found.get((number, VISITS_TO), []):
                nodes = _numbers(nodes, ids)
                own = nodes - number * part
                yield group, LED, number, len(nodes), nodes, lengths[own], others[_stretches(starts[own], lengths[own])]

    return lambda batches: _sent(rows(batches))


def _reach(width: int, kind: str, part: int, ids: str, visits: int, held: int):
    """Queries to the parts of the nodes that they have reached and do not hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found = _received(batches)
        for group in sorted({key[0] for key in found}):
            beams, led = _Beams(found[group, BEAMS][0], width, kind, ids), found.get((group, LED))
            if not led:
                continue
            nodes, lengths, others = (np.concatenate([_numbers(row[k], t) for row in led]) for k, t in ((1, ids), (2, "i8"), (3, ids)))
            starts, now = np.cumsum(lengths) - lengths, beams.next(visits)
            owner, reached = [], []
            last = np.cumsum(beams.lengths)
            for query in np.unique(beams.owner[now]):
                mine = slice(last[query] - beams.lengths[query], last[query])
                at = np.searchsorted(nodes, beams.nodes[mine][now[mine]])
                ends = np.unique(others[_stretches(starts[at], lengths[at])])
                ends = ends[~_among(ends, beams.nodes[mine])]
                owner.append(np.full(len(ends), query, "i4"))
                reached.append(ends)
            owner, reached = np.concatenate(owner), np.concatenate(reached)
            lowest = np.full(len(beams.queries), -2.0)
            full = np.flatnonzero(beams.lengths >= held)
            lowest[full] = beams.scores[last[full] - 1]
            for to, _, _, n, asking, wanted in _by_part(reached // part, REACHED, group, owner, (reached % part).astype("u2")):
                who, counts = np.unique(asking, return_counts=True)
                yield to, REACHED, group, n, np.stack([who, counts]).astype("i8"), wanted, lowest[who], beams.codes[who]

    return lambda batches: _sent(rows(batches))


def _compare(width: int, kind: str, part: int, ids: str):
    """Scores of the nodes that queries have reached, where they exceed what the query holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found = _received(batches)
        for number in sorted({key[0] for key in found}):
            if (number, REACHED) not in found:
                continue
            unit = _unit(_numbers(found[number, CODES][0][1], kind).reshape(-1, width))
            for group, a, b, c, d in found[number, REACHED]:
                (who, counts), reached, lowest = _numbers(a, "i8").reshape(2, -1), _numbers(b, "u2"), _numbers(c, "f8")
                queries = _unit(_numbers(d, kind).reshape(-1, width))
                scores = np.empty(len(reached))
                for query, (start, end) in enumerate(itertools.pairwise(np.append(0, np.cumsum(counts)))):
                    scores[start:end] = unit[reached[start:end]] @ queries[query]
                better = scores > np.repeat(lowest, counts)
                if better.any():
                    owner = np.repeat(who, counts)[better].astype("i4")
                    yield group, FOUND, number, len(owner), owner, (number * part + reached[better].astype("i8")).astype(ids), scores[better]

    return lambda batches: _sent(rows(batches))


def _next_beams(width: int, kind: str, ids: str, visits: int, held: int):
    """A node that has left a beam is worse than all of it and never comes back."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found = _received(batches)
        for group in sorted({key[0] for key in found}):
            beams, more = _Beams(found[group, BEAMS][0], width, kind, ids), found.get((group, FOUND), [])
            owner = np.concatenate([beams.owner, *(_numbers(row[1], "i4") for row in more)])
            nodes = np.concatenate([beams.nodes, *(_numbers(row[2], ids) for row in more)])
            scores = np.concatenate([beams.scores, *(_numbers(row[3], "f8") for row in more)])
            visited = np.append(beams.visited | beams.next(visits), np.zeros(len(owner) - len(beams.owner), bool))
            best = _leading(held, owner, -scores, nodes)
            yield _beams_row(group, beams.queries, beams.codes, owner[best], nodes[best], scores[best], visited[best], visits)

    return lambda batches: _sent(rows(batches))


def _beam_rows(width: int, kind: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for messages in _received(batches).values():
            beams = _Beams(messages[0], width, kind, ids)
            columns = [beams.queries[beams.owner], beams.nodes.astype("i8"), beams.scores]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "node", "score"])

    return run


def greedy_search(graph: DataFrame, codes: DataFrame, queries: DataFrame, width: int, kind: str = "f4") -> DataFrame:
    """``(query, node, score)``: the best nodes found for each query node, itself included (score 2).

    Nodes are numbered as for ``neighbour_graph``. Queries are dealt out in groups, and a
    round takes a group to the parts of the nodes it visits, for their edges, and to the
    parts of the nodes it reaches, for their vectors.
    """
    spark = codes.sparkSession
    codes = codes.select("node", "code")
    count = codes.count()
    kept, visits, part, ids = neighbours_of(count), visits_of(count), part_rows(count, width), _ids(count)
    parts, held = -(-count // part), max(BEAM, 2 * visits)
    vectors, vectors_path = _packed_codes(codes, count, width, kind)
    none = vectors.select("part", F.lit(EDGES).alias("kind"), "source", "n", *(F.lit(b"").alias(c) for c in "abcd"))
    edges = graph.select("node", "other", "score").mapInArrow(_pack_edges(kept, part, ids), MESSAGE)
    ways, ways_path = _stored(_dealt([none, edges], parts).mapInArrow(_ways(kept, part, count, ids), MESSAGE), "ways")

    wanted = queries.join(codes, "node").select(F.col("node").alias("query"), "code")
    wanted, wanted_path = _numbered(wanted, ["query"], "queries")
    groups = max(1, -(-wanted.count() // GROUP_QUERIES))
    wanted = wanted.select((F.col("number") / GROUP_QUERIES).cast("int").alias("part"), "query", "code")
    first = in_small_batches(wanted.repartitionById(groups, "part")).mapInArrow(_first_beams(width, kind, ids, visits), MESSAGE)
    beams, path = _stored(first, "beams")
    release(spark, [wanted_path])
    while beams.agg(F.sum("n")).first()[0]:
        asked = in_small_batches(beams).mapInArrow(_visit(width, kind, part, ids, visits), MESSAGE)
        led = _dealt([ways, asked], parts).mapInArrow(_lead(part, ids), MESSAGE)
        reached = _dealt([beams, led], groups).mapInArrow(_reach(width, kind, part, ids, visits, held), MESSAGE)
        found = _dealt([vectors, reached], parts).mapInArrow(_compare(width, kind, part, ids), MESSAGE)
        better, better_path = _stored(_dealt([beams, found], groups).mapInArrow(_next_beams(width, kind, ids, visits, held), MESSAGE), "beams")
        release(spark, [path])
        beams, path = better, better_path
    release(spark, [vectors_path, ways_path])
    return in_small_batches(beams).mapInArrow(_beam_rows(width, kind, ids), "query long, node long, score double")


def _numbered(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, str]:
    """The rows with a ``number``, from 0 without gaps along ``order``; one count per range on the driver."""
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed, path = _stored(placed.withColumn("place", F.monotonically_increasing_id()), label)
    held = {r.number: r.n for r in placed.groupBy(F.shiftright("place", 33).cast("int").alias("number")).agg(F.count("*").alias("n")).collect()}
    before = list(itertools.accumulate((held.get(k, 0) for k in range(max(held, default=0))), initial=0))
    start = F.element_at(F.lit(before).cast("array<long>"), F.shiftright("place", 33).cast("int") + 1)
    return placed.withColumn("number", start + F.col("place").bitwiseAND((1 << 33) - 1)).drop("place"), path


def _dot(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` of the different rows whose vector has a direction.

    Null vectors, those with null, NaN or infinite components, empty and zero ones and
    rows without vec_id are left out. Floats stay floats, other numbers become doubles.
    """
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    infinite = float("inf")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return rows.where(F.col("vec_id").isNotNull() & sound & F.exists("vector", lambda x: x != 0)).distinct()


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``(vec_id, embedding, …)`` that ``is_query`` takes.

    ``(query_id, rank, vec_id, score)``: cosines in double precision of the original
    vectors, largest first, ties to the smaller vec_id; a query is no neighbour of its
    own. Equal vectors are one node of the graph, with their k + 1 smallest ids: no more
    can be among the nearest. Rows that repeat a vec_id with another vector are further
    vectors of it: each is searched and found, the largest cosine between two ids counts.
    Vectors have a cosine with those of their own length only, so each length is a graph
    of its own. Unusable vectors (see ``usable``) take no part; other columns are not read.
    """
    rows = materialize(usable(vectors).withColumn("width", F.size("vector")), "vectors")
    # One number per length that occurs.
    widths = [r.width for r in rows.select("width").distinct().orderBy("width").collect()]
    scored = [_scored(rows.where(F.col("width") == width).drop("width"), width, is_query, k) for width in widths]
    if not scored:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = scored[0]
    for more in scored[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scored(rows: DataFrame, width: int, is_query: Column, k: int) -> DataFrame:
    """``(query_id, vec_id, score)`` of the best that the search finds among vectors of one length."""
    single = isinstance(rows.schema["vector"].dataType.elementType, FloatType)
    kind = "f4" if single else "f8"
    same = Window.partitionBy("vector").orderBy("vec_id")
    ranked = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    ranked = materialize(ranked, "copies")
    # An id may have several vectors, so nodes get numbers of their own, fixed once written.
    different = ranked.where("place = 1").select("vector", F.monotonically_increasing_id().alias("row"))
    different = materialize(different, "different")
    encoded = different.select(F.col("row").alias("node"), "vector").mapInArrow(_encode(width, kind), "node long, code binary, keys array<long>")
    encoded = materialize(encoded.select(F.col("node").alias("row"), "code", "keys", F.col("keys")[0].alias("home")), "encoded")
    placed, _ = _numbered(encoded, ["home", "row"], "codes")
    codes = placed.select(F.col("number").alias("node"), "code", "keys")
    nodes = materialize(different.join(placed.select("row", "number"), "row").select("vector", F.col("number").alias("node")), "nodes")
    graph = neighbour_graph(codes, width, kind)

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").join(nodes, "vector")
    asked = materialize(asked.select("query_id", F.col("node").alias("query"), F.col("vector").alias("query_vector")), "asked")
    found = greedy_search(graph, codes, asked.select(F.col("query").alias("node")).distinct(), width, kind)
    copies = ranked.select("vec_id", "vector").join(nodes, "vector").select("node", "vec_id")
    found = asked.select("query_id", "query").join(found, "query").join(copies, "node").where("vec_id != query_id")
    # The search's scores are those below but for the order of the sums: what is further from
    # the k-th id than any rounding is not among the nearest.
    by_score = Window.partitionBy("query_id", "query").orderBy(F.desc("score"))
    ids = found.groupBy("query_id", "query", "vec_id").agg(F.max("score").alias("score"))
    least = ids.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k)
    least = least.groupBy("query_id", "query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    near = found.join(least, ["query_id", "query"]).where((F.col("n") < k) | (F.col("score") >= F.col("least") - ROUNDING))
    pairs = near.select("query_id", "query", "vec_id", "node").join(asked, ["query_id", "query"]).join(nodes, "node")
    if not single:  # squares of doubles may be lost or infinite
        for name in ("query_vector", "vector"):
            most = F.array_max(F.transform(name, F.abs))
            pairs = pairs.withColumn("most", most).withColumn(name, F.transform(name, lambda x: x / F.col("most")))
    cosine = _dot("query_vector", "vector") / (F.sqrt(_dot("query_vector", "query_vector")) * F.sqrt(_dot("vector", "vector")))
    return pairs.select("query_id", "vec_id", cosine.alias("score"))
