from __future__ import annotations

import random

import numpy as np

from lexsnap.llm import near_dedup as N
from lexsnap.llm.components import components

SCHEMA = "doc_id long, text string, component string"


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


def words(rng, n):
    return ["w%d" % rng.randrange(5000) for _ in range(n)]


def corpus():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE two"), (5, "one two three"), (None, "one two")]
    base = words(rng, 200)
    for k in range(60):  # a group of near copies, some beyond the threshold
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(200)] = "x%d" % rng.randrange(10**6)
        rows.append((10 + k, " ".join(copy)))
    chain = words(rng, 300)
    for k in range(6):  # neighbours are linked, ends are not
        rows.append((100 + k, " ".join(chain[20 * k : 20 * k + 180])))
    for k in range(40):
        rows.append((200 + k, " ".join(words(rng, rng.randrange(1, 400)))))
    rows += [(300, rows[20][1]), (301, rows[20][1].upper()), (301, rows[20][1])]
    return [(i, t, "x") for i, t in rows]


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_deduplicated_keeps_columns_and_representatives(spark):
    rows = corpus()
    rest = N.deduplicated(spark.createDataFrame(rows, SCHEMA))
    assert rest.columns == ["doc_id", "text", "component"]
    assert sorted((r.doc_id for r in rest.collect()), key=str) == sorted((b[0] for b in brute(rows) if b[3]), key=str)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def _sequential(values, places):
    """SuperMinHash of one set, element by element."""
    out = [2**64 - 1] * places
    for x in values:
        seed = np.array([x], np.uint64)
        order = list(range(places))
        for j in range(places):
            draw = int(N.draws(seed, 2 * j)[0])
            k = j + int(N.draws(seed, 2 * j + 1)[0]) % (places - j)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], (j << 52) | (draw >> 12))
    return out


def test_rounds_over_many_sets_equal_the_sequential_definition():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300)]
    got = N.superminhash(sets)
    for values, row in zip(sets, got):
        assert row.tolist() == _sequential(values, N.PLACES)


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(30)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2002), (2002, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 51)} | {1000 + k: 1000 for k in range(1, 30)} | {2001: 2000, 2002: 2000}
    assert got == want
