from __future__ import annotations

import random

import numpy as np
import pytest

from lexsnap.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, grams string, n long"


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
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def words(rng, n):
    return ["w%d" % rng.randrange(5000) for _ in range(n)]


def changed(rng, base, count):
    copy = list(base)
    for _ in range(count):
        copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(10**6)
    return " ".join(copy)


def corpus():
    rng = random.Random(7)
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE two"), (5, "one two three"), (None, "one two")]
    for start, length, most in ((10, 200, 9), (200, 60, 3), (300, 30, 2), (400, 1500, 60)):
        base = words(rng, length)  # around the threshold: linked, near misses and chains
        rows += [(start + k, changed(rng, base, rng.randrange(0, most))) for k in range(90)]
    chain = words(rng, 300)
    rows += [(600 + k, " ".join(chain[15 * k : 15 * k + 180])) for k in range(8)]
    line = words(rng, 12)  # a line that many otherwise different texts share
    rows += [(700 + k, " ".join(words(rng, rng.randrange(0, 4)) + line + words(rng, rng.randrange(0, 5)))) for k in range(60)]
    rows += [(800 + k, " ".join(words(rng, rng.randrange(1, 400)))) for k in range(40)]
    rows += [(900, rows[20][1]), (901, rows[20][1].upper()), (901, rows[20][1]), (902, rows[30][1]), (902, rows[250][1])]
    rows += [(None, rows[20][1]), (903, " ".join(words(rng, 30_000)))]
    rows.append((904, rows[-1][1] + " and an end"))
    rng.shuffle(rows)
    return [(i, t, "x", 1) for i, t in rows]


@pytest.mark.parametrize("block", [J.BLOCK_SETS, 16])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    rows = corpus()
    got = J.similar_sets(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert J.similar_sets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filters_never_refuse_a_link():
    rng = np.random.default_rng(2)
    links = 0
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 10**6, n))
        keep = rng.random(len(a)) < rng.uniform(0.7, 1)
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 10**6, int(rng.integers(0, 15)))]))
        common = np.intersect1d(a, b)
        if not len(common):
            continue
        i, j = int(np.searchsorted(a, common[0])), int(np.searchsorted(b, common[0]))
        want = 100 * len(common) >= 80 * (len(a) + len(b) - len(common))
        assert J.linked(a, b, len(a), len(b), i, j) == want
        assert J.apart(a, b) <= len(a) + len(b) - 2 * len(common)
        links += want
    assert links > 300


def test_linked_sets_share_the_grams_that_their_first_prefixes_promise():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        a = np.unique(rng.integers(0, 10**6, int(rng.integers(1, 200))))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.92], rng.integers(0, 10**6, int(rng.integers(0, 20)))]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        met = np.intersect1d(a[: J._first_prefix(len(a))], b[: J._first_prefix(len(b))])
        for s in (a, b):
            assert len(met) >= J._shared_in_prefix(J.least_shared(len(s)))
