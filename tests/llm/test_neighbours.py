from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexsnap.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, node string"


def brute(rows, is_query, k, dtype=np.float32):
    """Vectors of each length apart; the largest cosine between two ids counts."""
    scores = {}
    good = {}
    for vec_id, vector, *_ in rows:
        if vec_id is None or vector is None or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
            continue
        good.setdefault(len(vector), {})[vec_id, tuple(vector)] = None
    for members in good.values():
        ids = [i for i, _ in members]
        matrix = np.array([v for _, v in members], dtype).astype(float)
        matrix /= np.abs(matrix).max(axis=1, keepdims=True)
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        for q, i in enumerate(ids):
            if is_query(i):
                mine = scores.setdefault(i, {})
                for other, score in zip(ids, unit @ unit[q]):
                    if other != i:
                        mine[other] = max(score, mine.get(other, -9))
    order = lambda item: (-round(item[1], 12), item[0])
    return {i: sorted(mine.items(), key=order)[:k] for i, mine in scores.items() if mine}


def compare(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, near in want.items():
        mine = found.get(q, [])
        assert [r["rank"] for r in mine] == list(range(1, len(near) + 1))
        hits += len({r.vec_id for r in mine} & {i for i, _ in near})
        total += len(near)
    return hits / max(1, total)


def test_recall_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in docs.select("vec_id", "embedding").collect()]
    got = N.nearest_neighbours(docs, F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert compare(got, want) >= 0.95
    for r in got:
        exact = dict(want[r.query_id]).get(r.vec_id)
        assert exact is None or abs(exact - r.score) < 1e-12


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 4)).astype(np.float32).tolist()
    rows = [(i, points[i], "x") for i in range(60)]
    rows += [(100 + i, points[0], None) for i in range(40)]  # copies of one vector
    nan, inf = float("nan"), float("inf")
    bad = [None, [nan, 0.0, 0.0, 1.0], [inf, 0.0, 0.0, 1.0], [None, 1.0, 1.0, 1.0], [0.0] * 4, [], [1.0, 2.0]]
    rows += [(200 + k * 50, v, None) for k, v in enumerate(bad)]
    rows += [(5, points[5], None), (None, points[1], None)]
    got = N.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert {r.query_id for r in got} == set(want)
    assert compare(got, want) == 1.0
    mine = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 100]
    assert mine == [0, 101, 102, 103, 104]


def test_each_length_and_each_vector_of_an_id_takes_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), None) for i in range(200)]
    rows += [(i, rng.normal(size=8).astype(np.float32).tolist(), None) for i in range(200, 300)]
    rows += [(i, rng.normal(size=4).astype(np.float32).tolist(), None) for i in range(0, 100, 5)]
    rows += [(i, rng.normal(size=8).astype(np.float32).tolist(), None) for i in range(0, 100, 25)]
    rows += rows[:10]
    got = N.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert {r.query_id for r in got} == set(want) == {0, 50, 100, 150, 200, 250}
    assert compare(got, want) == 1.0


def test_doubles_beyond_floats(spark):
    rng = np.random.default_rng(6)
    size = np.array([1e200, 1e-200, 1.0])[np.arange(90) % 3]
    rows = [(i, (rng.normal(size=6) * size[i]).tolist(), None) for i in range(90)]
    # Directions that floats do not tell apart.
    rows += [(100 + i, [1.0, 1.0 + i * 1e-12, 0.0, 0.0, 0.0, 0.0], None) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = N.nearest_neighbours(table, F.col("vec_id") % 10 == 0).collect()
    want = brute(rows, lambda i: i % 10 == 0, 5, float)
    assert {r.query_id for r in got} == set(want)
    for r in got:  # within the last group all are as near
        assert abs(want[r.query_id][r["rank"] - 1][1] - r.score) < 1e-12


def test_fewer_candidates_than_asked_for_and_none(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [1.0, 1.0], "x"), (2, [0.0, 1.0], "x")], SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id) for r in N.nearest_neighbours(three, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert N.nearest_neighbours(three.limit(0), F.col("vec_id") == 0).count() == 0
    assert N.nearest_neighbours(three.limit(1), F.col("vec_id") == 0).count() == 0


def recall(spark, matrix, every):
    rows = [(i, v, None) for i, v in enumerate(matrix.astype(np.float32).tolist())]
    got = N.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0).collect()
    return compare(got, brute(rows, lambda i: i % every == 0, 5))


def test_near_copies_closer_than_a_byte_tells_apart(spark):
    rng = np.random.default_rng(3)
    group = rng.normal(size=64) + 0.002 * rng.normal(size=(3000, 64))
    assert recall(spark, np.concatenate([group, rng.normal(size=(1000, 64))]), 20) >= 0.95


def test_a_search_goes_on_until_its_best_stay_the_same(spark):
    # One way of twelve steps, each nearer to the query than the one before.
    angles = [0.0] + [1.5 - 0.1 * k for k in range(12)]
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    nodes = spark.createDataFrame(rows, "node long, vector array<float>")
    codes = nodes.mapInArrow(N._encode(2), "node long, code binary, keys array<long>")
    graph = spark.createDataFrame([(i, i + 1, 0.0) for i in range(12)], "node long, other long, score double")
    found = N.greedy_search(graph, codes, spark.createDataFrame([(0,)], "node long"), 2)
    assert {r.node for r in found.collect()} == set(range(13))


def test_no_row_for_each_edge_or_comparison(spark, monkeypatch):
    stored = []
    materialize = N.materialize

    def counted(df, label, *args, **options):
        out = materialize(df, label, *args, **options)
        stored.append((label, out.count()))
        return out

    monkeypatch.setattr(N, "materialize", counted)
    rows = [(i, v, None) for i, v in enumerate(np.random.default_rng(8).normal(size=(700, 8)).astype(np.float32).tolist())]
    got = N.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert compare(got, brute(rows, lambda i: i % 50 == 0, 5)) == 1.0
    assert max(n for _, n in stored) <= 700, stored


def test_many_parts_and_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_PART", 16)
    monkeypatch.setattr(N, "GROUP_QUERIES", 8)
    rng = np.random.default_rng(9)
    matrix = np.concatenate([rng.normal(size=(700, 8)), rng.normal(size=8) + 0.001 * rng.normal(size=(200, 8))])
    assert recall(spark, matrix, 7) >= 0.98


def test_numbers_of_late_parts_are_whole():
    codes = np.random.default_rng(10).normal(size=(4096, 4)).astype("f4")
    asked = [np.array([[0], [2]], "i8"), np.array([5, 4095], "u2"), np.array([-2.0]), codes[:1]]
    messages = N._sent(iter([(40, N.CODES, 0, 4096, codes), (40, N.REACHED, 3, 2, *asked)]))
    (found,) = N._received(N._compare(4, "f4", 4096, "i4")(messages)).items()
    assert found[0] == (3, N.FOUND)
    assert N._numbers(found[1][0][2], "i4").tolist() == [40 * 4096 + 5, 40 * 4096 + 4095]
    unit = N._unit(codes)
    assert np.allclose(N._numbers(found[1][0][3], "f8"), unit[[5, 4095]] @ unit[0], atol=1e-15)
