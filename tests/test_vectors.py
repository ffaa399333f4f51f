"""The vector table and nearest-neighbour search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsnap.operators import nearest as N
from lexsnap.operators import vectors as V
from lexsnap.schemas import VECTOR_DOCUMENT

REGULATIONS = (
    "permalink string, status_dokumen string, topik string, jenis_peraturan string, "
    "nomor_peraturan string"
)


def record(key, n, status="A"):
    meta = (f"answer {n}", key, status, "2", "PMK", "1")
    return (f"{key}#{n}", meta, f"question {n}", [1.0, float(n)])


def table(spark, records):
    return spark.createDataFrame(records, VECTOR_DOCUMENT)


def ids(df):
    return sorted(r["id"] for r in df.collect())


STORED = [record("a", 1), record("a", 2), record("b", 1), record("c", 1), record(None, 9)]


def test_documents_join_and_null_ids(spark):
    qa = spark.createDataFrame(
        [(1, "a", "q", "x"), (None, "a", "q2", None), (1, "missing", "q", "x")],
        "id long, permalink string, question string, answer string",
    )
    regs = spark.createDataFrame([("a", "A", "2", None, "1")], REGULATIONS)
    rows = V.vector_documents(qa, regs).orderBy("document").collect()
    assert [r["id"] for r in rows] == ["a#1", None]
    assert rows[0]["metadata"].asDict() == {
        "answer": "x", "permalink": "a", "status_dokumen": "A", "topik": "2",
        "jenis_peraturan": None, "nomor_peraturan": "1",
    }


def test_lookup_by_metadata(spark, tmp_path):
    table(spark, STORED).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    assert ids(V.get_where(stored, "a")) == ["a#1", "a#2"]
    plan = V.get_where(stored, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(metadata.permalink), EqualTo(metadata.permalink,a)]" in plan
    keys = spark.createDataFrame([("b",), ("b",), ("zz",)], "permalink string")
    assert ids(V.get_where_in(stored, keys)) == ["b#1"]
    assert ids(V.delete_where_in(stored, keys)) == ["None#9", "a#1", "a#2", "c#1"]


def test_upsert(spark):
    new = [record("a", 2, "new"), record("d", 1)]
    got = V.upsert(table(spark, STORED), table(spark, new))
    assert ids(got) == ["None#9", "a#1", "a#2", "b#1", "c#1", "d#1"]
    status = {r["id"]: r["metadata"]["status_dokumen"] for r in got.collect()}
    assert status["a#2"] == "new" and status["a#1"] == "A"


def test_metadata_update_leaves_text_and_vectors(spark):
    changed = spark.createDataFrame([("a", None, "3", "UU", "7")], REGULATIONS)
    got = {r["id"]: r for r in V.update_metadata(table(spark, STORED), changed).collect()}
    assert tuple(got["a#2"]["metadata"]) == ("answer 2", "a", None, "3", "UU", "7")
    assert got["a#2"]["document"] == "question 2" and got["a#2"]["embedding"] == [1.0, 2.0]
    assert tuple(got["b#1"]) == (STORED[2][0], STORED[2][1], STORED[2][2], STORED[2][3])


def test_one_pass_equals_three_steps(spark):
    stored = table(spark, STORED)
    new = table(spark, [record("a", 2, "new"), record("d", 1)])
    changed = spark.createDataFrame([("a", "B", "3", "UU", "7")], REGULATIONS)
    gone = spark.createDataFrame([("c",)], "permalink string")
    steps = V.delete_where_in(V.update_metadata(V.upsert(stored, new), changed), gone)
    once = V.apply_changes(stored, new, changed, gone)
    assert sorted(map(str, once.collect())) == sorted(map(str, steps.collect()))
    assert once.count() == 5


# ---- search -------------------------------------------------------------------


def points(spark, rng, rows, dim, copies=0, partitions=4):
    """Random vectors with ids; the first ``copies`` of them are all the same."""
    matrix = rng.integers(-4, 5, size=(rows, dim)).astype(np.float32)
    matrix[:copies] = matrix[0]
    data = [(i, row.tolist()) for i, row in enumerate(matrix)]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    return df.repartition(partitions), matrix


def brute_force(docs, queries, k):
    found = []
    for q, query in enumerate(queries):
        distance = ((docs.astype(float) - query.astype(float)) ** 2).sum(axis=1)
        order = sorted(range(len(docs)), key=lambda i: (distance[i], i))[:k]
        found += [(q, rank, i, distance[i]) for rank, i in enumerate(order, 1)]
    return found


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("max_sent", [4096, 3])
def test_nearest_is_exact_with_ties(spark, monkeypatch, partitions, max_sent):
    monkeypatch.setattr(N, "TASKS_PER_GROUP", 4)
    rng = np.random.default_rng(partitions)
    # Small whole numbers give many ties, and a third of the rows are one copy.
    docs, doc_matrix = points(spark, rng, 600, 5, copies=200, partitions=partitions)
    queries, query_matrix = points(spark, rng, 9, 5)
    query_matrix[:2] = doc_matrix[:2]
    queries = spark.createDataFrame(
        [(i, row.tolist()) for i, row in enumerate(query_matrix)],
        "query_id long, embedding array<float>",
    )
    got = N.nearest(docs, queries, 7, max_sent_queries=max_sent)
    assert rows_of(got) == brute_force(doc_matrix, query_matrix, 7)


def test_top_k_is_part_of_top_k_plus_one(spark):
    rng = np.random.default_rng(3)
    docs, _ = points(spark, rng, 200, 8)
    queries = docs.limit(5).withColumnRenamed("id", "query_id")
    four, five = (set(rows_of(N.nearest(docs, queries, k))) for k in (4, 5))
    assert four < five


def test_nearest_edges(spark):
    docs = spark.createDataFrame(
        [("x", [1.0, 0.0]), ("y", None), ("z", [0.0, 0.0])], "id string, embedding array<float>"
    )
    queries = spark.createDataFrame(
        [(1, [0.0, 0.0]), (2, None)], "query_id long, embedding array<float>"
    )
    got = rows_of(N.nearest(docs, queries, 5))
    assert got == [(1, 1, "z", 0.0), (1, 2, "x", 1.0)]
    assert N.nearest(docs, queries.limit(0), 5).isEmpty()
    assert N.nearest(docs.limit(0), queries, 5).isEmpty()


@pytest.mark.parametrize("max_sent", [4096, 1])
def test_vectors_that_are_not_finite_are_passed_over(spark, max_sent):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i), 0.0]) for i in range(20)]
    bad = [(20, [nan, 0.0]), (21, [inf, 0.0]), (22, [None, 0.0]), (23, None)]
    docs = spark.createDataFrame(rows + bad, "id long, embedding array<float>").coalesce(1)
    asked = [(1, [0.0, 0.0]), (2, [nan, 0.0]), (3, [19.0, 0.0])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    got = rows_of(N.nearest(docs, queries, 3, max_sent_queries=max_sent))
    assert [(q, i) for q, _, i, _ in got] == [(1, 0), (1, 1), (1, 2), (3, 19), (3, 18), (3, 17)]
    assert sorted(r["id"] for r in N.incomparable(docs).collect()) == [20, 21, 22, 23]


def test_search_plan_neither_pairs_nor_shuffles_records(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = docs.limit(3).select(F.col("vec_id").alias("query_id"), "embedding")
    plan = N.nearest(docs, queries, 3, id_col="vec_id")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "NestedLoopJoin" not in text and "Cartesian" not in text
    assert text.count("WindowGroupLimit") == 4
    assert text.count("Exchange") == 2


def test_lsh_finds_itself_and_measures_recall(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    )
    queries = docs.filter("id < 20").withColumnRenamed("id", "query_id")
    index = N.build_lsh_index(docs, str(tmp_path / "index"), 64, bits=3)
    assert index.count() == 4 * docs.count()
    found = N.nearest_lsh(index, queries, 5, 64, bits=3)
    rows = found.collect()
    firsts = {r["query_id"]: r for r in rows if r["rank"] == 1}
    assert len(firsts) == 20 and all(q == r["id"] for q, r in firsts.items())
    assert len({(r["query_id"], r["id"]) for r in rows}) == len(rows)
    exact = N.nearest(docs, queries, 5)
    shares = [r["recall"] for r in N.recall(exact, found, "query_id", "id").collect()]
    assert len(shares) == 20 and 0.2 <= min(shares) and sum(shares) / 20 > 0.5
    # One bit per table and many tables: every record shares a code, so all is exact.
    wide = N.build_lsh_index(docs, str(tmp_path / "wide"), 64, tables=24, bits=1)
    all_found = N.nearest_lsh(wide, queries, 5, 64, tables=24, bits=1)
    assert [r[:3] for r in rows_of(all_found)] == [r[:3] for r in rows_of(exact)]


def test_lsh_reads_only_wanted_codes_in_blocks_too(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding"
    )
    queries = docs.filter("id < 3").withColumnRenamed("id", "query_id")
    index = N.build_lsh_index(docs, str(tmp_path / "index"), 64, bits=4)
    found = N.nearest_lsh(index, queries, 5, 64, bits=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in plan
    assert "Join" not in plan
    many = N.nearest_lsh(index, queries, 5, 64, bits=4, max_sent_queries=2)
    assert rows_of(many) == rows_of(found)
