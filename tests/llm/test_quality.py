from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexsnap.llm import quality as Q

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, stats string"


def test_held_out_accuracy_and_ranking(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = Q.score_quality(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert np.mean(good[:, None] > bad[None, :]) + np.mean(good[:, None] == bad[None, :]) / 2 > 0.99


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) AS quality")
    one, other = (sorted(map(tuple, Q.score_quality(docs, x).collect())) for x in (labels, turned))
    assert one == other


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 9)), min_size=1, max_size=9))
@settings(deadline=None)
def test_isotonic_is_the_min_max_formula(pairs):
    n = np.array([float(max(a, b)) for a, b in pairs])
    ones = np.array([float(min(a, b)) for a, b in pairs])
    got = Q.isotonic(ones, n)
    mean = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()
    size = range(len(n))
    want = [max(min(mean(a, b) for b in size if b >= i) for a in size if a <= i) for i in size]
    assert np.allclose(got, want)


def test_partition_sums_equal_one_fit():
    rng = np.random.default_rng(0)
    stats = rng.normal(size=(50, Q.STATISTICS))
    features = Q.Fourier(stats.mean(0), stats.std(0))
    whole = features(stats)
    parts = [features(p).T @ features(p) for p in np.array_split(stats, 7)]
    assert np.allclose(sum(parts), whole.T @ whole)
    near, far = stats[0], stats[0] + 0.01
    kernel = np.exp(-((near - far) / stats.std(0) @ ((near - far) / stats.std(0))) / (2 * Q.WIDTH**2))
    assert abs(features(near[None])[0, :-1] @ features(far[None])[0, :-1] - kernel) < 0.15


def test_edges(spark):
    rows = [(1, None, "x"), (7, "", "x"), (8, "w " * 200_000, "x"), (8, "w " * 10, None), (None, "text", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score_quality(docs, none).collect()} == {0.5}
    assert Q.accepted(docs, none).count() == len(rows)
    one = spark.createDataFrame([(7, 0), (8, 0), (None, 1), (1, None)], "doc_id long, quality int")
    assert {r.score for r in Q.score_quality(docs, one).collect()} == {0.0}
    two = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    scored = Q.score_quality(docs, two).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert Q.score_quality(docs.limit(0), two).count() == 0
