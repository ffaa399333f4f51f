"""Listing ingest, numbering, regulations and topics."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexsnap.operators import listing as L
from lexsnap.operators import numbering as N
from lexsnap.operators import regulations as R
from lexsnap.schemas import DETAIL_RESPONSE, LISTING, REGULATION


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def listing_df(spark, rows):
    return spark.createDataFrame(rows, LISTING)


ITEM = ("p1", "s", "31-01-2024", "Berlaku", [(2, "b"), (10, "a")])


def test_ingest_flattens_filters_and_dedupes(spark):
    rows = [
        ITEM,
        ITEM,
        ("p2", "s", "01-02-2024", None, [(12, "x")]),
        ("p3", "s", None, "Berlaku", [(4, "x"), (None, "y")]),
        ("p4", "s", "01-02-2024", "Berlaku", []),
        ("p5", "s", "01-02-2024", "Berlaku", None),
    ]
    got = rows_of(L.ingest_listing(listing_df(spark, rows)))
    assert got == [
        ("p1", "s", datetime.date(2024, 1, 31), "Berlaku", "10 2"),
        ("p2", "s", datetime.date(2024, 2, 1), None, "12"),
    ]
    exact = L.with_any_code(L.ingest_listing(listing_df(spark, rows)), ["2", "3"])
    assert [r["permalink"] for r in exact.collect()] == ["p1"]


def test_ingest_bad_date_is_an_error(spark):
    bad = ("p1", "s", "2024-01-31", "Berlaku", [(2, "b")])
    with pytest.raises(Exception, match="CANNOT_PARSE"):
        L.ingest_listing(listing_df(spark, [bad])).collect()


def test_ingest_latest_copy_decides_about_the_topic(spark):
    older = ("p1", "s", "31-01-2024", "A", [(2, "b")])
    newer = ("p1", "t", "01-02-2024", "B", [(4, "b")])
    rows = listing_df(spark, [older, newer]).withColumn("seen", F.length("perihal"))
    rows = rows.withColumn("seen", F.when(F.col("perihal") == "t", 2).otherwise(1))
    assert L.ingest_listing(rows, latest_by="seen").isEmpty()


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_dedupe_does_not_depend_on_partitions(spark, partitions):
    df = spark.range(600).select(
        (F.col("id") % 50).cast("string").alias("permalink"),
        (F.col("id") * 7919 % 600).alias("version"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("x"),
    )
    df = df.union(df).repartition(partitions)
    expected_any, expected_latest = {}, {}
    for row in df.collect():
        key, rest = row[0], (row["version"], row["x"])
        expected_any[key] = min(expected_any.get(key, rest), rest)
        expected_latest[key] = max(expected_latest.get(key, rest), rest)
    got_any = {r[0]: (r[1], r[2]) for r in L.dedupe(df).collect()}
    got_latest = {r[0]: (r[1], r[2]) for r in L.dedupe(df, latest_by="version").collect()}
    assert got_any == expected_any
    assert got_latest == expected_latest


def test_listing_pages_cover_the_table(spark, monkeypatch):
    df = spark.range(95).select(
        F.concat(F.lit("p"), F.col("id")).alias("permalink"),
        F.expr("date_add(DATE'2024-01-01', CAST(id % 7 AS INT))").alias("tanggal_efektif"),
    )
    expected = [
        r["permalink"]
        for r in sorted(
            sorted(df.collect(), key=lambda r: r["permalink"]),
            key=lambda r: r["tanggal_efektif"],
            reverse=True,
        )
    ]
    for shallow in (100_000, 0):
        monkeypatch.setattr(L, "_SHALLOW_ROWS", shallow)
        pages = [
            [r["permalink"] for r in L.listing_page(df, page, 30).collect()]
            for page in (1, 2, 4, 5)
        ]
        assert pages == [expected[:30], expected[30:60], expected[90:], []]


@pytest.mark.parametrize("partitions,width", [(1, 1000), (4, 10), (17, 1), (4, None)])
def test_running_count(spark, partitions, width):
    random.seed(partitions)
    # One key holds a third of the rows; some keys are null.
    keys = [random.choice(["hot", "hot", "a", "b", None, f"k{i % 9}"]) for i in range(900)]
    rows = [(i, key) for i, key in enumerate(keys)]
    seen, expected = {}, []
    for i, key in rows:
        seen[key] = seen.get(key, 0) + 1
        expected.append((i, key, seen[key] if key is not None else 0))
    df = spark.createDataFrame(rows, "n long, k string").repartition(partitions)
    got = N.running_count(df, "k", "n", out="c", rows_per_slice=width)
    assert sorted(map(tuple, got.collect())) == expected


def test_running_count_slices_a_hot_key(spark):
    df = spark.range(100).select(F.lit("hot").alias("k"), F.col("id").alias("n"))
    plan = N.running_count(df, "k", "n", rows_per_slice=10)._jdf.queryExecution()
    lines = plan.optimizedPlan().toString().split("\n")
    windows = [w for w in lines if "Window [" in w and "AS _within" in w]
    assert windows and all("_slice" in w for w in windows)


def test_running_count_of_a_hot_key_with_a_sparse_order(spark):
    rows = [("hot", i * (1 << 21)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, n long")
    got = N.running_count(df, "k", "n", out="c")
    assert sorted((r["n"], r["c"]) for r in got.collect()) == [(n, i) for i, (_, n) in enumerate(rows, 1)]
    slices = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in slices and "div" not in slices


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_row_index_and_batches(spark, partitions):
    df = spark.range(1000).select(F.concat(F.lit("id-"), F.col("id")).alias("id"))
    df = df.repartition(partitions)
    order = sorted(r["id"] for r in df.collect())
    got = {r["id"]: r["row_index"] for r in N.row_index(df, [F.asc("id")]).collect()}
    assert got == {key: i for i, key in enumerate(order, 1)}
    batches = {r["id"]: r["batch"] for r in N.batch_number(df, [F.asc("id")], 30).collect()}
    assert batches == {key: i // 30 for i, key in enumerate(order)}


def detail(**fields):
    names = ("jenis_peraturan", "nomor_peraturan", "body_final", "peraturan_terbaru",
             "peraturan_sebelumnya", "peraturan_relevan", "meta")
    return tuple(fields.get(n) for n in names)


def test_clean_regulations(spark):
    flat = spark.createDataFrame(
        [(p, "s", datetime.date(2024, 1, 1), "Berlaku", "2") for p in ("p1", "p2", "p3")],
        "permalink string, perihal string, tanggal_efektif date, status_dokumen string, topik string",
    )
    first = detail(
        jenis_peraturan="PMK",
        nomor_peraturan="1/2024",
        body_final='<p class="x">\r\n\ta</p>',
        peraturan_terbaru=[("b",), ("a",), (None,)],
        peraturan_sebelumnya=[],
        meta=("tax",),
    )
    other = detail(jenis_peraturan="XX")
    responses = spark.createDataFrame([("p1", [first, other]), ("p2", [])], DETAIL_RESPONSE)
    enriched = R.with_detail(flat, responses)
    expected_first = ("PMK", "1/2024", "<p class='x'>a</p>", "a b", "", None, "tax")
    for default_empty in (False, True):
        table = R.clean_regulations(enriched, default_empty)
        assert table.columns == REGULATION.names
        got = {r[0]: tuple(r)[5:] for r in table.collect()}
        assert got == {"p1": expected_first, "p2": (None,) * 7, "p3": (None,) * 7}


def test_topic_dimension_is_sorted_and_distinct(spark):
    rows = [ITEM, ITEM, ("p2", "s", None, None, [(2, "b"), (2, "other")]), ("p3", None, None, None, [])]
    got = [tuple(r) for r in R.topic_dimension(listing_df(spark, rows)).collect()]
    assert got[0] == (None, None) and got[-1] == (10, "a")
    assert sorted(got[1:3]) == [(2, "b"), (2, "other")] and len(got) == 4
