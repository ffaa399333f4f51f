"""Snapshot diff and merge, the sync job and its stream."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lexsnap.operators import changes as C

from lexsnap.plans.snapshot_jobs import read_tables, sync_snapshot
from lexsnap.schemas import DETAIL_COLUMNS, DETAIL_RESPONSE, LISTING, REGULATION
from lexsnap.sources.tables import read_json, write_json
from lexsnap.sources.versions import current_version
from lexsnap.streaming.snapshot_sync import announce, sync_stream

DAY = datetime.date(2024, 1, 1)
FLAT = "permalink string, perihal string, tanggal_efektif date, status_dokumen string, topik string"

OLD = [
    ("same", "s", DAY, "A", "2"),
    ("status", "s", DAY, "A", "2"),
    ("null-to-value", "s", DAY, None, "2"),
    ("value-to-null", "s", DAY, "A", "2"),
    ("null-and-more", "s", DAY, None, "2"),
    ("both-null", "s", DAY, None, "2"),
    ("gone", "s", DAY, "A", "2"),
]
NEW = [
    ("same", "s", DAY, "A", "2"),
    ("status", "s", DAY, "B", "2"),
    ("null-to-value", "s", DAY, "A", "2"),
    ("value-to-null", "s", DAY, None, "2"),
    ("null-and-more", "t", DAY, "A", "2"),
    ("both-null", "s", DAY, None, "2"),
    ("fresh", "s", DAY, "A", "3"),
]


def stored(spark, rows):
    return spark.createDataFrame(
        [(*row, *(f"{row[0]}-{c}" for c in DETAIL_COLUMNS)) for row in rows], REGULATION
    )


def ops(df):
    return {r["permalink"]: r["op"] for r in df.collect()}


def test_diff_is_three_valued(spark):
    old, new = stored(spark, OLD), spark.createDataFrame(NEW, FLAT)
    assert ops(C.snapshot_diff(old, new)) == {
        "status": "update",
        "null-and-more": "update",
        "gone": "delete",
        "fresh": "insert",
    }
    assert ops(C.snapshot_diff(old, new, null_safe=True)) == {
        "status": "update",
        "null-and-more": "update",
        "null-to-value": "update",
        "value-to-null": "update",
        "gone": "delete",
        "fresh": "insert",
    }


def test_diff_shows_new_values_and_old_ones_for_deletes(spark):
    old, new = stored(spark, OLD), spark.createDataFrame(NEW, FLAT)
    rows = {r["permalink"]: tuple(r)[1:] for r in C.compare_snapshots(old, new).collect()}
    assert rows["status"] == NEW[1] and rows["value-to-null"] == NEW[3]
    assert rows["gone"] == OLD[6]


def test_diff_with_itself_is_empty(spark):
    old = stored(spark, OLD)
    assert C.snapshot_diff(old, old.select(*old.columns[:5])).isEmpty()


def test_summary_counts_zeros(spark):
    old = stored(spark, OLD)
    got = {r["op"]: r["n"] for r in C.change_summary(C.compare_snapshots(old, old)).collect()}
    assert got == {"insert": 0, "update": 0, "delete": 0, "same": 7}


def naive_merge(old, fresh, update, gone):
    """Concatenate, keep the last copy per key, drop deleted keys."""
    kept = {}
    for row in [*old, *fresh, *update]:
        kept[row[0]] = row
    return sorted((r for k, r in kept.items() if k not in gone), key=str)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_merge_equals_concat_keep_last(spark, partitions):
    old = stored(spark, OLD).repartition(partitions)
    new = spark.createDataFrame(NEW, FLAT).repartition(partitions)
    changes = C.snapshot_diff(old, new)
    fresh = stored(spark, [NEW[6]])
    merged = C.snapshot_merge(old, changes, fresh)
    assert merged.columns == REGULATION.names
    expected = naive_merge(
        map(tuple, old.collect()),
        map(tuple, fresh.collect()),
        map(tuple, C.updated(changes, old).collect()),
        {r[0] for r in C.deleted(changes).collect()},
    )
    assert sorted(map(tuple, merged.collect()), key=str) == expected
    assert {r["permalink"] for r in merged.collect()} == {r[0] for r in NEW}


def test_merge_with_refreshed_updates(spark):
    old, new = stored(spark, OLD), spark.createDataFrame(NEW, FLAT)
    changes = C.snapshot_diff(old, new)
    renewed = changes.filter("op in ('insert', 'update')").drop("op").withColumns(
        {c: F.lit("renewed") for c in DETAIL_COLUMNS}
    )
    merged = C.snapshot_merge(old, changes, renewed, refresh_updates=True)
    bodies = {r["permalink"]: r["body_final"] for r in merged.collect()}
    assert set(bodies) == {r[0] for r in NEW}
    assert bodies["status"] == bodies["fresh"] == "renewed"
    assert bodies["same"] == "same-body_final"


def test_wide_columns_stay_out_of_the_diff_shuffle(spark, tmp_path):
    stored(spark, OLD).write.parquet(str(tmp_path / "old"))
    spark.createDataFrame(NEW, FLAT).write.parquet(str(tmp_path / "new"))
    old, new = (spark.read.parquet(str(tmp_path / n)) for n in ("old", "new"))
    changes = C.snapshot_diff(old, new)
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "body_final" not in plan and "CartesianProduct" not in plan
    # The merge shuffles neither side while the change set is small.
    changes.write.parquet(str(tmp_path / "changes"))
    small = spark.read.parquet(str(tmp_path / "changes"))
    merged = C.snapshot_merge(old, small, stored(spark, [NEW[6]]))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_inserted_rows_are_padded(spark):
    old, new = stored(spark, OLD), spark.createDataFrame(NEW, FLAT)
    rows = C.inserted(C.snapshot_diff(old, new)).collect()
    assert [tuple(r) for r in rows] == [(*NEW[6], *[""] * 7)]


def test_require_keys(spark):
    C.require_keys(stored(spark, OLD))
    with pytest.raises(ValueError, match="not unique"):
        C.require_keys(stored(spark, [OLD[0], OLD[0]]))
    with pytest.raises(ValueError, match="null"):
        C.require_keys(stored(spark, [(None, *OLD[0][1:])]), unique=False)


# ---- the job ------------------------------------------------------------------


def item(key, status="A", code=2):
    return (key, f"about {key}", "01-02-2024", status, [(code, f"Topik {code}")])


def responses(spark, keys):
    record = ("PMK", "1/2024", "<p>text</p>", [], [], None, ("kw",))
    return spark.createDataFrame([(k, [record]) for k in keys], DETAIL_RESPONSE)


def generate(documents):
    pair = F.struct(F.col("body_final").alias("question"), F.lit("yes").alias("answer"))
    return documents.select("permalink", F.array(pair, pair).alias("qa_list"))


def embed(records):
    return records.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"))


def state(spark, root):
    tables = read_tables(spark, root)
    regs = {r["permalink"]: r["status_dokumen"] for r in tables["regulation"].collect()}
    vectors = {r["id"]: r["metadata"]["status_dokumen"] for r in tables["vectors"].collect()}
    qa = sorted((r["permalink"], r["id"]) for r in tables["qa"].collect())
    return regs, vectors, qa


def run(spark, root, name, items, **options):
    listing = spark.createDataFrame(items, LISTING)
    keys = [i[0] for i in items]
    return sync_snapshot(
        spark, root, name, listing, responses(spark, keys), generate, embed, **options
    )


FIRST = [item("a"), item("b"), item("c"), item("d", code=4)]
SECOND = [item("a"), item("b", status="B"), item("e"), item("d", code=4)]


def test_sync_job(spark, tmp_path):
    root = str(tmp_path / "tables")
    run(spark, root, "2024-01-01", FIRST)
    regs, vectors, qa = state(spark, root)
    assert regs == {"a": "A", "b": "A", "c": "A"}
    assert set(vectors) == {f"{k}#{i}" for k in "abc" for i in (1, 2)}
    topics = [tuple(r) for r in read_tables(spark, root)["topic"].collect()]
    assert topics == [(2, "Topik 2")]

    run(spark, root, "2024-01-02", SECOND)
    regs, vectors, qa = state(spark, root)
    assert regs == {"a": "A", "b": "B", "e": "A"}
    assert vectors == {
        "a#1": "A", "a#2": "A", "b#1": "B", "b#2": "B", "e#1": "A", "e#2": "A",
    }
    assert qa == [(k, i) for k in "abe" for i in (1, 2)]

    counts = {r["op"]: r["n"] for r in read_tables(spark, root)["change_counts"].collect()}
    assert counts == {"insert": 1, "update": 1, "delete": 1}
    audit = {
        name: [r["permalink"] for r in spark.read.json(f"{root}/audit/2024-01-02/{name}.json").collect()]
        for name in ("_new", "_update", "_delete")
    }
    assert audit == {"_new": ["e"], "_update": ["b"], "_delete": ["c"]}

    # The same snapshot again, and an older one, change nothing.
    version = current_version(spark, root)
    run(spark, root, "2024-01-02", SECOND)
    run(spark, root, "2024-01-01", FIRST)
    assert current_version(spark, root) == version


def test_sync_refuses_a_partial_snapshot(spark, tmp_path):
    root = str(tmp_path / "tables")
    run(spark, root, "1", FIRST)
    with pytest.raises(ValueError, match="lacks pages"):
        run(spark, root, "2", SECOND, missing=spark.range(1))
    run(spark, root, "2", SECOND, missing=spark.range(0))
    assert current_version(spark, root).number == 2


def test_sync_refuses_two_details_of_a_document(spark, tmp_path):
    listing = spark.createDataFrame(FIRST, LISTING)
    twice = responses(spark, ["a", "a", "b", "c"])
    with pytest.raises(ValueError, match="not unique"):
        sync_snapshot(spark, str(tmp_path / "t"), "1", listing, twice, generate, embed)


def test_sync_with_refreshed_updates(spark, tmp_path):
    root = str(tmp_path / "tables")
    run(spark, root, "1", FIRST)
    run(spark, root, "2", SECOND, refresh_updates=True)
    regs, vectors, qa = state(spark, root)
    assert regs == {"a": "A", "b": "B", "e": "A"}
    assert vectors["b#1"] == "B" and len(vectors) == 6
    assert qa == [(k, i) for k in "abe" for i in (1, 2)]


def test_stream_runs_each_announced_snapshot_once(spark, tmp_path):
    root, folder = str(tmp_path / "tables"), str(tmp_path / "announced")
    synced = []

    def sync(snapshot_id, path):
        synced.append(snapshot_id)
        listing = read_json(spark, path, LISTING)
        keys = [r[0] for r in listing.select("permalink").collect()]
        sync_snapshot(
            spark, root, snapshot_id, listing, responses(spark, keys), generate, embed
        )

    def stream():
        query = sync_stream(spark, folder, str(tmp_path / "checkpoint"), sync)
        query.awaitTermination()

    for name, items in (("1", FIRST), ("2", SECOND)):
        path = str(tmp_path / "landed" / name)
        write_json(spark.createDataFrame(items, LISTING), path)
        announce(spark, folder, name, path)
        stream()
        stream()
    assert synced == ["1", "2"]
    assert state(spark, root)[0] == {"a": "A", "b": "B", "e": "A"}


