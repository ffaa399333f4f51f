"""Tables rewritten by buckets, and the retry of failed generations."""

from __future__ import annotations

import datetime
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexsnap import session
from lexsnap.operators.qa import FAILED_QUESTION
from lexsnap.plans.snapshot_jobs import BUCKETED, read_tables, retry_failures, sync_snapshot
from lexsnap.schemas import DETAIL_RESPONSE, LISTING, VECTOR_DOCUMENT
from lexsnap.session import materialize
from lexsnap.sources.versions import (
    TASK_BYTES,
    Rewrite,
    bucket_of,
    bucket_paths,
    current_version,
    in_few_tasks,
    publish,
    read_keys,
    read_version,
    touched_buckets,
)

BUCKETS = 8
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
HOUR = datetime.timedelta(hours=1)


def item(key, status="A"):
    return (key, f"about {key}", "01-02-2024", status, [(2, "Topik 2")])


def responses(spark, keys):
    record = ("PMK", "1/2024", "<p>text</p>", [], [], None, ("kw",))
    return spark.createDataFrame([(k, [record]) for k in keys], DETAIL_RESPONSE)


def generator(*failing):
    """Two items per document; the named ones fail."""

    def generate(documents):
        pair = F.struct(F.col("permalink").alias("question"), F.lit("yes").alias("answer"))
        fails = F.col("permalink").isin(*failing) if failing else F.lit(False)
        return documents.select(
            "permalink",
            F.when(~fails, F.array(pair, pair)).alias("qa_list"),
            F.lit(3).cast("long").alias("attempts"),
            F.when(fails, F.lit("no answer")).alias("error"),
        )

    return generate


def embed(records):
    return records.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))


def sync(spark, root, name, items, failing=(), embedder=embed, **options):
    listing = spark.createDataFrame([item(*i) for i in items.items()], LISTING)
    return sync_snapshot(
        spark, root, name, listing, responses(spark, items), generator(*failing), embedder,
        audit=False, buckets=BUCKETS, **options,
    )


def stored(spark, root):
    tables = read_tables(spark, root)
    regs = {r["permalink"]: r["status_dokumen"] for r in tables["regulation"].collect()}
    vectors = sorted((r["id"], r["metadata"]["status_dokumen"]) for r in tables["vectors"].collect())
    qa = sorted((r["permalink"], r["id"]) for r in tables["qa"].collect())
    return regs, vectors, qa


def expected(items):
    pairs = [(k, i) for k in sorted(items) for i in (1, 2)]
    return dict(items), sorted((f"{k}#{i}", items[k]) for k, i in pairs), sorted(pairs)


def test_untouched_directories_are_reused(spark, tmp_path):
    root = str(tmp_path / "t")
    items = {f"d{k}": "A" for k in range(40)}
    first = sync(spark, root, "1", items)
    files = {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in tmp_path.rglob("part-*") if "/log/" not in str(p)}
    items["d7"] = "B"
    second = sync(spark, root, "2", items)
    bucket = touched_buckets(spark.createDataFrame([("d7",)], "permalink string"), "permalink", BUCKETS)
    for table in ("regulation", "qa", "vectors"):
        old, new = bucket_paths(first, table), bucket_paths(second, table)
        assert set(old) == set(new) == set(range(BUCKETS))
        assert [b for b in new if new[b] != old[b]] == bucket
    assert all((p.stat().st_mtime_ns, p.stat().st_size) == s for p, s in files.items())
    assert stored(spark, root) == expected(items)
    # The old version can still be read.
    before = read_version(spark, first, "vectors", VECTOR_DOCUMENT)
    assert {r["metadata"]["status_dokumen"] for r in before.collect()} == {"A"}
    # A snapshot without changes writes no bucket at all.
    third = sync(spark, root, "3", items)
    assert {t: third.buckets[t] for t in BUCKETED} == {t: second.buckets[t] for t in BUCKETED}


def test_a_failed_run_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    items = {f"d{k}": "A" for k in range(12)}
    first = sync(spark, root, "1", items)
    more = items | {"d3": "B", "new": "A"}

    def broken(records):
        return embed(records).withColumn("document", F.raise_error(F.lit("no embedding")))

    with pytest.raises(Exception, match="no embedding"):
        sync(spark, root, "2", more, embedder=broken)
    assert current_version(spark, root) == first
    assert stored(spark, root) == expected(items)
    sync(spark, root, "2", more)
    assert stored(spark, root) == expected(more)


def test_snapshots_in_turn_equal_the_last_one(spark, tmp_path):
    """Statuses that change, documents that come and go, buckets that run empty."""
    rng = random.Random(2)
    root = str(tmp_path / "t")
    for turn in range(4):
        keys = [f"d{k}" for k in range(30)] if turn != 2 else ["d1", "d2"]
        items = {k: rng.choice("ABC") for k in keys if rng.random() < 0.6 or turn == 2}
        version = sync(spark, root, str(turn), items)
        assert stored(spark, root) == expected(items)
        if turn == 2:
            assert len(bucket_paths(version, "regulation")) <= 2


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    root = str(tmp_path / "t")
    version = sync(spark, root, "1", {f"d{k}": "A" for k in range(40)})
    bucket = touched_buckets(spark.createDataFrame([("d5",)], "permalink string"), "permalink", BUCKETS)
    vectors = read_version(spark, version, "vectors", VECTOR_DOCUMENT, bucket)
    assert {f"bucket={b}" for b in bucket} == {f.split("/")[-2] for f in vectors.inputFiles()}
    assert vectors.filter("metadata.permalink = 'd5'").count() == 2
    assert read_version(spark, version, "vectors", VECTOR_DOCUMENT, []).isEmpty()


def test_keys_open_their_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    version = sync(spark, root, "1", {f"d{k}": "A" for k in range(200)})
    keys = spark.createDataFrame([("d5",), ("d6",), ("d6",), ("missing",), (None,)], "k string")
    found = read_keys(spark, version, "vectors", VECTOR_DOCUMENT, "metadata.permalink", keys)
    assert sorted(r["id"] for r in found.collect()) == ["d5#1", "d5#2", "d6#1", "d6#2"]
    opened = {f for f in found.inputFiles() if "/vectors/" in f}
    everything = read_version(spark, version, "vectors", VECTOR_DOCUMENT).inputFiles()
    assert 0 < len(opened) <= 3 < len(everything)
    # Rows lie sorted in each file, with a filter that tells keys that are not there.
    for path in (tmp_path / "t" / "vectors").rglob("part-*.parquet"):
        stored = spark.read.schema(VECTOR_DOCUMENT).parquet(str(path))
        order = [r[0] for r in stored.select("metadata.permalink").collect()]
        assert order == sorted(order)
        column = pq.ParquetFile(path).metadata.row_group(0).column(2)
        assert column.path_in_schema == "metadata.permalink"
        assert path.stat().st_size > column.total_compressed_size


def test_rows_outside_the_touched_buckets_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k}",) for k in range(50)] + [(None,)], "permalink string")
    wrong = {"t": Rewrite(rows, "permalink", [1])}
    with pytest.raises(ValueError, match="not rewritten"):
        publish(spark, str(tmp_path / "t"), {}, "1", rewrites=wrong, buckets=BUCKETS)
    buckets = {r[0]: r[1] for r in rows.select("permalink", bucket_of("permalink", BUCKETS)).collect()}
    assert buckets[None] == 0 and set(buckets.values()) == set(range(BUCKETS))


def ledger(spark, root):
    rows = read_tables(spark, root)["failures"]
    rows = rows.withColumn("next_try", F.unix_timestamp("next_try")).collect()
    return {r["permalink"]: (r["error"], r["attempts"], r["rounds"], r["next_try"]) for r in rows}


def at(time):
    return int(time.timestamp())


def vector_ids(spark, root):
    rows = read_tables(spark, root)["vectors"].collect()
    assert all(r["document"] != FAILED_QUESTION for r in rows)
    return sorted(r["id"] for r in rows)


def test_failed_documents_are_generated_again(spark, tmp_path):
    root = str(tmp_path / "t")
    items = {f"d{k}": "A" for k in range(6)}
    sync(spark, root, "1", items, failing=("d1", "d2", "d3"), now=START)
    assert ledger(spark, root) == {d: ("no answer", 3, 1, at(START + HOUR)) for d in ("d1", "d2", "d3")}
    assert vector_ids(spark, root) == [f"d{k}#{i}" for k in (0, 4, 5) for i in (1, 2)]

    # Not due yet: nothing is generated, no version is published.
    before = current_version(spark, root)
    assert retry_failures(spark, root, generator(), embed, now=START + HOUR / 2) == before

    after = retry_failures(spark, root, generator("d2", "d3"), embed, now=START + HOUR)
    assert after.number == before.number + 1 and after.snapshot_id == before.snapshot_id
    assert after.buckets["regulation"] == before.buckets["regulation"]
    assert ledger(spark, root) == {d: ("no answer", 6, 2, at(START + 3 * HOUR)) for d in ("d2", "d3")}
    assert vector_ids(spark, root) == [f"d{k}#{i}" for k in (0, 1, 4, 5) for i in (1, 2)]
    qa = sorted((r["permalink"], r["id"], r["question"]) for r in read_tables(spark, root)["qa"].collect())
    assert [q for q in qa if q[0] in ("d1", "d2")] == [("d1", 1, "d1"), ("d1", 2, "d1"), ("d2", 1, FAILED_QUESTION)]

    # A document that goes away leaves the ledger, too.
    sync(spark, root, "2", {k: s for k, s in items.items() if k != "d3"}, now=START + 2 * HOUR)
    assert set(ledger(spark, root)) == {"d2"}

    # After the last round a document is left alone, with its last error.
    late = START + 100 * HOUR
    stuck = current_version(spark, root)
    assert retry_failures(spark, root, generator(), embed, now=late, max_rounds=2) == stuck
    retry_failures(spark, root, generator(), embed, now=late)
    assert ledger(spark, root) == {}
    assert vector_ids(spark, root) == [f"d{k}#{i}" for k in (0, 1, 2, 4, 5) for i in (1, 2)]


def test_tables_stored_by_a_key_are_joined_in_place(spark):
    rows = spark.range(500).selectExpr("if(id % 50 = 0, null, 'd' || id) AS permalink", "id")
    left = materialize(rows, "left", by="permalink", codec="zstd")
    right = materialize(rows.filter("id % 2 = 0"), "right", by="permalink")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = left.join(right.withColumnRenamed("id", "other"), "permalink")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted(r["id"] for r in both.collect()) == [n for n in range(0, 500, 2) if n % 50]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left.count() == 500 and left.filter("permalink is null").count() == 10
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexsnap")]


def test_rows_are_dealt_in_place(spark, tmp_path):
    """Few partitions, each of which writes its rows of a bucket, and no row is lost."""
    keys = spark.range(0, 3000, 1, 6).selectExpr("if(id = 0, null, 'd' || id) AS permalink")
    rows = in_few_tasks(keys, 3 * TASK_BYTES, 1 << 20)
    assert rows.rdd.getNumPartitions() == 3
    every = {"t": Rewrite(rows, "permalink", range(BUCKETS), in_place=True)}
    version = publish(spark, str(tmp_path / "t"), {}, "1", rewrites=every, buckets=BUCKETS)
    stored = read_version(spark, version, "t", rows.schema)
    assert sorted(map(str, (r[0] for r in stored.collect()))) == sorted(map(str, (r[0] for r in keys.collect())))
    for folder in bucket_paths(version, "t").values():
        files = sorted((tmp_path / folder).glob("part-*.parquet"))
        assert 1 <= len(files) <= 3
        assert pq.ParquetFile(files[0]).metadata.row_group(0).column(0).compression == "ZSTD"


@pytest.mark.parametrize("limit", [1 << 20, 2])
def test_many_changes_and_few_give_the_same_tables(spark, tmp_path, monkeypatch, limit):
    """Keys sent to all executors or not; details are looked up for inserted rows only."""
    monkeypatch.setattr(session.few, "__defaults__", (limit,))
    root, asked = str(tmp_path / "t"), []

    def look_up(wanted):
        asked.append(sorted(r[0] for r in wanted.collect()))
        return responses(spark, asked[-1])

    first = {f"d{k}": "A" for k in range(30)}
    second = {f"d{k}": "B" if k % 3 == 0 else "A" for k in range(5, 40)}
    for name, items, failing in (("1", first, ("d1", "d6", "d7")), ("2", second, ("d35",))):
        listing = spark.createDataFrame([item(*i) for i in items.items()], LISTING)
        sync_snapshot(
            spark, root, name, listing, look_up, generator(*failing), embed, buckets=BUCKETS, now=START
        )
    assert asked == [sorted(first), sorted(set(second) - set(first))]
    regs, vectors, qa = stored(spark, root)
    failed = {"d6", "d7", "d35"}
    assert regs == second
    assert vectors == sorted((f"{k}#{i}", second[k]) for k in second if k not in failed for i in (1, 2))
    assert set(ledger(spark, root)) == failed
    retry_failures(spark, root, generator("d7"), embed, now=START + HOUR)
    regs, vectors, qa = stored(spark, root)
    assert vectors == sorted((f"{k}#{i}", second[k]) for k in second if k != "d7" for i in (1, 2))
    assert qa == sorted([(k, i) for k in second if k != "d7" for i in (1, 2)] + [("d7", 1)])
    assert set(ledger(spark, root)) == {"d7"}
    read = {n: spark.read.json(f"{root}/audit/2/{n}.json").count() for n in ("_new", "_update", "_delete")}
    assert read == {"_new": 10, "_update": sum(k % 3 == 0 for k in range(5, 30)), "_delete": 5}
