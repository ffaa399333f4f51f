from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

from lexsnap.llm import warc as W

SCHEMA = "page_id long, url string, html string, record_type string"


def pages(spark):
    rows = [
        (1, "http://a/1", "<p>same</p>", "x"),
        (2, "http://a/2\r\nX: y", "<p>same</p>", "x"),
        (3, None, "<p>same</p>", "x"),
        (4, "http://a/4", None, "x"),
        (5, "http://a/5", "", "x"),
        (6, "http://a/ü", "é" * 200_000 + "\r\n\r\nWARC/1.1\r\n", "x"),
        (7, "http://a/7", "once", "x"),
        (7, "http://a/7", "once", "x"),
        (7, "http://a/7b", "once", "x"),
        (None, "http://a/n", "<p>same</p>", "x"),
        (None, "http://a/n", "only here", "x"),
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("min_bytes", [0, 1, 5])
def test_round_trip_equals_plain_python(spark, tmp_path, min_bytes):
    rows, docs = pages(spark)
    path = W.archive_pages(docs.repartition(3), f"file://{tmp_path}/w", min_bytes)
    got = sorted((tuple(r) for r in W.archived_pages(spark, path).collect()), key=str)
    first = {}
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        known = first.get(payload)
        first[payload] = page_id if known is None else max(known, page_id or known)
    want, used = [], set()
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        small = len(payload) < min_bytes
        response = small or (page_id == first[payload] and payload not in used)
        if page_id == first[payload] and not small:
            used.add(payload)
        want.append((page_id, len(payload), W.digest(payload), "response" if response else "revisit", None if response else first[payload]))
    assert got == sorted(want, key=str)


def test_payloads_come_back_byte_for_byte(spark, tmp_path):
    rows, docs = pages(spark)
    path = W.archive_pages(docs, f"file://{tmp_path}/w")
    read = W.read_warc(spark, path, verify="true").where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload) for r in read) == sorted({(h or "").encode() for _, _, h, _ in rows})
    assert all(dict(r.headers)["warc-type"] == "response" for r in read)


def _reader(path, *filters, **options):
    reader = W.WarcReader({"path": path, **options})
    assert list(reader.pushFilters(list(filters))) == []
    return [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]


def test_header_predicates_are_pushed_and_payloads_skipped(spark, tmp_path, monkeypatch):
    _, docs = pages(spark)
    path = W.archive_pages(docs, f"file://{tmp_path}/w")
    inflated = []
    body = W._Member.body
    monkeypatch.setattr(W._Member, "body", lambda self, n: inflated.append(1) or body(self, n))
    found = _reader(path, W.EqualTo(("record_type",), "revisit"))
    assert len(found) == len(inflated) == 6 and {r["record_type"] for r in found} == {"revisit"}
    inflated.clear()
    assert len(_reader(path, W.StringStartsWith(("target_uri",), "http://a/7"), W.IsNotNull(("date",)))) == len(inflated) == 3
    other = W.WarcReader({"path": path})
    length = W.EqualTo(("payload_bytes",), 4)
    assert list(other.pushFilters([length])) == [length]
    plan = W.read_warc(spark, path).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_archives_without_lengths_and_plain_ones(spark, tmp_path):
    row = {"record_type": "response", "record_id": "<urn:x:1>", "date": "d", "target_uri": "http://a", "refers_to": None, "payload": b"abc\r\n\r\ndef"}
    record = W.record_bytes(row)
    os.mkdir(tmp_path / "w")
    (tmp_path / "w/a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"urn:x:1", b"urn:x:2")))
    (tmp_path / "w/b.warc").write_bytes(record.replace(b"urn:x:1", b"urn:x:3") * 2)
    found = _reader(f"file://{tmp_path}/w")
    assert [(r["record_id"][7:8], r["payload"]) for r in found] == [(k, b"abc\r\n\r\ndef") for k in "1233"]
    assert [r["record_id"] for r in _reader(f"file://{tmp_path}/w", W.In(("record_id",), ("<urn:x:2>", "<urn:x:3>")))] == ["<urn:x:2>"] + ["<urn:x:3>"] * 2
    assert len(W.WarcReader({"path": f"file://{tmp_path}/w", "partitionBytes": "1"}).partitions()) == 2


def record_of(number, payload):
    row = {"record_type": "response", "record_id": f"<urn:x:{number}>", "date": "d", "target_uri": "http://a", "refers_to": None, "payload": payload}
    return W.record_bytes(row)


@pytest.mark.parametrize("sizes", [(3, 0, 5), (200_000, 1, 70_000), (1,)])
def test_members_of_several_records_and_nested_folders(tmp_path, sizes):
    payloads = [os.urandom(n) for n in sizes]
    records = [record_of(k, p) for k, p in enumerate(payloads)]
    os.makedirs(tmp_path / "w/2024/05")
    os.makedirs(tmp_path / "w/_pending")
    (tmp_path / "w/2024/05/a.warc.gz").write_bytes(gzip.compress(b"".join(records)) + gzip.compress(record_of(9, b"last")))
    (tmp_path / "w/_pending/b.warc.gz").write_bytes(gzip.compress(record_of(8, b"not yet")))
    path = f"file://{tmp_path}/w"
    want = [(f"<urn:x:{k}>", p) for k, p in enumerate(payloads)] + [("<urn:x:9>", b"last")]
    assert [(r["record_id"], r["payload"]) for r in _reader(path)] == want
    for wanted in want:  # the others are stepped over
        assert [(r["record_id"], r["payload"]) for r in _reader(path, W.EqualTo(("record_id",), wanted[0]))] == [wanted]


@pytest.mark.parametrize("packed", [False, True])
def test_archives_that_are_cut_off_raise(tmp_path, packed):
    record = record_of(1, b"payload" * 40)
    whole = (gzip.compress(record) + gzip.compress(record)) if packed else record * 2
    half = len(whole) // 2
    os.mkdir(tmp_path / "w")
    # In the second record: its first bytes, its header, its block.
    for cut in (half + 5, half + 30, half + (half * 3) // 4):
        (tmp_path / "w/a.warc").write_bytes(whole[:cut])
        with pytest.raises(ValueError, match="cut off"):
            _reader(f"file://{tmp_path}/w")
        with pytest.raises(ValueError, match="cut off"):
            _reader(f"file://{tmp_path}/w", W.EqualTo(("record_id",), "<urn:x:7>"))
    (tmp_path / "w/a.warc").write_bytes(whole)
    assert len(_reader(f"file://{tmp_path}/w")) == 2


def test_empty_table_and_empty_folder(spark, tmp_path):
    path = W.archive_pages(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    assert W.archived_pages(spark, path).count() == 0
    assert W.read_warc(spark, f"file://{tmp_path}/none").select(F.count("*")).first()[0] == 0
