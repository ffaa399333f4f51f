"""Landing the pages of a snapshot as a stream that can be stopped and started."""

from __future__ import annotations

import os

import pytest

from lexsnap.sources.listing import (
    land_pages,
    listing_rows,
    missing_pages,
    page_stream,
    read_listing_pages,
)

ROWS = [
    {
        "permalink": f"p-{n}",
        "perihal": "s",
        "tanggal_efektif": "01-02-2024",
        "status_dokumen": "Berlaku",
        "topik": None if n == 3 else [{"uuid": 2, "keterangan": "Topik 2"}],
    }
    for n in range(23)
]


def source_of(home, rows):
    """A source over ``rows`` that notes in the folder ``home`` which pages it reads."""

    def note(kind, value):
        with open(os.path.join(home, kind), "a") as file:
            file.write(f"{value}\n")

    def landed(limit):
        with open(os.path.join(home, "landed")) as file:
            return int(file.read())

    def read_page(page, limit):
        if os.path.exists(os.path.join(home, f"broken-{page}")):
            raise OSError(f"page {page} cannot be read")
        note("read", page)
        found = rows[(page - 1) * limit : page * limit]
        return {"data": {"search_data": found}, "pagination": {"total_page": -(-len(rows) // limit)}}

    return page_stream(read_page, landed, lambda page: note("committed", page))


@pytest.fixture
def pages(spark, tmp_path):
    source = source_of(str(tmp_path), ROWS)

    def run(landed, **options):
        (tmp_path / "landed").write_text(str(landed))
        settings = {"snapshot": "s1", "limit": "5"} | options
        query = land_pages(spark, str(tmp_path / "out"), str(tmp_path / "ck"), source=source, **settings)
        query.awaitTermination()
        return read_listing_pages(spark, str(tmp_path / "out"))

    return run


def noted(tmp_path, kind="read"):
    file = tmp_path / kind
    return sorted(map(int, file.read_text().split())) if file.exists() else []


def test_a_restart_reads_each_page_once(spark, pages, tmp_path):
    stored = pages(3, pages_per_task="2")
    assert noted(tmp_path) == [1, 2, 3]
    assert sorted(r["page"] for r in missing_pages(stored).collect()) == [4, 5]
    pages(3)  # nothing new
    assert noted(tmp_path) == [1, 2, 3]
    stored = pages(5)
    assert noted(tmp_path) == [1, 2, 3, 4, 5]
    assert missing_pages(stored).isEmpty()
    rows = sorted((r["permalink"], r["topik"] is None) for r in listing_rows(stored).collect())
    assert rows == sorted((f"p-{n}", n == 3) for n in range(23))
    assert max(noted(tmp_path, "committed")) >= 3


def test_a_failed_batch_is_read_again_and_stored_once(spark, pages, tmp_path):
    pages(2)
    (tmp_path / "broken-4").write_text("")
    with pytest.raises(Exception, match="cannot be read"):
        pages(5)
    (tmp_path / "broken-4").unlink()
    stored = pages(5)
    assert sorted(r["page"] for r in stored.select("page").collect()) == [1, 2, 3, 4, 5]
    assert noted(tmp_path)[:2] == [1, 2] and noted(tmp_path).count(1) == 1


def test_a_checkpoint_of_another_snapshot_is_refused(spark, pages):
    pages(2)
    with pytest.raises(Exception, match="checkpoint is of snapshot"):
        pages(3, snapshot="s2")
