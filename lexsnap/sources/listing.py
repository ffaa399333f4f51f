"""The paged listing: landed page envelopes, and a live paged data source."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)
from pyspark.sql.streaming import StreamingQuery

from lexsnap.schemas import LISTING, LISTING_PAGE

_BLOCK = 4096


def read_listing_pages(
    spark: SparkSession, path: str, one_page_per_file: bool = False
) -> DataFrame:
    """Landed page envelopes.

    The default is one envelope per line (splittable); with
    ``one_page_per_file`` a file holds a single, possibly indented, envelope.
    """
    return (
        spark.read.schema(LISTING_PAGE)
        .option("multiLine", one_page_per_file)
        .option("mode", "FAILFAST")
        .json(path)
    )


def listing_rows(pages: DataFrame) -> DataFrame:
    """All rows of all pages, as one listing."""
    return pages.select(F.inline("data.search_data"))


def missing_pages(pages: DataFrame) -> DataFrame:
    """Page numbers 1 to ``total_page`` that were never read.

    Numbers are generated in blocks so that no single row holds them all.
    """
    total = pages.agg(F.max("pagination.total_page").alias("total")).filter("total > 0")
    blocks = total.select(
        "total", F.explode(F.expr(f"sequence(0L, (total - 1) div {_BLOCK})")).alias("b")
    )
    expected = blocks.select(
        F.explode(
            F.expr(
                f"sequence(b * {_BLOCK} + 1, least(total, (b + 1) * {_BLOCK}))"
            )
        ).alias("page")
    )
    return expected.join(pages.select("page"), "page", "left_anti")


PageReader = Callable[[int, int], dict]


class _PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first = first
        self.last = last


class _PagedReader(DataSourceReader):
    def __init__(self, read_page: PageReader, limit: int, pages_per_task: int):
        self._read_page = read_page
        self._limit = limit
        self._pages_per_task = pages_per_task

    def partitions(self) -> list[InputPartition]:
        total = self._read_page(1, self._limit)["pagination"]["total_page"]
        step = self._pages_per_task
        return [
            _PageRange(first, min(first + step - 1, total))
            for first in range(1, max(total, 1) + 1, step)
        ]

    def read(self, partition: _PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            for row in self._read_page(page, self._limit)["data"]["search_data"]:
                yield _listing_tuple(row)


def _listing_tuple(row: dict) -> tuple:
    topics = row.get("topik")
    if topics is not None:
        topics = [(t.get("uuid"), t.get("keterangan")) for t in topics]
    return (
        row.get("permalink"),
        row.get("perihal"),
        row.get("tanggal_efektif"),
        row.get("status_dokumen"),
        topics,
    )


class PagedListingSource(DataSource):
    """``spark.read.format("paged_listing")``: tasks fetch ranges of pages.

    Options: ``page_reader`` is ``"module:function"``, a callable taking
    ``(page, limit)`` and returning the page's envelope as a dict; ``limit`` is
    the page size; ``pages_per_task`` the number of pages a task fetches.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> T.StructType:
        return LISTING

    def reader(self, schema: T.StructType) -> DataSourceReader:
        module, _, function = self.options["page_reader"].partition(":")
        return _PagedReader(
            getattr(importlib.import_module(module), function),
            int(self.options.get("limit", "4000")),
            int(self.options.get("pages_per_task", "1")),
        )


class _PageStream(DataSourceStreamReader):
    """Offsets are ``{"snapshot", "page"}``: pages up to ``page`` have been planned."""

    def __init__(self, functions: tuple, options: dict[str, str]):
        self._read_page, self._landed, self._on_commit = functions
        self._snapshot = options.get("snapshot", "")
        self._limit = int(options.get("limit", "4000"))
        self._pages_per_task = int(options.get("pages_per_task", "1"))

    def initialOffset(self) -> dict:
        return {"snapshot": self._snapshot, "page": 0}

    def latestOffset(self) -> dict:
        if self._landed is not None:
            last = self._landed(self._limit)
        else:
            last = self._read_page(1, self._limit)["pagination"]["total_page"]
        return {"snapshot": self._snapshot, "page": int(last)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["snapshot"] != end["snapshot"]:
            raise ValueError(
                f"the checkpoint is of snapshot {start['snapshot']!r}, not {end['snapshot']!r}"
            )
        step = self._pages_per_task
        return [
            _PageRange(first, min(first + step - 1, end["page"]))
            for first in range(start["page"] + 1, end["page"] + 1, step)
        ]

    def read(self, partition: _PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            envelope = self._read_page(page, self._limit)
            rows = [_listing_tuple(row) for row in envelope["data"]["search_data"]]
            yield page, (rows,), (envelope["pagination"]["total_page"],)

    def commit(self, end: dict) -> None:
        if self._on_commit is not None:
            self._on_commit(end["page"])


def page_stream(
    read_page: PageReader,
    landed: Callable[[int], int] | None = None,
    on_commit: Callable[[int], None] | None = None,
) -> type[DataSource]:
    """A source for ``spark.dataSource.register`` and ``readStream.format("listing_pages")``.

    It gives page envelopes as they land. ``read_page`` takes page and limit and returns
    the envelope as a dict; ``landed`` takes the limit and returns how many pages can be
    read by now (default: all that page 1 tells of); ``on_commit`` is told up to which
    page all are stored. Options: ``snapshot``, the id of the snapshot whose pages are
    read, ``limit`` and ``pages_per_task``. A query that is started again goes on behind
    the last page that its checkpoint has; a checkpoint of another snapshot is refused.
    """
    functions = (read_page, landed, on_commit)

    class PageStreamSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "listing_pages"

        def schema(self) -> T.StructType:
            return LISTING_PAGE

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _PageStream(functions, dict(self.options))

    return PageStreamSource


def land_pages(
    spark: SparkSession,
    folder: str,
    checkpoint: str,
    snapshot: str,
    source: type[DataSource],
    **options: str,
) -> StreamingQuery:
    """Store the pages of a snapshot that can be read by now, each once, and stop.

    ``source`` comes from ``page_stream``. Run it again, with the same folder and
    checkpoint, until ``missing_pages`` of the folder is empty: only pages that are new are
    read. Read the folder with ``read_listing_pages``.
    """
    spark.dataSource.register(source)
    pages = spark.readStream.format("listing_pages").option("snapshot", snapshot)
    return (
        pages.options(**options)
        .load()
        .writeStream.format("json")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
