"""WARC archives as a Python data source, and page tables written as WARC.

Records are single gzip members, as archives usually are. The writer notes a member's
length in its gzip header (the ``sl`` extra field of the WARC annex), so the reader can
step over a record after its header; members without it, and plain ``.warc`` files, are
read as well.
"""

from __future__ import annotations

import base64
import fnmatch
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from lexsnap.session import materialize, scratch_path

FORMAT = "lexsnap_warc"
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, headers map<string, string>, payload binary"
)
# Columns that stand in the record header, so predicates on them need no payload.
HEADER_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 128 << 20
FILE_BYTES = 512 << 20
BATCH_BYTES = 8 << 20
_HEAD_BYTES = 4096
_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC-Payload-Digest has it after ``sha1:``."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing


def record_bytes(row: dict) -> bytes:
    """A response or revisit record; a revisit has the HTTP header only."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", None if row["target_uri"] is None else quote(row["target_uri"], safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", row["refers_to"] if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + _END


def gzip_member(data: bytes) -> bytes:
    """One gzip member with its own length in the extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own below ``_pending``; the commit moves them up."""

    def __init__(self, options):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(f"{root}/_pending", recursive=True)
        names: list[str] = []
        out, held = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or held >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz")
                    out, held = fs.open_output_stream(f"{root}/_pending/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                member = gzip_member(record_bytes(row))
                out.write(member)
                held += len(member)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else []:
                fs.move(f"{root}/_pending/{name}", f"{root}/{name}")

    def abort(self, messages) -> None:
        """Files of a failed write stay below ``_pending``, which readers pass over."""


# ---- reading


@dataclass
class Files(InputPartition):
    paths: list[str]


def _parse_fields(block: bytes) -> dict[str, str]:
    """Header fields, names in lower case; continuation lines belong to the one before."""
    fields: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


class _Member:
    """The records of a gzip member, or of a plain archive from here on, one after the other.

    An archive that ends inside a record raises ``ValueError``.
    """

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size
        self.begin = stream.tell()
        magic = stream.read(2)
        stream.seek(self.begin)
        self.gzip = magic == b"\x1f\x8b"
        self.end = self.length = None
        self.left = False  # by a seek, before all was inflated
        if self.gzip:
            first = stream.read(24)
            if len(first) == 24 and first[3] & 4 and first[12:14] == b"sl":
                packed, self.length = struct.unpack("<II", first[16:24])
                self.end = self.begin + packed
            stream.seek(self.begin)
            self.inflate = zlib.decompressobj(31)
        self.data = b""
        self.told = 0  # bytes of the member that heads and blocks before have taken

    def head(self) -> bytes | None:
        """The next record's header; None behind the last, where the stream stands at what follows."""
        while not self.left and (cut := self.data.find(_END)) < 0 and self._more():
            pass
        if self.left:
            return None
        if cut < 0:
            if self.data.strip(b"\r\n"):
                raise self._cut_off()
            if self.gzip:
                self.stream.seek(self.stream.tell() - len(self.inflate.unused_data))
            return None
        block, self.data = self.data[:cut], self.data[cut + 4 :]
        self.told += cut + 4
        return block.lstrip(b"\r\n")

    def body(self, length: int) -> bytes:
        """The block of the record whose header was taken last."""
        if not self.gzip:
            block = self.stream.read(length)
            if len(block) < length:
                raise self._cut_off()
            self.stream.seek(4, io.SEEK_CUR)
            return block
        parts, held = [self.data], len(self.data)
        while held < length + 4 and (piece := self._inflated(1 << 20)) is not None:
            parts.append(piece)
            held += len(piece)
        if held < length:
            raise self._cut_off()
        whole = b"".join(parts)
        self.data = whole[length + 4 :]
        self.told += length + 4
        return whole[:length]

    def skip(self, length: int) -> None:
        """Step over that block: unread where the archive is plain or notes the member's length."""
        if not self.gzip:
            if self.stream.tell() + length > self.size:
                raise self._cut_off()
            self.stream.seek(length + 4, io.SEEK_CUR)
        elif self.end is not None and self.told + length + 4 == self.length:
            if self.end > self.size:
                raise self._cut_off()
            self.stream.seek(self.end)
            self.left = True
        else:
            left = length - len(self.data)
            while left > 0:
                piece = self._inflated(1 << 20)
                if piece is None:
                    raise self._cut_off()
                self.data, left = piece, left - len(piece)
            self.data = self.data[len(self.data) + left :]
            while len(self.data) < 4 and self._more():
                pass
            self.data = self.data[4:]
            self.told += length + 4

    def _more(self) -> bool:
        if self.gzip:
            piece = self._inflated(_HEAD_BYTES)
        else:
            piece = self.stream.readline() or None
        if piece is None:
            return False
        self.data += piece
        return True

    def _inflated(self, most: int) -> bytes | None:
        if self.inflate.eof:
            return None
        raw = self.inflate.unconsumed_tail or self.stream.read(_HEAD_BYTES if most == _HEAD_BYTES else 1 << 16)
        if not raw:
            raise self._cut_off()
        return self.inflate.decompress(raw, most)

    def _cut_off(self) -> ValueError:
        return ValueError(f"the archive is cut off in a record of the member at byte {self.begin}")


def _wanted(head: dict[str, str], tests: list[tuple[str, str, tuple]]) -> bool:
    for name, kind, values in tests:
        value = head.get(name)
        if name == "warc-payload-digest" and value is not None:
            value = value.removeprefix("sha1:")
        if value is None or (kind == "in" and value not in values) or (kind == "starts" and not value.startswith(values)):
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.pattern = options.get("pattern", "*.warc*")
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Predicates on header columns are tested before a payload is inflated."""
        for f in filters:
            name = HEADER_OF.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", (f.value,)))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "present", ()))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Whole files, small ones together up to ``partitionBytes``."""
        fs, root = pafs.FileSystem.from_uri(self.root)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        root = root.rstrip("/")

        def hidden(path: str) -> bool:
            return any(part[0] in "._" for part in path.removeprefix(root).strip("/").split("/"))

        files = sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern) and not hidden(f.path))
        parts: list[Files] = []
        held = 0
        for path, size in files:
            if not parts or held + size > self.partition_bytes:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(path)
            held += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for row in self._rows(io.BufferedReader(raw, 1 << 16), raw.size()):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 1024
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _rows(self, stream, size: int) -> Iterator[dict]:
        while stream.peek(1):
            member = _Member(stream, size)
            while (block := member.head()) is not None:
                row = self._record(member, block)
                if row is not None:
                    yield row

    def _record(self, member: _Member, block: bytes) -> dict | None:
        head = _parse_fields(block)
        length = int(head.get("content-length", 0))
        if not _wanted(head, self.tests):
            member.skip(length)
            return None
        block = member.body(length)
        http, payload = {}, block
        if head.get("content-type", "").startswith("application/http"):
            first, _, payload = block.partition(_END)
            http = _parse_fields(first)
        revisit = head.get("warc-type") == "revisit"
        noted = head.get("warc-payload-digest")
        noted = None if noted is None else noted.removeprefix("sha1:")
        if self.verify and not revisit and noted and digest(payload) != noted:
            raise ValueError(f"payload of {head.get('warc-record-id')} does not have its digest")
        size = int(http.get("content-length", 0)) if revisit else len(payload)
        row = {column: head.get(name) for column, name in HEADER_OF.items()}
        return row | {
            "payload_digest": noted,
            "payload_bytes": size,
            "headers": list(head.items()),
            "payload": payload if self.payload and not revisit else None,
        }


_ARROW = pa.schema(
    [
        *((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest")),
        ("payload_bytes", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)


class WarcSource(DataSource):
    """``path``; for reading also ``payload``, ``verify``, ``partitionBytes``, ``pattern``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of all archives below ``path``. Predicates on header columns are pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(path=path, **options).load()


def write_warc(records: DataFrame, path: str) -> None:
    """Write ``(record_id, record_type, target_uri, date, refers_to, payload)`` below ``path``."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select("record_id", "record_type", "target_uri", "date", "refers_to", "payload").write.format(FORMAT).options(
        path=path
    ).mode("append").save()


def page_records(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records of ``(page_id, url, html, …)``: one response per payload, revisits of it.

    Of pages with equal payloads of at least ``min_bytes`` the one with the largest
    page_id is the response (of repeated rows, one); smaller payloads are all responses.
    Null html is an empty payload, a null url has no target URI, a null page_id counts
    as the smallest. Record ids are ``<urn:page:PAGE_ID:SHA1>``, those of revisits end
    in a UUID. Other columns are not read.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    # The join and the numbering below share these keys, so payloads are shuffled once.
    named = {"no_id": F.col("page_id").isNull(), "id": F.coalesce("page_id", F.lit(0).cast("long"))}
    rows = rows.withColumns({**named, "sha": F.sha1("payload"), "size": F.octet_length("payload")})
    key = ["no_id", "id", "sha"]
    thin = materialize(rows.select(*key, "size", "page_id").distinct(), "page-digests")
    first = materialize(thin.groupBy("sha", "size").agg(F.max("page_id").alias("first_id")), "first-pages")
    marks = materialize(thin.join(first, ["sha", "size"]).select(*key, "first_id"), "page-marks")
    marked = rows.join(marks, key)
    # Only repeated rows share page_id and payload; the numbering streams through them.
    number = F.expr("row_number() OVER (PARTITION BY no_id, id, sha ORDER BY target_uri)")
    first_row = F.col("page_id").eqNullSafe(F.col("first_id")) & (number == 1)
    marked = marked.withColumn("response", first_row | (F.col("size") < min_bytes))

    def urn(page_id: str):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("none")), F.lit(":"), F.col("sha"))

    return marked.select(
        F.concat(urn("page_id"), F.when(F.col("response"), ">").otherwise(F.concat(F.lit(":"), F.uuid(), F.lit(">")))).alias("record_id"),
        F.when(F.col("response"), "response").otherwise("revisit").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(~F.col("response"), F.concat(urn("first_id"), F.lit(">"))).alias("refers_to"),
        "payload",
    )


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> str:
    """Write ``pages`` as archives below ``path`` (a scratch folder if none); gives the path."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_warc(page_records(pages, min_bytes), path)
    return path


def _page_of(column: str):
    return F.regexp_extract(column, r"^<urn:page:(-?\d+):", 1).try_cast("long")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of each record.

    Responses are read whole and held against their digests; of revisits only headers.
    """
    responses = read_warc(spark, path, payload="false", verify="true").where("record_type = 'response'")
    revisits = read_warc(spark, path, payload="false").where("record_type = 'revisit'")
    return responses.unionByName(revisits).select(
        _page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", _page_of("refers_to")).alias("refers_to"),
    )
