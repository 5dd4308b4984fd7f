"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: each task writes archives of gzip members, one record each; the commit lists them in a manifest with places at which an
archive can be entered, so files of tasks that were lost or repeated do not count. Members name their own length, as the
standard's skip-length field does.
Reading: files, or stretches of them, are planned into partitions of similar size. Filters on record type and other headers
are pushed down; a record's headers are inflated first, and a payload that no filter wants is skipped without being inflated
(archives without lengths are inflated up to the next record, but not kept).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import LongType, StringType, StructField, StructType

from labelmill.llm.common import utf8
from labelmill.settle import land, shared_folder

MANIFEST = "_archives"
#: Bytes of archive for one partition, and between the places at which an archive can be entered.
PARTITION, ENTRY = 32 << 20, 4 << 20
HEAD = 4096
SCHEMA = StructType([
    StructField("record_type", StringType()), StructField("record_id", StringType()), StructField("target_uri", StringType()),
    StructField("date", StringType()), StructField("refers_to", StringType()), StructField("payload_digest", StringType()),
    StructField("payload_bytes", LongType()), StructField("payload", StringType()),
])
_HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
_DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """A record (uncompressed) from a row with the columns of ``SCHEMA``; ``payload`` is bytes, and empty in a revisit, whose
    ``payload_bytes`` and digest are those of the record it refers to."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_plain(row['record_id'])}>", f"WARC-Date: {row.get('date') or _DATE}"]
    if row.get("target_uri") is not None:
        head.append(f"WARC-Target-URI: {_plain(row['target_uri'])}")
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row.get("refers_to") is not None:
        head += [f"WARC-Refers-To: <{_plain(row['refers_to'])}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field "sl" holds its own and the data's length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


@dataclass
class Archive(ds.InputPartition):
    """Stretches (file, start, end) of archives; an end of -1 is that of the file."""

    stretches: tuple[tuple[str, int, int], ...]


@dataclass
class Written(ds.WriterCommitMessage):
    file: str
    size: int
    entries: list[int]


class _Reader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options, self.wanted = schema, options, []

    def pushFilters(self, filters):  # noqa: ANN001, ANN201, N802
        """Equality and membership on headers are taken over; Spark applies the others."""
        for f in filters:
            kind, name = type(f).__name__, getattr(f, "attribute", ())
            if len(name) == 1 and name[0] in _HEADERS and kind in ("EqualTo", "In", "IsNotNull"):
                values = None if kind == "IsNotNull" else {f.value} if kind == "EqualTo" else set(f.value)
                self.wanted.append((name[0], values))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        files, root = _system(self.options["path"])
        info = files.get_file_info(root)
        every = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        # Every write has its own manifest, which tells what it has finished.
        listed = sorted(i.path for i in every if i.base_name.startswith(MANIFEST) and i.type == fs.FileType.File)
        if listed:
            found = []
            for name in listed:
                with files.open_input_stream(name) as stream:
                    found += [(f"{root}/{x['file']}", x["size"], x["entries"]) for x in json.loads(stream.read())]
        else:
            found = sorted((i.path, i.size, []) for i in every if i.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path))
        limit = int(self.options.get("partitionbytes", PARTITION))
        out, own, held = [], [], 0
        for path, size, entries in found:
            starts = [0, *(e for e in entries if 0 < e < size)]
            for start, end in zip(starts, [*starts[1:], size], strict=True):
                if own and held + end - start > limit:
                    out.append(Archive(tuple(own)))
                    own, held = [], 0
                if own and own[-1][0] == path and own[-1][2] == start:
                    own[-1] = (path, own[-1][1], end)
                else:
                    own.append((path, start, end))
                held += end - start
        return [*out, *([Archive(tuple(own))] if own else [])] or [Archive(())]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        files, _ = _system(self.options["path"])
        names = self.schema.names
        check = self.options.get("verify", "false") == "true"
        keep = "payload" in names or check
        rows, held = [], 0
        for path, start, end in partition.stretches:
            with files.open_input_file(path) as stream:
                for row in records(stream, start, end, self.wanted, keep):
                    if check and row["record_type"] == "response" and row["payload_digest"] != digest(row["payload"]):
                        raise ValueError(f"{path}: the payload of {row['record_id']} does not have its digest")
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield self._batch(rows, names)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, names)

    def _batch(self, rows: list[dict], names: list[str]) -> pa.RecordBatch:
        arrays = []
        for field in self.schema.fields:
            values = [r.get(field.name) for r in rows]
            kind = {"bigint": pa.int64(), "binary": pa.binary()}.get(field.dataType.simpleString(), pa.string())
            if field.name == "payload" and kind == pa.string():
                values = [v if v is None else v.decode("utf-8", "replace") for v in values]
            arrays.append(pa.array(values, kind))
        return pa.RecordBatch.from_arrays(arrays, names)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _row(fields: dict[str, str]) -> dict:
    row = {name: fields.get(header) for name, header in _HEADERS.items()}
    for name in ("record_id", "refers_to"):
        if row[name] is not None:
            row[name] = row[name].removeprefix("<").removesuffix(">")
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    return row


def _fits(row: dict, wanted: list) -> bool:
    return all(row[name] is not None and (values is None or row[name] in values) for name, values in wanted)


class _Member:
    """Bytes of the gzip member, or plain record, at the stream's place, taken as far as asked for."""

    def __init__(self, stream, at: int) -> None:  # noqa: ANN001
        self.stream, self.at, self.size = stream, at, 0
        stream.seek(at)
        start = stream.read(HEAD)
        self.packed = start[:2] == b"\x1f\x8b"
        # Grows in place: a long payload is not copied for each piece of it.
        self.data, self.feed = bytearray(), start
        if self.packed:
            if len(start) >= 24 and start[3] & 4 and start[12:14] == b"sl":
                self.size = struct.unpack("<I", start[16:20])[0]
            self.unpack = zlib.decompressobj(31)
        self.over = not start
        self.used = 0

    def more(self) -> bool:
        """Take some more bytes into ``data``; False at the end."""
        if self.over:
            return False
        if not self.feed:
            self.feed = self.stream.read(1 << 16)
            if not self.feed:
                if self.packed:
                    raise ValueError("an archive ends within a record")
                self.over = True
                return False
        if self.packed:
            # Bounded output: a payload is inflated no further than asked for.
            got = self.unpack.decompress(self.feed, 1 << 16)
            self.over = self.unpack.eof
            left = self.unpack.unused_data if self.over else self.unpack.unconsumed_tail
            self.used += len(self.feed) - len(left)
            self.feed = left
            self.data += got
        else:
            self.data += self.feed
            self.feed = b""
        return True

    def find(self, start: int, end: int | None = None) -> int:
        """Where the first blank line from ``start`` on is, within ``end``; -1 if there is none. Each byte is looked at once."""
        seen = start
        while True:
            found = self.data.find(b"\r\n\r\n", seen, len(self.data) if end is None else end)
            held = len(self.data)
            if found >= 0 or (end is not None and held >= end) or not self.more():
                return found
            seen = max(start, held - 3)

    def next(self, total: int) -> int:
        """Where the next record starts, ``total`` being the length of this one."""
        if not self.packed:
            return self.at + total
        if self.size:
            return self.at + self.size
        while not self.over:
            self.data.clear()
            self.more()
        return self.at + self.used


def records(stream, start: int, end: int, wanted: list, keep: bool) -> Iterator[dict]:  # noqa: ANN001
    """Rows of the records that start in [start, end) and have the headers wanted, with their payload if ``keep``."""
    at = start
    while at < end or end < 0:
        own = _Member(stream, at)
        end_of_head = own.find(0)
        if end_of_head < 0:
            if own.data.strip():
                raise ValueError("not a record")
            return
        head = bytes(own.data[:end_of_head])
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        block, length = len(head) + 4, int(fields["content-length"])
        row = _row(fields) | {"payload": None, "payload_bytes": None}
        if _fits(row, wanted):
            http = fields.get("content-type", "").startswith("application/http")
            body = 0
            if http:
                inner = own.find(block, block + length)
                body = inner - block + 4 if inner >= 0 else 0
                said = _fields(bytes(own.data[block:inner])).get("content-length") if inner >= 0 else None
                row["payload_bytes"] = int(said) if said is not None else length - body
            else:
                row["payload_bytes"] = length
            if keep:
                while len(own.data) < block + length and own.more():
                    pass
                if len(own.data) < block + length:
                    raise ValueError("an archive ends within a record")
                row["payload"] = bytes(memoryview(own.data)[block + body : block + length])
            yield row
        at = own.next(block + length + 4)


class _Writer(ds.DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _system(self.options["path"])
        files.create_dir(root, recursive=True)
        name, size, entries = f"part-{uuid.uuid4().hex}.warc.gz", 0, []
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:  # packed already
            for batch in iterator:
                for row in batch.to_pylist():
                    if size - (entries[-1] if entries else 0) >= ENTRY:
                        entries.append(size)
                    data = member(record(row))
                    out.write(data)
                    size += len(data)
        return Written(name, size, entries)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _system(self.options["path"])
        files.create_dir(root, recursive=True)
        listed = [{"file": m.file, "size": m.size, "entries": m.entries} for m in messages if m and m.size]
        with files.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Archives without a manifest are removed as far as they are known."""
        files, root = _system(self.options["path"])
        for m in messages:
            if m:
                files.delete_file(f"{root}/{m.file}")


class WarcSource(ds.DataSource):
    """Options: path; partitionBytes; verify=true compares response payloads with their digests. Read with a schema without
    ``payload`` to leave payloads packed."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _urn(key: Column) -> Column:
    return F.concat(F.lit("urn:row:"), F.coalesce(key.cast("string"), F.lit("")))


def to_records(df: DataFrame, key: str, uri: str, text: str, least: int = 0) -> DataFrame:
    """Rows of ``SCHEMA`` (payload as bytes) for a table of pages: one record each, payload the UTF-8 text, empty for null.

    Of equal payloads of at least ``least`` bytes the rows of the largest key are responses and the others revisits of it, with
    an empty payload; smaller ones are responses. Null keys count as the smallest, rows that repeat the largest key as one
    record. Equality is that of SHA-1, as in the digest that revisits carry. Only digests are grouped and joined (few bytes
    a row, pre-aggregated); a page travels once, to the revisit that was found for its own key, so copies do not meet.
    """
    pages = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{uri}`").cast("string").alias("uri"), F.coalesce(utf8(f"`{text}`"), F.lit(b"")).alias("body"))
    pages = pages.withColumn("sha", F.sha1("body"))
    narrow = pages.select("key", "sha", F.length("body").alias("n"))
    groups = narrow.where(F.col("n") >= least).groupBy("sha").agg(F.max("key").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    revisits = narrow.select("key", "sha").join(groups.select("sha", "first"), "sha").where(~F.col("key").eqNullSafe(F.col("first")))
    revisits = land(revisits.select(F.coalesce("key", F.lit(-(2**63))).alias("_key"), F.col("sha").alias("_sha"), "first").distinct())
    joined = pages.join(revisits, (F.coalesce("key", F.lit(-(2**63))) == F.col("_key")) & (F.col("sha") == F.col("_sha")), "left")
    again = F.col("first").isNotNull()
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), _urn(F.col("key")).alias("record_id"), F.col("uri").alias("target_uri"),
        F.lit(_DATE).alias("date"), F.when(again, _urn(F.col("first"))).alias("refers_to"), _base32(F.col("sha")).alias("payload_digest"),
        F.length("body").cast("long").alias("payload_bytes"), F.when(again, F.lit(b"")).otherwise(F.col("body")).alias("payload"),
    )


def _base32(sha: Column) -> Column:
    """Base32 of 40 hexadecimal digits: every five are four signs."""
    signs = []
    for i in range(8):
        five = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("long")
        signs += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(five, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*signs)


def write(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(SCHEMA.names), **options: object) -> DataFrame:
    register(spark)
    schema = StructType([SCHEMA[c] for c in columns])
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def archive(spark: SparkSession, df: DataFrame, key: str, uri: str, text: str, least: int = 0) -> str:
    """Write ``df`` to a new folder of archives in the shared folder; its path."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(to_records(df, key, uri, text, least), path)
    return path
