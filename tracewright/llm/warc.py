"""WARC archives: a writer that stores equal payloads once, and a Python data source.

The data source plans partitions from the files, takes predicates on the record type and other header
columns, parses a record's header first, and skips the payloads of records that aren't asked for.

Null pages' contents count as empty. Pages with equal ids and contents are all responses where they
hold the smallest id; a null id never is the smallest. An empty table gives no files, and reading a
folder without files gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from . import storage

#: Bytes of a file after which the writer begins another.
FILE_BYTES = 256 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, record_date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}


def _record(record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', uri)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", content_col: str = "html", date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """A record per page, each a gzip member. Of equal payloads of ``min_bytes`` or more all but that of the smallest id are revisits."""
    content = F.coalesce(F.col(content_col), F.lit(""))
    given = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), content.alias("content"), F.sha1(F.encode(content, "UTF-8")).alias("digest"))
    keys = given.where(F.octet_length("content") >= min_bytes).select("id", "digest")
    first = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    again = keys.join(first, "digest").where("not (id <=> first)").dropDuplicates(["id", "digest"])
    again = again.select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    dealt = given.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, held, size = TaskContext.get().partitionId(), [], [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                name = f"pages-{part:06d}-{len(names):04d}.warc.gz"
                storage.write_file(f"{path}/{name}", b"".join(held))
                names.append(name)
            held, size = [], 0

        for batch in batches:
            for key, uri, text, refers in zip(*(c.to_pylist() for c in batch.columns)):
                packed = zlib.compressobj(level, zlib.DEFLATED, 31)
                record = _record(f"urn:x-page:{'null' if key is None else key}", uri or "", date, text.encode(), None if refers is None else f"urn:x-page:{refers}")
                held.append(packed.compress(record) + packed.flush())
                size += len(held[-1])
                if size >= FILE_BYTES:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    dealt.select("id", "uri", "content", "first").mapInArrow(files, "name string").write.format("noop").mode("overwrite").save()


class FilePartition(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    """wanted: header column -> allowed values, or None for any value but null."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.decode = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.target = int(options.get("partitionbytes", 32 << 20))
        self.wanted: dict[str, set[str] | None] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name not in _HEADERS or (values is None and not isinstance(f, IsNotNull)):
                yield f
                continue
            before = self.wanted.get(name)
            self.wanted[name] = values if before is None else before if values is None else before & values

    def partitions(self) -> list[FilePartition]:
        groups: list[list[str]] = []
        size = 0
        for uri, n in storage.list_files(self.path):
            if not uri.endswith((".warc", ".warc.gz")):
                continue
            if not groups or size + n > self.target:
                groups.append([])
                size = 0
            groups[-1].append(uri)
            size += n
        return [FilePartition(g) for g in groups] or [FilePartition([])]

    def _open(self, uri: str):
        source = storage.open_input(uri)
        return gzip.GzipFile(fileobj=source) if uri.endswith(".gz") else source

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        for uri in partition.files:
            with self._open(uri) as source:
                yield from self._records(source)

    def _records(self, source) -> Iterator[tuple]:
        while True:
            line = source.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers: dict[str, str] = {}
            while (line := source.readline().strip()) and b":" in line:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.lower()] = value.strip()
            row = {c: headers.get(h.lower()) for c, h in _HEADERS.items()}
            for c in ("record_id", "refers_to"):
                row[c] = row[c] and row[c].strip("<>")
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
            length = int(headers.get("content-length", 0))
            if any(row[c] is None or (v is not None and row[c] not in v) for c, v in self.wanted.items()):
                source.seek(length + 4, 1)  # its payload isn't looked at
                continue
            at = source.tell()
            n, size = None, 0
            if headers.get("content-type", "").startswith("application/http"):
                while size < length and (line := source.readline()):
                    size += len(line)
                    if line.lower().startswith(b"content-length:"):
                        n = int(line.split(b":", 1)[1])
                    if not line.strip():
                        break
            payload = None
            if row["record_type"] != "revisit" and (self.decode or self.verify):
                payload = source.read(length - size)
                if self.verify and row["payload_digest"] and base64.b32encode(hashlib.sha1(payload).digest()).decode() != row["payload_digest"]:
                    raise ValueError(f"the payload of {row['record_id']} differs from its digest")
            source.seek(at + length + 4)
            yield (*row.values(), length - size if n is None else n, payload if self.decode else None)


class WarcDataSource(DataSource):
    """Format ``warc``. Options: path, payload (false: leave payloads out), verify (check digests), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)
