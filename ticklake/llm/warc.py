"""Web archives: records as gzip members of their own, and their sequential reader.

Writing: a page becomes one WARC record (an HTTP response, or a revisit that only refers to the
response of equal payload), compressed as one gzip member. Spark's text sink writes the members one
after another, so its commit protocol, its retries and any file system it knows hold for archives
too: a member's last byte, the top byte of its length, is zero below 16 MB, and serves as the sink's
line separator; to a longer record an empty member is appended, which ends that way again.

Reading: a task reads a file from its start in small chunks, inflates member by member, cuts each by
its Content-Length and checks block and payload digests as bytes pass. It holds one chunk and, only
where payloads are wanted, one record, however long the file is.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, scratch_root, table, written

VERSION, REVISIT = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID, BREAK = "urn:ticklake:record:", b"\r\n\r\n"
#: Bytes that are read at a time, rows of repeated payloads that tasks are told of, and bytes of a head.
CHUNK, TOLD, HEAD = 1 << 14, 100_000, 1 << 20
#: File systems that a task opens as a stream; of others it gets whole files from Spark's reader.
STREAMED = {"file", "hdfs", "s3", "gs", "abfs"}
RECORDS = "path string, offset long, record_id string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, intact boolean"


def digest(data: bytes | hashlib._Hash) -> str:
    sha1 = hashlib.sha1(data) if isinstance(data, bytes) else data
    return base64.b32encode(sha1.digest()).decode()


def record(key: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A whole record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{ID}{quote(key)}>",
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7F]", lambda c: quote(c[0]), url or "about:blank"),
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "WARC-Block-Digest": "sha1:" + digest(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{ID}{quote(refers_to)}>", "WARC-Profile": REVISIT}
    lines = [VERSION, *(f"{k}: {v}" for k, v in head.items())]
    return "\r\n".join(lines).encode() + BREAK + block + BREAK


def member(data: bytes) -> bytes:
    """One gzip member; an empty one behind it where it wouldn't end in a zero byte."""
    packed = gzip.compress(data, 6, mtime=0)
    return packed if packed[-1] == 0 else packed + gzip.compress(b"", mtime=0)


def with_responses(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """``refers_to`` beside the rows: of rows with equal payload the largest key's is null, the others'
    is that key. Groups of copies are reduced to one row before they meet; the few repeated payloads
    are told to all tasks up to ``TOLD``, and joined by shuffle beyond."""
    rows = df.withColumn("__same", F.unhex(F.sha2(payload, 256)))
    repeated = rows.groupBy("__same").agg(F.max(key).alias("__largest"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __largest is not null")
    repeated = written(repeated.select("__same", "__largest"), "repeated")
    repeated = F.broadcast(repeated) if repeated.count() <= TOLD else repeated
    other = F.col(key).isNull() | (F.col(key) < F.col("__largest"))
    return rows.join(repeated, "__same", "left").withColumn("refers_to", F.when(other, F.col("__largest"))).drop("__same", "__largest")


def write_warc(df: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """A record for each row of ``df`` in ``*.warc.gz`` files below ``path``, which must not exist yet.

    Of rows with equal payloads (UTF-8; null: empty) that with the largest key is a response, the
    others revisit it. Rows that share the largest key are all responses; rows without a key revisit
    the largest, or are responses where none has one. Null addresses are written as ``about:blank``,
    controls and spaces in others percent-encoded. Other columns don't matter, empty tables write no
    record. ``key`` should name rows uniquely, as record ids come from it.
    """
    given = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = with_responses(given, "key", F.col("payload")).select(F.col("key").cast("string"), "url", "payload", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 200):
            out = [member(record(k or "", u, p, r, date))[:-1] for k, u, p, r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = rows.mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        at = status.getPath()
        if at.getName().endswith(".txt"):
            files.rename(at, spark._jvm.org.apache.hadoop.fs.Path(folder, at.getName().removesuffix(".txt") + ".warc.gz"))


class Reader:
    """One record, fed the bytes of its member as they come."""

    def __init__(self, keep: bool) -> None:
        self.rest, self.left, self.size = b"", 0, 0
        self.head: dict[str, str] | None = None
        self.http: dict[str, str] | None = None
        self.block, self.payload = hashlib.sha1(), hashlib.sha1()
        self.kept: list[bytes] | None = [] if keep else None

    def _head(self) -> bytes | None:
        """The bytes up to and with the next empty line, if they are there."""
        end = self.rest.find(BREAK) + 4
        if end < 4:
            if len(self.rest) > HEAD:
                raise ValueError("a head has no end")
            return None
        found, self.rest = self.rest[:end], self.rest[end:]
        return found

    @staticmethod
    def _fields(head: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        return {name.strip().lower(): value.strip() for name, _, value in pairs if name}

    def feed(self, data: bytes) -> None:
        self.rest += data
        if self.head is None:
            head = self._head()
            if head is None:
                return
            if not head.startswith(b"WARC/1."):
                raise ValueError("no WARC record")
            self.head = self._fields(head)
            self.left = int(self.head["content-length"])
            if not self.head.get("content-type", "").startswith("application/http"):
                self.http = {}
        if self.http is None:
            head = self._head()
            if head is None:
                return
            self.http = self._fields(head)
            self.block.update(head)
            self.left -= len(head)
        if self.left > 0:
            body, self.rest = self.rest[: self.left], self.rest[self.left :]
            self.block.update(body)
            self.payload.update(body)
            self.left -= len(body)
            self.size += len(body)
            if self.kept is not None:
                self.kept.append(body)

    def done(self) -> dict | None:
        """The record; none for an empty member."""
        if self.head is None and not self.rest:
            return None
        if self.http is None or self.left or self.rest != BREAK:
            raise ValueError("a record's length isn't its Content-Length")
        name = lambda field: (self.head.get(field) or "").strip("<>") or None
        said = (self.head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        revisit = self.head.get("warc-type") == "revisit"
        right = self.head.get("warc-block-digest") in (None, "sha1:" + digest(self.block))
        return {
            "record_id": name("warc-record-id"), "record_type": self.head.get("warc-type"), "refers_to": name("warc-refers-to"), "url": name("warc-target-uri"),
            "payload_bytes": int(self.http.get("content-length") or 0) if revisit else self.size, "payload_digest": said or digest(self.payload),
            "intact": right and (revisit or said in (None, digest(self.payload))), "payload": None if self.kept is None or revisit else b"".join(self.kept),
        }


def records(read: Callable[[int], bytes], keep: bool = False) -> Iterator[dict]:
    """The records of an archive from its start on, ``offset`` beside them: where each one's member begins."""
    data, at = read(CHUNK), 0
    while data:
        inflate, reader, start = zlib.decompressobj(wbits=31), Reader(keep), at
        while not inflate.eof:
            if not data:
                raise ValueError(f"the member at {start} is cut off")
            reader.feed(inflate.decompress(data))
            at += len(data) - len(inflate.unused_data)
            data = inflate.unused_data or read(CHUNK)
        found = reader.done()
        if found:
            yield found | {"offset": start}


def _stream(path: str) -> Callable[[int], bytes]:
    if urlsplit(path).scheme == "file":
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb").read
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name).read


def read_warc(spark: SparkSession, path: str, *, keep_payload: bool = False, strict: bool = True) -> DataFrame:
    """One row a record of the ``*.warc.gz`` files below ``path``: the columns of ``RECORDS``, and
    ``payload`` (binary; null for revisits) on request. Lengths and digests are those of the full
    payload: a revisit has them from the HTTP head it repeats. A file that is cut off or not framed
    by its lengths fails, and so does a wrong digest unless ``strict`` is off: ``intact`` is false then.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    streamed = urlsplit(path).scheme in STREAMED
    files = files.select("path", (F.lit(None) if streamed else F.col("content")).cast("binary").alias("content"))
    schema = RECORDS + ", payload binary" * keep_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = pa.schema([(n, {"offset": pa.int64(), "payload_bytes": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                read, rows, size = _stream(name) if content is None else io.BytesIO(content).read, [], 0
                try:
                    for found in records(read, keep_payload):
                        if strict and not found["intact"]:
                            raise ValueError(f"wrong digest in the record at {found['offset']}")
                        rows.append({n: found.get(n, name) for n in names})
                        size += len(found["payload"] or b"") + 500
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                except (ValueError, zlib.error) as wrong:
                    raise ValueError(f"{name}: {wrong}") from wrong
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.mapInArrow(run, schema)


def record_key(column: str) -> Column:
    """The row's key in a record id that ``write_warc`` made; null where the row had none."""
    return F.nullif(F.url_decode(F.replace(F.substring(column, len(ID) + 1, 1 << 30), F.lit("+"), F.lit("%2B"))), F.lit(""))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/ticklake-warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(
        record_key("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        record_key("refers_to").cast("long").alias("refers_to"),
    )


ORACLE = """with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as largest from pages),
  d as (select *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) % 32, 1)) as letters from p)
  select page_id, strlen(html) as payload_bytes, array_to_string(letters, '') as payload_digest, case when page_id = largest then 'response' else 'revisit' end as record_type,
    case when page_id < largest then largest end as refers_to from d"""
