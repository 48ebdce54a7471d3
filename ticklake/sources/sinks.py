"""Record files as a Spark sink: JSON lines, length-prefixed bodies and capture segments.

A task writes its rows to hidden files and tells the driver their names; only when all tasks are done
does the driver give them their own names, so readers never see part of a write, nor what a lost
executor or a killed task left (hidden files, which can be deleted). Files are closed by size or by span of time, and every segment repeats the metadata. Bounds on
records and bytes hold for the whole write: a task stops at them, and the driver refuses their sum.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .framing import OPENED
from .records import _CODES, _WAYS, FIELDS, HEADER, MOST_RECORD, RECORD_COLUMNS, SEGMENT_MAGIC, SEGMENT_VERSIONS, crc32c_of, segment_record
from .wire import _bounds

FORMAT = "ticklake_records"


def _system(path: str):
    from pyarrow import fs

    if urlsplit(path).scheme not in OPENED | {""}:
        raise ValueError(f"tasks can't write to {path}")
    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class Lines:
    """Texts, a line each."""

    ending, head = "jsonl", staticmethod(lambda start, metadata: b"")

    def records(self, batch: pa.RecordBatch) -> list[bytes]:
        data, at = _bounds(batch.column("value"))
        raw = data.tobytes()
        return [raw[a:b] + b"\n" for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Bodies:
    """Texts or binaries, each behind its length."""

    ending, head = "rec", staticmethod(lambda start, metadata: b"")

    def records(self, batch: pa.RecordBatch) -> list[bytes]:
        data, at = _bounds(batch.column("value"))
        raw, lengths = data.tobytes(), np.diff(at).astype("<u4").tobytes()
        return [lengths[4 * k : 4 * k + 4] + raw[a:b] for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()))]


class Frames:
    """Capture segments. Metadata records come first in each, with the segment's start as their time."""

    ending = "mfr1"

    @staticmethod
    def head(start: int, metadata: list[str]) -> bytes:
        records = [(json.loads(m).get("session_id", 0), 0, start, 0, "inbound", "metadata", 0, m.encode()) for m in metadata]
        return HEADER.pack(SEGMENT_MAGIC, SEGMENT_VERSIONS[1], start, 0) + b"".join(map(segment_record, records))

    def records(self, batch: pa.RecordBatch) -> list[bytes]:
        data, at = _bounds(batch.column("payload"))
        begin, lengths = at[:-1], np.diff(at)
        if (lengths > MOST_RECORD - FIELDS.itemsize).any():
            raise ValueError("a payload is too large for a record")
        u64 = lambda name: batch.column(name).cast(pa.uint64()).to_numpy()
        heads = np.zeros(batch.num_rows, FIELDS)
        heads["size"], heads["length"], heads["crc"] = lengths + FIELDS.itemsize, lengths, crc32c_of(data, begin, lengths)
        heads["session"], heads["frame_seq"], heads["monotonic"] = u64("session"), u64("frame_seq"), u64("monotonic_ns")
        heads["receive"], heads["flags"] = batch.column("receive_ts_ns").to_numpy(), batch.column("flags").to_numpy()
        heads["direction"] = [_WAYS[x] for x in batch.column("direction").to_pylist()]
        heads["opcode"] = [_CODES[x] for x in batch.column("opcode").to_pylist()]
        raw, head, size = data.tobytes(), heads.tobytes(), FIELDS.itemsize
        return [head[k * size : (k + 1) * size] + raw[a:b] for k, (a, b) in enumerate(zip(begin.tolist(), at[1:].tolist()))]


KINDS = {"lines": Lines, "bodies": Bodies, "segments": Frames}


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: hidden and own names of its files, and how much is in them."""

    files: list[tuple[str, str]] = field(default_factory=list)
    records: int = 0
    size: int = 0


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        number = lambda name: int(options.get(name, 0))
        self.path, self.kind, self.job = options["path"], KINDS[options["kind"]](), uuid.uuid4().hex
        self.most_records, self.most_bytes = number("most_records"), number("most_bytes")
        self.file_bytes, self.file_ns = number("file_bytes"), number("file_ns")
        self.metadata = json.loads(options.get("metadata", "[]"))

    def _within(self, records: int, size: int) -> None:
        if self.most_records and records > self.most_records:
            raise ValueError(f"more than {self.most_records} records")
        if self.most_bytes and size > self.most_bytes:
            raise ValueError(f"more than {self.most_bytes} bytes")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        task, done, out, started, size = TaskContext.get(), Written(), None, 0, 0
        attempt = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        try:
            for batch in iterator:
                raw = self.kind.records(batch)
                times = batch.column("receive_ts_ns").to_pylist() if "receive_ts_ns" in batch.schema.names else [0] * len(raw)
                for record, time in zip(raw, times):
                    if out and ((self.file_bytes and size >= self.file_bytes) or (self.file_ns and time - started >= self.file_ns)):
                        out.close()
                        out = None
                    if out is None:
                        name = f"{time}-{task.partitionId():06d}-{len(done.files):06d}.{self.kind.ending}"
                        hidden = f"{folder}/.{self.job}-{attempt}-{len(done.files)}"
                        out, started = system.open_output_stream(hidden), time
                        done.files.append((hidden, f"{folder}/part-{self.job[:8]}-{name}"))
                        head = self.kind.head(time, self.metadata)
                        out.write(head)
                        size = len(head)
                        done.size += len(head)
                    self._within(done.records + 1, done.size + len(record))
                    out.write(record)
                    size, done.records, done.size = size + len(record), done.records + 1, done.size + len(record)
        except BaseException:
            if out:
                out.close()
            for hidden, _ in done.files:  # of a task that is killed outright they stay, hidden
                system.delete_file(hidden)
            raise
        if out:
            out.close()
        return done

    def _clean(self) -> None:
        """Hidden files of this write go, those of lost and repeated tasks too."""
        from pyarrow import fs

        system, folder = _system(self.path)
        for found in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if found.base_name.startswith(f".{self.job}-"):
                system.delete_file(found.path)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m]
        self._within(sum(m.records for m in told), sum(m.size for m in told))
        system, _ = _system(self.path)
        for message in told:
            for hidden, name in message.files:
                system.move(hidden, name)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()


class RecordFiles(DataSource):
    """Options: path, kind (lines, bodies, segments), file_bytes and file_ns (a file is closed once it has as
    many bytes, or before a record so much later than its first), most_records and most_bytes (a write
    beyond fails), metadata (a JSON list of texts, repeated in every segment)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def _saved(rows: DataFrame, path: str, kind: str, **options: int | str) -> None:
    rows.sparkSession.dataSource.register(RecordFiles)
    told = {k: str(v) for k, v in options.items() if v}
    rows.write.format(FORMAT).mode("append").options(path=path, kind=kind, **told).save()


def write_lines(rows: DataFrame, path: str, *, value: str = "value", file_bytes: int = 0, most_records: int = 0, most_bytes: int = 0) -> None:
    """Texts as lines. A write of more records or bytes (line ends included) than stated fails as a whole; 0
    means any number. Null texts are empty lines."""
    _saved(rows.select(F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value")), path, "lines", file_bytes=file_bytes, most_records=most_records, most_bytes=most_bytes)


def write_length_prefixed(rows: DataFrame, path: str, *, value: str = "value", file_bytes: int = 0, most_records: int = 0, most_bytes: int = 0) -> None:
    """JSON texts or protobuf bodies, each behind its length as a little-endian 32-bit number."""
    _saved(rows.select(F.coalesce(F.col(value).cast("binary"), F.lit(b"")).alias("value")), path, "bodies", file_bytes=file_bytes, most_records=most_records, most_bytes=most_bytes)


def write_segments(frames: DataFrame, path: str, *, file_bytes: int = 0, file_ns: int = 0, metadata: tuple[str, ...] = (), most_records: int = 0, most_bytes: int = 0) -> None:
    """Frames (columns of ``records.RECORD_COLUMNS``) as capture segments, in the order of their partition. A segment is
    closed once it has ``file_bytes``, or before a frame received ``file_ns`` after its first."""
    names = [x.split()[:2] for x in RECORD_COLUMNS.split(", ")]
    rows = frames.select(*[F.col(name).cast(kind).alias(name) for name, kind in names])
    _saved(rows, path, "segments", file_bytes=file_bytes, file_ns=file_ns, metadata=json.dumps(list(metadata)), most_records=most_records, most_bytes=most_bytes)
