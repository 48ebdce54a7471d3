"""Files of length-framed records, read by many tasks each.

Records have no marks to split a file at. So every part of a file guesses where its first record
begins, from what a record's head must look like, and walks to the first record of the next part. A
file's guesses are right if each equals the end of the walk before it: the first part begins
where the file says, and the rest follows. Where one isn't, as when a payload holds whole records itself,
that file is walked once from its start. Then the parts are read apart, wherever they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a part, and bytes that a task reads at a time (or one record).
PART, WINDOW = 64 << 20, 4 << 20
#: Bytes of small parts that share a task, once each core has so many tasks.
SHARED, ROUNDS = 8 << 20, 4
#: File systems whose files a task can open. Files of others come whole from Spark, a part each.
OPENED = {"file", "hdfs", "s3", "gs", "abfs"}
PARTS = "path string, part long, first long, stop long, records long, fault string"
_kinds = pa.schema([("path", pa.string()), ("part", pa.int64()), ("first", pa.int64()), ("stop", pa.int64()), ("records", pa.int64()), ("fault", pa.string())])


def open_file(path: str):
    """A file with ``size()`` and ``read_at(bytes, offset)``."""
    from pyarrow import fs

    if urlsplit(path).scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def little(data: np.ndarray, at: int, size: int) -> np.ndarray:
    """The unsigned 32-bit number ``at`` bytes behind each of the first ``size`` places."""
    return sum(data[at + k : at + k + size].astype(np.int64) << 8 * k for k in range(4))


class Framing:
    """How records are framed. ``head``: bytes before the first; ``least``: bytes that tell a record's size;
    ``torn``: a record that the file's end cuts off is left out instead of an error."""

    head, least, torn = 0, 4, False
    columns: dict[str, pa.DataType] = {}

    def begin(self, data: bytes) -> None:
        """Fails where a file doesn't begin like one."""

    def size(self, data: bytes, at: int) -> int:
        """Bytes of the record that begins here; fails where none can."""
        raise NotImplementedError

    def likely(self, data: np.ndarray) -> np.ndarray:
        """Places where a record may begin, ascending; needn't be all or right."""
        raise NotImplementedError

    def decode(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, offset: int, head: bytes) -> list[pa.Array]:
        """``columns`` of these records; ``head`` is the file's."""
        raise NotImplementedError


def windows(file, framing: Framing, at: int, end: int) -> Iterator[tuple[int, bytes, list[int], list[int]]]:
    """Whole records that begin from ``at`` to before ``end``: where the bytes read begin, these bytes, and
    the records' starts in them and sizes."""
    size = file.size()
    while at < end:
        data = file.read_at(min(WINDOW, size - at), at)
        starts, sizes, k = [], [], 0
        while at + k < end and len(data) - k >= framing.least:
            n = framing.size(data, k)
            if k + n > len(data):
                break
            starts.append(k)
            sizes.append(n)
            k += n
        if not starts:
            n = framing.size(data, 0) if len(data) >= framing.least else size + 1
            if at + n > size:
                if not framing.torn:
                    raise ValueError(f"truncated record at {at}")
                return
            data, starts, sizes, k = file.read_at(n, at), [0], [n], n
        yield at, data, starts, sizes
        at += k


def _guess(file, framing: Framing, start: int, end: int) -> int | None:
    """Where the first record of this part seems to begin."""
    size = file.size()
    for at in range(start, end, WINDOW):
        data = file.read_at(min(WINDOW + (64 << 10), size - at), at)
        for k in framing.likely(np.frombuffer(data, np.uint8)).tolist():
            if at + k >= min(end, at + WINDOW):
                break
            try:
                here, steps = k, 0
                while steps < 4 and len(data) - here >= framing.least:
                    here, steps = here + framing.size(data, here), steps + 1
            except ValueError:
                continue
            if at + here <= size:
                return at + k
    return None


def _walk(file, framing: Framing, first: int, end: int) -> tuple[int, int]:
    """Where the first record from ``end`` on begins, and how many there are before it."""
    stop, n = first, 0
    for at, _, starts, sizes in windows(file, framing, first, end):
        stop, n = at + starts[-1] + sizes[-1], n + len(starts)
    return (stop if stop >= end else file.size()), n


def _guessed(framing: Framing, part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, part in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(path) as file:
                    start, end = part * part_bytes, min((part + 1) * part_bytes, file.size())
                    row = {"path": path, "part": part, "first": None, "stop": None, "records": 0, "fault": None}
                    try:
                        if not part:
                            framing.begin(file.read_at(framing.head, 0))
                        row["first"] = framing.head if not part else _guess(file, framing, start, end)
                        if row["first"] is not None:
                            row["stop"], row["records"] = _walk(file, framing, row["first"], end)
                    except ValueError as wrong:
                        row["fault"] = str(wrong)
                    rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, _kinds)

    return run


def _confirmed(framing: Framing, part_bytes: int):
    """Parts of a file in a row: as they are if each begins where the one before ends, or walked anew."""

    def right(parts: list[dict], size: int) -> bool:
        at = framing.head
        for p in parts:
            if p["fault"] or (p["first"] is None and at < min((p["part"] + 1) * part_bytes, size)) or (p["first"] is not None and p["first"] != at):
                return False
            at = p["stop"] if p["first"] is not None else at
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, parts in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(path) as file:
                    size = file.size()
                    if not right(parts, size):
                        at, anew = framing.head, []
                        framing.begin(file.read_at(framing.head, 0))
                        for p in parts:
                            end = min((p["part"] + 1) * part_bytes, size)
                            first = at if at < end else None
                            at, n = _walk(file, framing, at, end) if first is not None else (at, 0)
                            anew.append(p | {"first": first, "stop": at, "records": n, "fault": None})
                        parts = anew
                rows = [{"path": path, **p} for p in parts]
                yield pa.RecordBatch.from_pylist(rows, _kinds)

    return run


def read_framed(spark: SparkSession, path: str, framing: Framing, schema: str, *, part_bytes: int = PART) -> DataFrame:
    """Records of all files below ``path``: ``path``, ``index`` (in the file) and the framing's
    columns. Empty files have none."""
    names = ["path", "index", *framing.columns]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def decoded(name: str, file, first: int, end: int, before: int) -> Iterator[pa.RecordBatch]:
        head = file.read_at(framing.head, 0)
        try:
            for at, data, starts, sizes in windows(file, framing, first, end):
                columns = framing.decode(data, np.array(starts), np.array(sizes), at, head)
                index = pa.array(np.arange(before, before + len(starts)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts), pa.string()), index, *columns], names)
                before += len(starts)
        except ValueError as wrong:
            raise ValueError(f"{name}: {wrong}") from wrong

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                file = pa.BufferReader(content)
                framing.begin(file.read_at(framing.head, 0))
                yield from decoded(name, file, framing.head, len(content), 0)

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, end, before in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(name) as file:
                    yield from decoded(name, file, first, end, before)

    if urlsplit(path).scheme not in OPENED | {""}:
        return files.select("path", "content").mapInArrow(whole, f"path string, index long, {schema}")
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / part_bytes)
    found = files.agg(F.sum(last + 1).alias("parts"), F.sum("length").alias("bytes")).first()
    at_once = max(ROUNDS * spark.sparkContext.defaultParallelism, -(-(found["bytes"] or 0) // max(part_bytes, SHARED)))
    tasks = max(1, min(found["parts"] or 0, at_once))  # small files and small parts share tasks
    sized = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    guessed = sized.select("path", "part").repartition(tasks, "path", "part").mapInArrow(_guessed(framing, part_bytes), PARTS)
    lists = guessed.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part", "first", "stop", "records", "fault"))).alias("parts"))
    confirmed = lists.mapInArrow(_confirmed(framing, part_bytes), PARTS)
    before = F.sum("records").over(_window("path", "part")) - F.col("records")
    end = F.least((F.col("part") + 1) * part_bytes, F.col("stop"))
    parts = confirmed.select("path", "part", "first", end.alias("end"), before.alias("before")).where("first is not null and first < end")
    return parts.repartition(tasks, "path", "part").select("path", "first", "end", "before").mapInArrow(of_parts, f"path string, index long, {schema}")


def _window(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
