"""Binary record files: raw capture segments, length-prefixed bodies and spill logs.

All are read by parts (``framing``), so one large file keeps many tasks busy. Fields of a part's records are cut
out of its bytes as columns; checksums of all payloads are computed side by side.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .framing import PART, Framing, little, read_framed

#: Layout of a capture segment and of the other record files (fixed values).
SEGMENT_MAGIC, SEGMENT_VERSIONS = b"MFR1", (1, 3)
SPILL_MAGIC = b"MFSPILL2\n"
HEADER = struct.Struct("<4sHqQ")
RECORD = struct.Struct("<QQqQBBBII")
FIELDS = np.dtype([("size", "<u4"), ("session", "<u8"), ("frame_seq", "<u8"), ("receive", "<i8"), ("monotonic", "<u8"), ("direction", "u1"), ("opcode", "u1"), ("flags", "u1"), ("length", "<u4"), ("crc", "<u4")])
DIRECTIONS = {0: "inbound", 1: "outbound"}
OPCODES = {1: ("text", 1), 2: ("binary", 1), 3: ("ping", 1), 4: ("pong", 1), 5: ("close", 1), 6: ("http_response", 2), 7: ("metadata", 2), 8: ("subscription", 3)}
MOST_RECORD = 16 << 20
U64 = "decimal(20,0)"
RECORD_COLUMNS = f"session {U64}, frame_seq {U64}, receive_ts_ns long, monotonic_ns {U64}, direction string, opcode string, flags int, payload binary"

#: Reversed Castagnoli polynomial (fixed value); the tables follow from it.
_POLYNOMIAL = 0x82F63B78
_BLOCK = 128


def _byte_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = state >> np.uint32(1) ^ np.where(state & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return state


_TABLE = _byte_table()


def _shift(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """A register behind so many zero bytes, by four tables of 256."""
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


def _shift_tables(doublings: int) -> list[np.ndarray]:
    """Tables for 1, 2, 4, ... zero bytes."""
    states = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    out = [_TABLE[states & 255] ^ states >> np.uint32(8)]
    for _ in range(doublings):
        out.append(_shift(out[-1], out[-1]))
    return out


_ZEROS = _shift_tables(31)


def crc32c_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of many stretches of bytes. Each is cut into blocks, the first filled with zeros on its left;
    registers of all blocks run side by side, then each stretch's blocks are put together."""
    blocks = np.maximum(1, -(-lengths // _BLOCK))
    of = np.repeat(np.arange(len(starts)), blocks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (starts + lengths)[of] - (blocks[of] - nth) * _BLOCK  # the last block ends where the stretch does
    padded = np.concatenate([np.zeros(_BLOCK, np.uint8), data])
    state = np.zeros(len(of), np.uint32)
    for k in range(_BLOCK):
        at = begin + k
        byte = np.where(at >= starts[of], padded[at + _BLOCK], 0)
        state = state >> np.uint32(8) ^ _TABLE[(state ^ byte) & 255]
    behind, level = blocks[of] - 1 - nth, _BLOCK.bit_length() - 1
    while len(state) > len(starts):  # blocks in pairs: the left one moves behind as many zeros, and meets the right one
        odd = behind % 2 == 1
        left = np.flatnonzero(odd)
        state[left + 1] ^= _shift(state[left], _ZEROS[level])
        state, behind, level = state[~odd], behind[~odd] // 2, level + 1
    ones = np.full(len(starts), 0xFFFFFFFF, np.uint32)  # the register's first value, behind as many bytes
    for bit, tables in enumerate(_ZEROS):
        on = (lengths >> bit & 1).astype(bool)
        ones[on] = _shift(ones[on], tables)
    return state ^ ones ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    return int(crc32c_of(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)]))[0])


def bodies(data: bytes, starts: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Stretches of bytes as a column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    out = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.frombuffer(data, np.uint8)[place])])
    return out.cast(pa.large_string()).cast(kind) if kind == pa.string() else out.cast(kind)


class Segments(Framing):
    """Capture segments: a head with the version, then records with their own size, a head and a checksum."""

    head, least, torn = HEADER.size, FIELDS.itemsize, True
    columns = dict(zip((c.split()[0] for c in RECORD_COLUMNS.split(", ")), (pa.decimal128(20, 0), pa.decimal128(20, 0), pa.int64(), pa.decimal128(20, 0), pa.string(), pa.string(), pa.int32(), pa.binary())))

    def begin(self, data: bytes) -> None:
        if len(data) < HEADER.size or data[:4] != SEGMENT_MAGIC:
            raise ValueError("not a capture segment")
        version = HEADER.unpack_from(data)[1]
        if not SEGMENT_VERSIONS[0] <= version <= SEGMENT_VERSIONS[1]:
            raise ValueError(f"segment version {version} isn't supported")

    def size(self, data: bytes, at: int) -> int:
        size = int.from_bytes(data[at : at + 4], "little")
        if not FIELDS.itemsize <= size <= MOST_RECORD:
            raise ValueError(f"record of {size} bytes")
        return size

    def likely(self, data: np.ndarray) -> np.ndarray:
        n = max(0, len(data) - FIELDS.itemsize + 1)
        at = {name: offset for name, (_, offset) in FIELDS.fields.items()}
        right = little(data, 0, n) == little(data, at["length"], n) + FIELDS.itemsize
        return np.flatnonzero(right & (data[at["direction"] :][:n] < 2) & np.isin(data[at["opcode"] :][:n], list(OPCODES)))

    def decode(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, offset: int, head: bytes) -> list[pa.Array]:
        version, raw = HEADER.unpack_from(head)[1], np.frombuffer(data, np.uint8)
        r = np.ascontiguousarray(raw[starts[:, None] + np.arange(FIELDS.itemsize)]).view(FIELDS)[:, 0]
        since = np.array([OPCODES.get(k, ("", 99))[1] for k in range(256)])
        wrong = np.flatnonzero((r["length"] != sizes - FIELDS.itemsize) | (r["direction"] > 1) | (since[r["opcode"]] > version))
        if len(wrong):
            raise ValueError(f"bad record header at {offset + starts[wrong[0]]}")
        begin, lengths = starts + FIELDS.itemsize, r["length"].astype(np.int64)
        wrong = np.flatnonzero(crc32c_of(raw, begin, lengths) != r["crc"])
        if len(wrong):
            raise ValueError(f"checksum mismatch at {offset + starts[wrong[0]]}")
        u64 = lambda name: pa.array(r[name].astype(np.uint64)).cast(pa.decimal128(20, 0))
        named = lambda names, codes: pa.array(names).take(pa.array(codes.astype(np.int64)))
        return [
            u64("session"), u64("frame_seq"), pa.array(r["receive"].astype(np.int64)), u64("monotonic"), named(list(DIRECTIONS.values()), r["direction"]),
            named(["", *(OPCODES[k][0] for k in sorted(OPCODES))], r["opcode"]), pa.array(r["flags"].astype(np.int32)), bodies(data, begin, lengths, pa.binary()),
        ]


class Prefixed(Framing):
    """A length before each body, and nothing else. ``starts_with``: what bodies of this kind begin with."""

    def __init__(self, starts_with: bytes, kind: pa.DataType) -> None:
        self.starts_with, self.columns = starts_with, {"value": kind}

    def size(self, data: bytes, at: int) -> int:
        return 4 + int.from_bytes(data[at : at + 4], "little")

    def likely(self, data: np.ndarray) -> np.ndarray:
        n = max(0, len(data) - 4)
        return np.flatnonzero((little(data, 0, n) < MOST_RECORD) & np.isin(data[4:], list(self.starts_with)))

    def decode(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, offset: int, head: bytes) -> list[pa.Array]:
        return [bodies(data, starts + 4, sizes - 4, self.columns["value"])]


class Spill(Framing):
    """Spill logs: a head, then a tag and a length before each JSON text. A torn tail ends it."""

    head, least, torn = len(SPILL_MAGIC), 5, True
    columns = {"tag": pa.int32(), "value": pa.string()}

    def begin(self, data: bytes) -> None:
        if data != SPILL_MAGIC:
            raise ValueError("not a spill log")

    def size(self, data: bytes, at: int) -> int:
        return 5 + int.from_bytes(data[at + 1 : at + 5], "little")

    def likely(self, data: np.ndarray) -> np.ndarray:
        n = max(0, len(data) - 5)
        return np.flatnonzero((little(data, 1, n) < MOST_RECORD) & (data[5:] == ord("{")))

    def decode(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, offset: int, head: bytes) -> list[pa.Array]:
        tags = np.frombuffer(data, np.uint8)[starts].astype(np.int32)
        return [pa.array(tags), bodies(data, starts + 5, sizes - 5, pa.string())]


def write_segment(records: list[tuple], *, version: int = 3, start_ns: int = 0) -> bytes:
    """A segment's bytes from (session, frame_seq, receive ns, monotonic ns, direction, opcode, flags, payload)."""
    return HEADER.pack(SEGMENT_MAGIC, version, start_ns, 0) + b"".join(map(segment_record, records))


def segment_record(record: tuple) -> bytes:
    session, seq, receive, mono, direction, opcode, flags, payload = record
    body = RECORD.pack(session, seq, receive, mono, _WAYS[direction], _CODES[opcode], flags, len(payload), crc32c(payload)) + payload
    return struct.pack("<I", 4 + len(body)) + body


_WAYS, _CODES = {v: k for k, v in DIRECTIONS.items()}, {v[0]: k for k, v in OPCODES.items()}


def read_segments(spark: SparkSession, path: str, *, part_bytes: int = PART) -> DataFrame:
    """Frames of capture segments: ``path``, ``index`` in the file, and the frame's fields. A record that a file's
    end cuts off is left out, as after a crash; any other damage is an error."""
    return read_framed(spark, path, Segments(), RECORD_COLUMNS, part_bytes=part_bytes)


def replayable(frames: DataFrame) -> DataFrame:
    """Inbound data frames, as a replay feeds them."""
    return frames.where("direction = 'inbound' and opcode not in ('ping', 'pong', 'close', 'metadata')")


def read_length_prefixed(spark: SparkSession, path: str, *, part_bytes: int = PART) -> DataFrame:
    """(path, index, value): JSON texts of length-prefixed files. A file that ends within a record is an error."""
    return read_framed(spark, path, Prefixed(b"{", pa.string()), "value string", part_bytes=part_bytes)


def read_protobuf_records(spark: SparkSession, path: str, *, part_bytes: int = PART) -> DataFrame:
    """(path, index, value): bodies of length-prefixed files of envelopes, for ``wire.from_protobuf``."""
    return read_framed(spark, path, Prefixed(b"\x08\x10\x18\x20\x28\x30\x38\x42\x4a", pa.binary()), "value binary", part_bytes=part_bytes)


def read_spill(spark: SparkSession, path: str, *, part_bytes: int = PART) -> DataFrame:
    """(path, index, tag, value) of spill logs."""
    return read_framed(spark, path, Spill(), "tag int, value string", part_bytes=part_bytes)


def list_captures(spark: SparkSession, path: str) -> DataFrame:
    """Event files that can be replayed, by name: ``name``, ``path``, ``bytes``, ``modified``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jsonl,mfne}").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy("name", "path")


def segment_conflicts(frames: DataFrame) -> DataFrame:
    """Metadata kinds that differ between the copies that segments repeat."""
    meta = frames.where("opcode = 'metadata'").select(F.get_json_object(F.col("payload").cast("string"), "$.kind").alias("kind"), "session", "payload")
    return meta.groupBy("kind", "session").agg(F.count_distinct("payload").alias("versions")).where("versions > 1")
