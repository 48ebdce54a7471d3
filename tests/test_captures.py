"""Record files: splittable reading, the sink, the wire format, answers and commands."""

from __future__ import annotations

import json
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticklake.sources import events, framing, records, replies, sinks, wire


def fields(r) -> tuple:
    return int(r.session), int(r.frame_seq), r.receive_ts_ns, int(r.monotonic_ns), r.direction, r.opcode, r["flags"], bytes(r.payload)


def read(spark, path, part_bytes=64 << 20) -> list[tuple]:
    return [(r.path.rsplit("/", 1)[1], r["index"], *fields(r)) for r in records.read_segments(spark, str(path), part_bytes=part_bytes).orderBy("path", "index").collect()]


# checksums


def test_checksums_side_by_side():
    rnd = random.Random(3)

    def plain(data: bytes) -> int:
        state = 0xFFFFFFFF
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = state >> 1 ^ (0x82F63B78 if state & 1 else 0)
        return state ^ 0xFFFFFFFF

    parts = [rnd.randbytes(rnd.choice([0, 1, 5, 127, 128, 129, 255, 256, 257, 1000, rnd.randrange(3000)])) for _ in range(120)]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    got = records.crc32c_of(np.frombuffer(b"".join(parts), np.uint8), starts, np.array(list(map(len, parts))))
    assert got.tolist() == [plain(p) for p in parts]
    assert records.crc32c(b"123456789") == 0xE3069283
    assert len(records.crc32c_of(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


# reading by parts


ROWS = [(7, 2**63 + 1, 10, 5, "inbound", "text", 0, b'{"a":1}'), (7, 2, 11, 6, "outbound", "ping", 1, b""), (7, 3, 12, 7, "inbound", "subscription", 0, b"x" * 5000)]


def test_segments(spark, tmp_path):
    data = records.write_segment(ROWS)
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(data[:-10])  # cut off by a crash
    (tmp_path / "c.bin").write_bytes(records.write_segment([]))
    (tmp_path / "d.bin").write_bytes(b"")
    for part_bytes in (64 << 20, 100, 7):
        assert read(spark, tmp_path, part_bytes) == [("a.bin", k, *r) for k, r in enumerate(ROWS)] + [("b.bin", k, *r) for k, r in enumerate(ROWS[:2])]
    assert records.replayable(records.read_segments(spark, str(tmp_path))).count() == 3


@pytest.mark.parametrize(("data", "said"), [
    (records.write_segment(ROWS)[:-1] + b"!", "checksum"), (records.write_segment(ROWS, version=1), "header"), (b"none", "not a capture"), (records.write_segment(ROWS, version=9), "version 9"),
    (records.write_segment(ROWS[:1]) + struct.pack("<I", 3) + b"x" * 60, "record of 3"),
])
def test_damaged_segments(spark, tmp_path, data, said):
    (tmp_path / "a.bin").write_bytes(data)
    for part_bytes in (64 << 20, 120):
        with pytest.raises(Exception, match=said):
            records.read_segments(spark, str(tmp_path), part_bytes=part_bytes).collect()


def test_records_inside_records(spark, tmp_path, monkeypatch):
    """A payload that holds records misleads the parts that begin in it; the chain of parts finds out."""
    inner = records.write_segment([(1, i, 2, 3, "inbound", "text", 0, b"inner%d" % i) for i in range(30)])[records.HEADER.size :]
    rows = [(7, i, i, 5, "inbound", "text", 0, inner if i % 4 == 0 else b"outer" * (i % 60)) for i in range(120)]
    (tmp_path / "a.bin").write_bytes(records.write_segment(rows))
    assert read(spark, tmp_path, 1500) == [("a.bin", k, *r) for k, r in enumerate(rows)]
    monkeypatch.setattr(framing, "WINDOW", 500)
    for part_bytes in (701, 6000):
        assert read(spark, tmp_path, part_bytes) == [("a.bin", k, *r) for k, r in enumerate(rows)]


def test_one_file_is_many_tasks(spark, tmp_path):
    rows = [(1, i, i, i, "inbound", "text", 0, b"x" * 100) for i in range(20_000)]
    (tmp_path / "a.bin").write_bytes(records.write_segment(rows))
    df = records.read_segments(spark, str(tmp_path), part_bytes=100_000)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 10 and max(sizes) < 5000


def test_other_record_files(spark, tmp_path):
    rnd = random.Random(1)
    parts = [json.dumps({"n": i, "x": "y" * rnd.randrange(400)}).encode() for i in range(200)] + [b"{}", b""]
    (tmp_path / "x.rec").write_bytes(b"".join(struct.pack("<I", len(p)) + p for p in parts))
    (tmp_path / "x.wal").write_bytes(records.SPILL_MAGIC + b"".join(struct.pack("<BI", 1 + i % 3, len(p)) + p for i, p in enumerate(parts)) + b"\x01\xff\x00")
    for part_bytes in (64 << 20, 900):
        got = records.read_length_prefixed(spark, str(tmp_path / "x.rec"), part_bytes=part_bytes).orderBy("index").collect()
        assert [r.value.encode() for r in got] == parts and [r["index"] for r in got] == list(range(202))
        got = records.read_spill(spark, str(tmp_path / "x.wal"), part_bytes=part_bytes).orderBy("index").collect()
        assert [(r.tag, r.value.encode()) for r in got] == [(1 + i % 3, p) for i, p in enumerate(parts)]
    (tmp_path / "cut.rec").write_bytes(b"\x05\0\0\0ab")
    with pytest.raises(Exception, match="truncated"):
        records.read_length_prefixed(spark, str(tmp_path / "cut.rec")).collect()


def test_whole_files_of_other_stores(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(records.write_segment(ROWS))
    monkeypatch.setattr(framing, "OPENED", set())
    assert [fields(r) for r in records.read_segments(spark, f"file://{tmp_path}").orderBy("index").collect()] == ROWS


def test_listing(spark, tmp_path):
    for name in ("b.jsonl", "a.mfne", "c.txt"):
        (tmp_path / name).write_text("x")
    assert [(r.name, r["bytes"]) for r in records.list_captures(spark, str(tmp_path)).collect()] == [("a.mfne", 1), ("b.jsonl", 1)]


# the sink


@pytest.fixture
def frames(spark):
    n = F.col("id")
    return spark.range(3000).repartition(3).select(
        F.lit(5).alias("session"), n.alias("frame_seq"), (n * 1000).alias("receive_ts_ns"), n.alias("monotonic_ns"), F.lit("inbound").alias("direction"), F.lit("text").alias("opcode"), F.lit(0).alias("flags"),
        F.repeat(F.lit("z"), (n % 90).cast("int")).cast("binary").alias("payload"),
    )


def test_segments_rotate_by_size_and_repeat_metadata(spark, frames, tmp_path):
    told = ('{"kind":"build"}', '{"kind":"session","session_id":5}')
    sinks.write_segments(frames, f"{tmp_path}/out", file_bytes=20_000, metadata=told)
    sizes = [os.path.getsize(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out")]
    assert len(sizes) > 10 and sum(20_000 <= s < 20_200 for s in sizes) >= len(sizes) - 3 and max(sizes) < 20_200
    back = records.read_segments(spark, f"{tmp_path}/out", part_bytes=7000)
    meta = back.where("opcode = 'metadata'")
    assert meta.count() == 2 * len(sizes) and {bytes(r.payload).decode() for r in meta.collect()} == set(told)
    assert records.segment_conflicts(back).count() == 0
    data = back.where("opcode <> 'metadata'")
    assert sorted(map(fields, data.collect())) == sorted(map(fields, frames.select(data.columns[2:]).collect()))
    odd = back.withColumn("payload", F.when((F.col("index") == 0) & (F.length("path") % 2 == 0), F.lit('{"kind":"build","x":1}').cast("binary")).otherwise(F.col("payload")))
    assert records.segment_conflicts(odd).count() <= 1


def test_segments_rotate_by_time(spark, frames, tmp_path):
    sinks.write_segments(frames.coalesce(1).sortWithinPartitions("frame_seq"), f"{tmp_path}/out", file_ns=500_000)
    spans = records.read_segments(spark, f"{tmp_path}/out").groupBy("path").agg(F.min("frame_seq").cast("long").alias("a"), F.max("frame_seq").cast("long").alias("b")).orderBy("a").collect()
    assert [(r.a, r.b) for r in spans] == [(k * 500, k * 500 + 499) for k in range(6)]


@pytest.mark.parametrize("bound", [{"most_records": 2999}, {"most_records": 10}, {"most_bytes": 8999}, {"most_bytes": 7}])
def test_a_write_beyond_its_bounds_leaves_nothing(spark, frames, tmp_path, bound):
    """One task passes them, or only all together."""
    with pytest.raises(Exception, match="more than"):
        sinks.write_lines(frames.select(F.lit("ab").alias("value")), f"{tmp_path}/out", **bound)
    # a task that is killed after the driver has cleaned up may leave a hidden file, which no reader takes
    assert not (tmp_path / "out").exists() or [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")] == []
    sinks.write_lines(frames.select(F.lit("ab").alias("value")), f"{tmp_path}/out", most_records=3000, most_bytes=9000)
    assert spark.read.text(f"{tmp_path}/out").groupBy("value").count().collect() == [("ab", 3000)]


def test_length_prefixed_files(spark, frames, tmp_path):
    rows = frames.select(F.concat(F.lit("{"), F.col("payload").cast("string")).alias("value"))
    sinks.write_length_prefixed(rows, f"{tmp_path}/out", file_bytes=9000)
    got = records.read_length_prefixed(spark, f"{tmp_path}/out", part_bytes=2000)
    assert sorted(r.value for r in got.collect()) == sorted(r.value for r in rows.collect()) and len(os.listdir(tmp_path / "out")) > 10
    sinks.write_length_prefixed(rows.where("false"), f"{tmp_path}/none")
    with pytest.raises(Exception, match="can't write"):
        sinks.write_lines(rows, "viewfs://x/y")


# the wire format


def envelope(rnd, i: int, kind: str) -> dict:
    maybe = lambda x: rnd.choice([None, x])
    fixed = lambda: {"value": {"coefficient_lo": rnd.choice([0, 5, -7, 2**63 - 1, -(2**63), 123456]), "coefficient_hi": rnd.choice([0, -1, 3]), "scale": rnd.randrange(19)}}
    level = lambda: {"price": fixed(), "quantity": fixed()}
    change = lambda: {"side": rnd.choice(["BOOK_SIDE_BID", "BOOK_SIDE_ASK"]), "operation": rnd.choice(["BOOK_OPERATION_UPSERT", "BOOK_OPERATION_DELETE"]), "price": fixed(), "quantity": maybe(fixed())}
    payload = {
        "trade": lambda: {**level(), "aggressor": rnd.choice(wire.SIDES), "trade_id": maybe("é%d" % i)},
        "quote": lambda: {"bid_price": fixed(), "bid_quantity": maybe(fixed()), "ask_price": fixed(), "ask_quantity": maybe(fixed())},
        "book_snapshot": lambda: {"bids": [level() for _ in range(rnd.randrange(4))], "asks": [level() for _ in range(rnd.randrange(30))], "depth": maybe(7), "checksum": maybe("c")},
        "book_delta": lambda: {"changes": [change() for _ in range(rnd.randrange(4))], "checksum": maybe("x")},
        "candle": lambda: {**{n: fixed() for n in ("open", "high", "low", "close", "volume")}, "interval_ns": 60, "start_ts": {"ns": -5}},
        "funding": lambda: {"rate": fixed(), "next_funding_ts": maybe({"ns": 9})}, "open_interest": lambda: {"quantity": fixed()}, "liquidation": lambda: {**level(), "side": wire.SIDES[1]},
        "statistics_24h": lambda: {n: maybe(fixed()) for n in ("open", "high", "low", "close", "volume", "quote_volume")}, "instrument_update": lambda: {"status": "Halted"}, "venue_status": lambda: {"message": ""},
    }.get(kind, lambda: {"price": fixed()})()
    return {
        "schema_version": 1, "venue_id": rnd.randrange(3), "instrument_id": maybe(3), "connection_id": 2**40, "session_id": 0, "frame_seq": i, "event_index": 0, "exchange_ts": maybe({"ns": 0}),
        "receive_ts": {"ns": -i}, "source_sequence": maybe({"first": 1, "last": 2**62}), "flags": rnd.randrange(3), "payload": {kind: payload},
    }


def some_envelopes(n: int) -> list[dict]:
    rnd = random.Random(n)
    kinds = [f.name for f in wire.PAYLOAD.values()]
    return [envelope(rnd, i, kinds[i % len(kinds)]) for i in range(n)]


def test_wire_round_trip():
    rows = pa.array(some_envelopes(1300), wire.arrow_type(wire.ENVELOPE_FIELDS))
    raw = wire.write_envelopes(rows)
    assert wire.read_envelopes(raw).to_pylist() == rows.to_pylist()
    part = rows.slice(130, 57)
    assert wire.read_envelopes(wire.write_envelopes(part)).to_pylist() == part.to_pylist() == wire.read_envelopes(raw.slice(130, 57)).to_pylist()
    nothing = wire.read_envelopes(pa.array([None, b""], pa.binary())).to_pylist()
    assert nothing[0] is None and nothing[1]["schema_version"] == 0 and nothing[1]["payload"] is None and nothing[1]["instrument_id"] is None


def test_wire_bytes():
    """Bytes worked out by hand: numbers seven bits at a time, texts and messages behind their length."""
    one = {"schema_version": 1, "venue_id": 300, "receive_ts": {"ns": 5}, "payload": {"venue_status": {"message": "up"}}}
    raw = wire.write_envelopes(pa.array([one], wire.arrow_type(wire.ENVELOPE_FIELDS)))[0].as_py()
    assert raw == bytes([0x08, 1, 0x10, 0xAC, 0x02, 0x4A, 2, 0x08, 5, 0x62, 6, 0x6A, 4, 0x0A, 2]) + b"up"
    extra = bytes([0xA0, 0x06, 7, 0xAD, 0x06, 1, 2, 3, 4, 0xB1, 0x06, 1, 2, 3, 4, 5, 6, 7, 8, 0xBA, 0x06, 2, 9, 9, 0x10, 4])  # unknown fields of every wire type, then a venue again
    again = wire.read_envelopes(pa.array([raw + extra], pa.binary()))[0].as_py()
    assert (again["venue_id"], again["payload"]["venue_status"]["message"]) == (4, "up")
    negative = {"receive_ts": {"ns": -1}}
    raw = wire.write_envelopes(pa.array([negative], wire.arrow_type(wire.ENVELOPE_FIELDS)))[0].as_py()
    assert raw == bytes([0x4A, 11, 0x08, *[0xFF] * 9, 1])
    for bad, said in ((b"\x0b", "wire type"), (b"\x4a\x05\x08", "beyond"), (b"\x08" + b"\xff" * 11, "ten bytes")):
        with pytest.raises(ValueError, match=said):
            wire.read_envelopes(pa.array([bad], pa.binary()))


def test_wire_equals_json(spark, tmp_path):
    """The same envelopes as JSON lines and as records of the wire format are the same rows."""
    bare = lambda x: {k: bare(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [bare(v) for v in x] if isinstance(x, list) else x
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps(bare(x)) for x in some_envelopes(260)))
    lines = events.read_events(spark, str(tmp_path / "e.jsonl"))
    sinks.write_length_prefixed(wire.to_protobuf(lines), f"{tmp_path}/pb", file_bytes=3000)
    back = wire.from_protobuf(records.read_protobuf_records(spark, f"{tmp_path}/pb", part_bytes=1000).drop("path", "index"))
    assert back.columns == lines.columns and sorted(map(repr, back.collect())) == sorted(map(repr, lines.collect()))


def test_missing_parts_are_null(spark):
    df = spark.createDataFrame([(1, ((5,),))], "frame_seq long, payload struct<mark_price: struct<price: int>>").select("frame_seq", F.struct(F.struct(F.lit("up").alias("message")).alias("venue_status")).alias("payload"))
    got = wire.conforming(df).first()
    assert got.frame_seq == 1 and got.payload.venue_status.message == "up" and got.payload.trade is None and got.schema_version is None


# answers and commands


def test_answers(spark):
    payload = replies.answer_payload(2**64 - 1, 200, [("Content-Type", "a"), (" AUTHORIZATION ", "secret"), ("é", "")], b"\x00body")
    assert replies.read_answer(payload) == (2**64 - 1, 200, [("Content-Type", "a"), (" AUTHORIZATION ", "[REDACTED]"), ("é", "")], b"\x00body")
    frames = spark.createDataFrame([(1, "http_response", payload), (2, "text", b"x")], "id int, opcode string, payload binary")
    got = replies.http_answers(frames)
    r = got.first()
    assert (got.count(), int(r.request_id), r.status, bytes(r.body), r.headers[1].value) == (1, 2**64 - 1, 200, b"\x00body", "[REDACTED]")
    assert bytes(replies.answer_payloads(got).first().payload) == payload
    for bad, said in ((payload[:-1], "cut off"), (payload + b"x", "behind"), (b"", "cut off"), (struct.pack("<QHI", 1, 200, 1025), "headers"), (struct.pack("<QHII", 1, 200, 1, 70_000), "header of")):
        with pytest.raises(ValueError, match=said):
            replies.read_answer(bad)
    with pytest.raises(ValueError, match="header of"):
        replies.answer_payload(1, 200, [("n", "v" * 70_000)], b"")
    with pytest.raises(ValueError, match="too large"):
        replies.answer_payload(1, 200, [], bytes(16 << 20))


def test_commands(spark):
    rows = spark.createDataFrame([(1, "subscribe", ["a", "b"], "text", b'{"x":1}'), (2, "replace", [], "binary", b"\x00\xff"), (3, "stop", ["a"], "text", b""), (4, "unsubscribe", [""], "ping", b"")], "frame_seq long, kind string, symbols array<string>, op string, wire binary")
    frames = rows.select("frame_seq", F.lit(1).alias("session"), F.lit("subscription").alias("opcode"), replies.command_payload(F.col("kind"), F.col("symbols"), F.col("op"), F.col("wire")).alias("payload"))
    got = {r.frame_seq: (r.command, r.symbols, r.wire_opcode, bytes(r.wire), r.valid) for r in replies.subscription_commands(frames).collect()}
    assert got == {1: ("subscribe", ["a", "b"], "text", b'{"x":1}', True), 2: ("replace", [], "binary", b"\x00\xff", True), 3: ("stop", ["a"], "text", b"", False), 4: ("unsubscribe", [""], "ping", b"", False)}
    broken = spark.createDataFrame([(1, 1, "subscription", b"{")], "frame_seq long, session int, opcode string, payload binary")
    assert replies.subscription_commands(broken).first().valid is False
    kinds = "session int, frame_seq long, wire_opcode string, wire binary"
    recorded = spark.createDataFrame([(1, 10, "text", b"a"), (1, 20, "text", b"b"), (1, 30, "text", b"c"), (2, 5, "text", b"a")], kinds)
    prepared = spark.createDataFrame([(1, 1, "text", b"a"), (1, 2, "binary", b"b"), (2, 1, "text", b"a"), (2, 2, "text", b"x")], kinds)
    found = {(r.session, r.n): (r.recorded and bytes(r.recorded.wire), r.prepared and bytes(r.prepared.wire)) for r in replies.command_mismatches(recorded, prepared).collect()}
    assert found == {(1, 2): (b"b", b"b"), (1, 3): (b"c", None), (2, 2): (None, b"x")}
