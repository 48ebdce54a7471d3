"""Recorded answers and commands: payloads of ``http_response`` and ``subscription`` frames.

An answer's payload has its request's number, the status, headers and the body, all numbers little-endian
and every text behind its length. A command's payload is JSON: the accepted change of subscriptions,
and the frame that was sent for it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import ranks
from .records import FIELDS, MOST_RECORD

#: Bounds of an answer, and headers whose values aren't kept (fixed values).
MOST_HEADERS, MOST_HEADER, MOST_PAYLOAD = 1024, 64 * 1024, MOST_RECORD - FIELDS.itemsize
SENSITIVE, REDACTED = {"authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token"}, "[REDACTED]"
HEADERS = "array<struct<name: string, value: string>>"
ANSWER = f"request_id decimal(20,0), status int, headers {HEADERS}, body binary"
COMMAND = "struct<command: struct<kind: string, symbols: array<string>>, wire: struct<opcode: string, payload: array<int>>>"
#: Bounds of a command (fixed values).
MOST_COMMAND, MOST_SYMBOLS, MOST_SYMBOL, MOST_WIRE = 1 << 20, 4096, 1024, 256 * 1024
_headers = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def answer_payload(request: int, status: int, headers: list[tuple[str, str]], body: bytes) -> bytes:
    """One answer. Values of sensitive headers are replaced before anything is written."""
    if len(headers) > MOST_HEADERS:
        raise ValueError(f"{len(headers)} headers")
    parts = [struct.pack("<QHI", request, status, len(headers))]
    for name, value in headers:
        for text in (name, REDACTED if name.strip().lower() in SENSITIVE else value):
            raw = text.encode()
            if len(raw) > MOST_HEADER:
                raise ValueError(f"a header of {len(raw)} bytes")
            parts += [struct.pack("<I", len(raw)), raw]
    parts += [struct.pack("<I", len(body)), body]
    if sum(map(len, parts)) > MOST_PAYLOAD:
        raise ValueError("an answer is too large for a record")
    return b"".join(parts)


def read_answer(payload: bytes) -> tuple[int, int, list[tuple[str, str]], bytes]:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n > len(payload) - at:
            raise ValueError("an answer is cut off")
        at += n
        return payload[at - n : at]

    def text(most: int) -> bytes:
        (n,) = struct.unpack("<I", take(4))
        if n > most:
            raise ValueError(f"a header of {n} bytes")
        return take(n)

    request, status, n = struct.unpack("<QHI", take(14))
    if n > MOST_HEADERS:
        raise ValueError(f"{n} headers")
    headers = [(text(MOST_HEADER).decode(), text(MOST_HEADER).decode()) for _ in range(n)]
    body = text(len(payload))
    if at != len(payload):
        raise ValueError("bytes behind an answer")
    return request, status, headers, body


def http_answers(frames: DataFrame) -> DataFrame:
    """``request_id``, ``status``, ``headers`` and ``body`` in place of the payload of ``http_response`` frames;
    other frames are left out. A payload that isn't an answer fails."""
    rows = frames.where("opcode = 'http_response'")
    others = [c for c in rows.columns if c != "payload"]
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.select(*others).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            read = [read_answer(p) for p in batch.column(len(others)).to_pylist()]
            request, status, headers, body = zip(*read) if read else ((), (), (), ())
            columns = [
                pa.array([Decimal(x) for x in request], pa.decimal128(20, 0)), pa.array(status, pa.int32()),
                pa.array([[{"name": a, "value": b} for a, b in h] for h in headers], _headers), pa.array(body, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*others, "request_id", "status", "headers", "body"])

    return rows.select(*others, "payload").mapInArrow(run, f"{kept}, {ANSWER}")


def answer_payloads(answers: DataFrame) -> DataFrame:
    """``payload`` in place of an answer's columns."""
    names = ["request_id", "status", "headers", "body"]
    others = [c for c in answers.columns if c not in names]
    kept = "".join(f"`{c}` {t}, " for c, t in answers.select(*others).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[len(others) :]))
            out = [answer_payload(int(r), s, [(h["name"], h["value"]) for h in hs or ()], b or b"") for r, s, hs, b in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(out, pa.binary())], [*others, "payload"])

    typed = answers.select(*others, F.col("request_id").cast("decimal(20,0)"), F.col("status").cast("int"), F.col("headers").cast(HEADERS), F.col("body").cast("binary"))
    return typed.mapInArrow(run, kept + "payload binary")


def command_payload(kind: Column, symbols: Column, opcode: Column, wire: Column) -> Column:
    """The payload of an accepted change: subscribe, unsubscribe or replace; ``wire`` is binary."""
    numbers = F.transform(F.sequence(F.lit(1), F.length(wire)), lambda k: F.conv(F.hex(F.substring(wire, k, F.lit(1))), 16, 10).cast("int"))
    numbers = F.when(F.length(wire) > 0, numbers).otherwise(F.array().cast("array<int>"))
    command = F.struct(kind.alias("kind"), symbols.alias("symbols"))
    return F.to_json(F.struct(command.alias("command"), F.struct(opcode.alias("opcode"), numbers.alias("payload")).alias("wire"))).cast("binary")


def subscription_commands(frames: DataFrame) -> DataFrame:
    """Commands of ``subscription`` frames in place of the payload: ``command``, ``symbols``, ``wire_opcode``, ``wire``
    (binary), and ``valid``: whether kind, opcode and all bounds are as they should be."""
    rows = frames.where("opcode = 'subscription'").withColumn("__c", F.from_json(F.col("payload").cast("string"), COMMAND))
    symbols, numbers = F.col("__c.command.symbols"), F.col("__c.wire.payload")
    wire = F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    sized = F.forall(symbols, lambda s: F.octet_length(s).between(1, MOST_SYMBOL)) & F.forall(numbers, lambda x: x.between(0, 255))
    good = F.col("__c.command.kind").isin("subscribe", "unsubscribe", "replace") & F.col("__c.wire.opcode").isin("text", "binary", "ping") & sized
    good &= (F.size(symbols) <= MOST_SYMBOLS) & (F.size(numbers) <= MOST_WIRE) & (F.octet_length("payload") <= MOST_COMMAND)
    return rows.select(
        *[c for c in frames.columns if c != "payload"], F.col("__c.command.kind").alias("command"), symbols.alias("symbols"),
        F.col("__c.wire.opcode").alias("wire_opcode"), wire.alias("wire"), F.coalesce(good, F.lit(False)).alias("valid"),
    )


def command_mismatches(recorded: DataFrame, prepared: DataFrame, *, order: str = "frame_seq") -> DataFrame:
    """Where a replay would send something else: the n-th command recorded in a session (``session``, order,
    ``wire_opcode``, ``wire``) beside the n-th one prepared, for the n where they differ or one is missing.
    Commands are numbered by blocks, so that a long session is many tasks."""
    sides = []
    for name, df in (("recorded", recorded), ("prepared", prepared)):
        rows = ranks(df.select("session", F.col(order).cast("long").alias("__at"), F.struct("wire_opcode", "wire").alias(name)), ["session"], "__at")
        sides.append(rows.select("session", F.col("__rank").alias("n"), name))
    both = sides[0].join(sides[1], ["session", "n"], "full")
    return both.where(~F.col("recorded").eqNullSafe(F.col("prepared"))).select("session", "n", "recorded", "prepared")
