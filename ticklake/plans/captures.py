"""Queries that write capture files of the tape and read them again, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import records, replies, sinks, wire
from ..sources.events import tape_rows
from ..sources.framing import PART
from ..sources.scratch import work_folder
from ..sources.tables import read_table, tape
from .catalog import query

#: Small files and parts of a tape of so many events, so that every scale has many of both. They grow with the tape: their number doesn't.
FILE_BYTES, PART_BYTES, EVENTS = 256 << 10, 96 << 10, 100_000
METADATA = '{"kind":"build","package_name":"ticklake"}', '{"kind":"session","session_id":1}'


def _frames(rows: DataFrame, opcode: str, payload: Column) -> DataFrame:
    return rows.select(
        F.pmod("event_id", F.lit(7)).alias("session"), F.col("event_id").alias("frame_seq"), F.col("exchange_ts_ns").alias("receive_ts_ns"), F.col("event_id").alias("monotonic_ns"),
        F.when(F.col("event_id") % 5 == 0, "outbound").otherwise("inbound").alias("direction"), F.lit(opcode).alias("opcode"), F.pmod("event_id", F.lit(2)).cast("int").alias("flags"), payload.cast("binary").alias("payload"),
    )


def _layout(spark, sf_dir) -> tuple[int, int]:
    """Bytes of a file and of a part."""
    times = max(1, read_table(spark, sf_dir, "events").count() // EVENTS)
    return FILE_BYTES * times, min(PART, PART_BYTES * times)


def _recorded(spark, sf_dir, frames: DataFrame, name: str, **options) -> DataFrame:
    folder, (file_bytes, part_bytes) = work_folder(spark, name), _layout(spark, sf_dir)
    sinks.write_segments(frames, folder, file_bytes=file_bytes, **options)
    return records.read_segments(spark, folder, part_bytes=part_bytes)


def _payload() -> Column:
    return F.concat_ws(" ", "kind", "venue", F.col("price").cast("decimal(18,2)").cast("string"), "aggressor")


@query("session:l frame_seq:l receive_ts_ns:l monotonic_ns:l direction opcode flags:l payload",
       sql="q as (select event_id % 7 as session, event_id as frame_seq, exchange_ts_ns as receive_ts_ns, event_id as monotonic_ns, case when event_id % 5 = 0 then 'outbound' else 'inbound' end as direction, 'text' as opcode, event_id % 2 as flags, concat_ws(' ', kind, venue, price::decimal(18,2)::varchar, aggressor) as payload from tape)")
def recorded_frames(spark, sf_dir):
    got = _recorded(spark, sf_dir, _frames(tape(spark, sf_dir), "text", _payload()), "frames", metadata=METADATA)
    return got.where("opcode <> 'metadata'").withColumn("payload", F.col("payload").cast("string"))


@query("session:l frames:l bytes:l first:l last:l",
       sql="q as (select event_id % 7 as session, count(*) as frames, sum(strlen(concat_ws(' ', kind, venue, price::decimal(18,2)::varchar, aggressor))) as bytes, min(event_id) as first, max(event_id) as last from tape where event_id % 5 > 0 group by 1)")
def replayed_sessions(spark, sf_dir):
    """What a replay of the capture would feed to each session."""
    frames = _frames(tape(spark, sf_dir), "text", _payload())
    got = records.replayable(_recorded(spark, sf_dir, frames, "replay", file_ns=3_600_000_000_000, metadata=METADATA))
    return got.groupBy("session").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.length("payload")).alias("bytes"), F.min("frame_seq").alias("first"), F.max("frame_seq").alias("last"))


def _fixed(value: Column, scale: int) -> Column:
    whole = (value * 10**scale).cast("decimal(20,0)")
    part = F.struct(whole.alias("coefficient_lo"), F.lit(0).cast("long").alias("coefficient_hi"), F.lit(scale).alias("scale"))
    return F.struct(part.alias("value"))


def envelopes(rows: DataFrame) -> DataFrame:
    """Envelopes of tape rows: trades, and quotes one unit wide. Fields that these lack aren't there."""
    trade = F.struct(_fixed(F.col("price"), 2).alias("price"), _fixed(F.col("quantity"), 0).alias("quantity"), F.concat(F.lit("AGGRESSOR_SIDE_"), F.upper("aggressor")).alias("aggressor"), F.col("event_id").cast("string").alias("trade_id"))
    quote = F.struct(_fixed(F.col("price"), 2).alias("bid_price"), _fixed(F.col("quantity"), 0).alias("bid_quantity"), _fixed(F.col("price") + 1, 2).alias("ask_price"))
    is_trade = F.col("kind") == "trade"
    payload = F.struct(F.when(is_trade, trade).alias("trade"), F.when(~is_trade, quote).alias("quote"))
    time = lambda c: F.struct(F.col(c).alias("ns"))
    return rows.select(
        F.lit(1).alias("schema_version"), F.substring("venue", 2, 9).cast("int").alias("venue_id"), F.col("instrument").alias("instrument_id"), F.lit(1).cast("long").alias("connection_id"), F.lit(2).cast("long").alias("session_id"),
        F.col("event_id").alias("frame_seq"), F.lit(0).alias("event_index"), time("exchange_ts_ns").alias("exchange_ts"), time("exchange_ts_ns").alias("receive_ts"),
        F.struct(F.col("event_id").alias("first"), F.col("event_id").alias("last")).alias("source_sequence"), F.lit(0).alias("flags"), payload.alias("payload"),
    )


@query("frame_seq:l kind venue:l instrument:l price:d quantity:d aggressor trade_id bid_price:d bid_quantity:d ask_price:d exchange_ts_ns:l first:l",
       sql="""q as (select event_id as frame_seq, kind, substr(venue, 2)::bigint as venue, instrument, case kind when 'trade' then price end as price, case kind when 'trade' then quantity end as quantity, case kind when 'trade' then aggressor end as aggressor,
  case kind when 'trade' then event_id::varchar end as trade_id, case kind when 'quote' then price end as bid_price, case kind when 'quote' then quantity end as bid_quantity, case kind when 'quote' then price + 1 end as ask_price, exchange_ts_ns, event_id as first from tape)""")  # fmt: skip
def protobuf_tape(spark, sf_dir):
    folder, (file_bytes, part_bytes) = work_folder(spark, "protobuf"), _layout(spark, sf_dir)
    sinks.write_length_prefixed(wire.to_protobuf(envelopes(tape(spark, sf_dir))), folder, file_bytes=file_bytes)
    got = wire.from_protobuf(records.read_protobuf_records(spark, folder, part_bytes=part_bytes).drop("path", "index"), kinds=("trade", "quote"))
    return tape_rows(got.withColumn("event_index", F.col("source_sequence.first"))).withColumnRenamed("event_index", "first")


@query("venue_id:l kind events:l value:d", sql="q as (select substr(venue, 2)::bigint as venue_id, kind, count(*) as events, sum(price * quantity) as value from tape group by 1, 2)")
def length_prefixed_tape(spark, sf_dir):
    folder, (file_bytes, part_bytes) = work_folder(spark, "prefixed"), _layout(spark, sf_dir)
    events = envelopes(tape(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("value"))
    sinks.write_length_prefixed(events, folder, file_bytes=file_bytes)
    from ..sources.events import parse_events

    got = tape_rows(parse_events(records.read_length_prefixed(spark, folder, part_bytes=part_bytes).select("value")))
    return got.groupBy(F.col("venue").alias("venue_id"), "kind").agg(F.count(F.lit(1)).alias("events"), F.sum(F.coalesce("price", "bid_price") * F.coalesce("quantity", "bid_quantity")).alias("value"))


@query("frame_seq:l request_id:l status:l headers:l cookie length body",
       sql="q as (select event_id as frame_seq, event_id * 3 as request_id, case when event_id % 4 = 0 then 404 else 200 end as status, 2 + event_id % 2 as headers, case when event_id % 2 = 1 then '[REDACTED]' end as cookie, length(kind)::varchar as length, concat_ws(' ', kind, venue, price::decimal(18,2)::varchar, aggressor) as body from tape)")
def http_answers(spark, sf_dir):
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    base = [header("Content-Type", F.lit("text/plain")), header("X-Length", F.length("kind").cast("string"))]
    odd = F.col("event_id") % 2 == 1
    rows = tape(spark, sf_dir).withColumns({"request_id": F.col("event_id") * 3, "status": F.when(F.col("event_id") % 4 == 0, 404).otherwise(200), "headers": F.when(odd, F.array(*base, header("Set-Cookie", F.lit("secret")))).otherwise(F.array(*base)), "body": _payload()})
    frames = _frames(replies.answer_payloads(rows), "http_response", F.col("payload"))
    got = replies.http_answers(_recorded(spark, sf_dir, frames, "answers"))
    value = lambda name: F.filter("headers", lambda h: h["name"] == name)[0]["value"]
    return got.select("frame_seq", "request_id", "status", F.size("headers").alias("headers"), F.get(F.filter("headers", lambda h: h["name"] == "Set-Cookie"), 0)["value"].alias("cookie"), value("X-Length").alias("length"), F.col("body").cast("string").alias("body"))


@query("session:l n:l recorded prepared",
       sql="""c as (select event_id % 7 as session, event_id, row_number() over (partition by event_id % 7 order by event_id) as n, 'sub ' || venue as recorded, case when event_id % 11 = 0 then 'sub other' when event_id % 13 = 0 then 'sub ' || venue || ' again' else 'sub ' || venue end as prepared, event_id % 5 = 0 as missing from tape where kind = 'trade'),
  p as (select session, prepared, row_number() over (partition by session order by event_id) as n from c where not (missing and event_id > 500)),
  q as (select coalesce(c.session, p.session) as session, coalesce(c.n, p.n) as n, recorded, p.prepared from c full join p on c.session = p.session and c.n = p.n where recorded is distinct from p.prepared)""")  # fmt: skip
def command_mismatches(spark, sf_dir):
    """Commands of a capture that a replay would send in another form, or not at all."""
    e = F.col("event_id")
    said = F.concat(F.lit("sub "), F.col("venue"))
    rows = tape(spark, sf_dir).where("kind = 'trade'").withColumn("wire", said.cast("binary"))
    frames = _frames(rows, "subscription", replies.command_payload(F.lit("subscribe"), F.array("venue"), F.lit("text"), F.col("wire")))
    recorded = replies.subscription_commands(_recorded(spark, sf_dir, frames, "commands")).where("valid")
    now = F.when(e % 11 == 0, "sub other").when(e % 13 == 0, F.concat(said, F.lit(" again"))).otherwise(said)
    prepared = rows.where(~((e % 5 == 0) & (e > 500))).select(F.pmod("event_id", F.lit(7)).alias("session"), e.alias("frame_seq"), F.lit("text").alias("wire_opcode"), now.cast("binary").alias("wire"))
    got = replies.command_mismatches(recorded.withColumn("session", F.col("session").cast("long")), prepared)
    return got.select("session", "n", F.col("recorded.wire").cast("string").alias("recorded"), F.col("prepared.wire").cast("string").alias("prepared"))
