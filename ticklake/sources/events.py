"""Normalized events as JSON lines: reader, tape rows, paging and writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.decimals import from_parts, parse_decimal
from ..functions.scalars import notional

_FIXED = "struct<value: struct<coefficient_lo: decimal(20,0), coefficient_hi: bigint, scale: int>>"
_LEVELS = f"array<struct<price: {_FIXED}, quantity: {_FIXED}>>"
_PRICE = f"struct<price: {_FIXED}>"
#: Names of the envelope and its payloads (fixed values).
ENVELOPE = f"""
schema_version int, venue_id int, instrument_id int, connection_id bigint, session_id bigint, frame_seq bigint, event_index int,
exchange_ts struct<ns: bigint>, receive_ts struct<ns: bigint>, source_sequence struct<first: bigint, last: bigint>, flags int,
payload struct<
  trade: struct<price: {_FIXED}, quantity: {_FIXED}, aggressor: string, trade_id: string>,
  quote: struct<bid_price: {_FIXED}, bid_quantity: {_FIXED}, ask_price: {_FIXED}, ask_quantity: {_FIXED}>,
  book_snapshot: struct<bids: {_LEVELS}, asks: {_LEVELS}, depth: int, checksum: string>,
  book_delta: struct<changes: array<struct<side: string, operation: string, price: {_FIXED}, quantity: {_FIXED}>>, checksum: string>,
  candle: struct<open: {_FIXED}, high: {_FIXED}, low: {_FIXED}, close: {_FIXED}, volume: {_FIXED}, interval_ns: bigint, start_ts: struct<ns: bigint>>,
  mark_price: {_PRICE}, index_price: {_PRICE}, funding: struct<rate: {_FIXED}, next_funding_ts: struct<ns: bigint>>,
  open_interest: struct<quantity: {_FIXED}>, liquidation: struct<price: {_FIXED}, quantity: {_FIXED}, side: string>,
  statistics_24h: struct<open: {_FIXED}, high: {_FIXED}, low: {_FIXED}, close: {_FIXED}, volume: {_FIXED}, quote_volume: {_FIXED}>,
  instrument_update: struct<status: string>, venue_status: struct<message: string>>
"""
KINDS = ("trade", "quote", "book_snapshot", "book_delta", "candle", "mark_price", "index_price", "funding", "open_interest", "liquidation", "statistics_24h", "instrument_update", "venue_status")


def read_events(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Envelopes of JSON lines. strict: a broken line is an error; else it becomes a row of nulls with
    the text in ``_corrupt``."""
    reader = spark.read.schema(ENVELOPE + ("" if strict else ", _corrupt string")).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return with_kind((reader if strict else reader.option("columnNameOfCorruptRecord", "_corrupt")).json(path))


def parse_events(texts: DataFrame, value: str = "value") -> DataFrame:
    return with_kind(texts.withColumn("__e", F.from_json(value, ENVELOPE)).select(*[c for c in texts.columns if c != value], "__e.*"))


def with_kind(events: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    return events.withColumn("kind", F.coalesce(*[F.when(F.col(f"payload.{k}").isNotNull(), k) for k in kinds]))


def fixed_text(field: Column) -> Column:
    """Decimal lexeme of a coefficient and a scale, trailing zeros kept."""
    v = field["value"]
    two63 = F.lit("9223372036854775808").cast("decimal(20,0)")
    low = F.when(v["coefficient_lo"] >= two63, v["coefficient_lo"] - two63 * 2).otherwise(v["coefficient_lo"]).cast("long")
    return from_parts(low, v["coefficient_hi"], v["scale"])


def fixed_value(field: Column) -> Column:
    """``decimal(18,9)`` of a coefficient and a scale. Short coefficients are scaled as numbers; only what may be
    rounded or not fit goes by its lexeme, in a lambda, which keeps that long way out of the compiled code."""
    v = field["value"]
    low, scale = v["coefficient_lo"], v["scale"]
    steps = F.array(*[F.lit(f"1e-{k}").cast("decimal(10,9)") for k in range(10)])
    short = v["coefficient_hi"].eqNullSafe(0) & low.between(0, 999_999_999_999_999_999) & scale.between(0, 9)
    scaled = F.when(F.coalesce(short, F.lit(False)), low.cast("decimal(18,0)") * F.get(steps, scale))
    lexeme = F.get(F.transform(F.array(field), lambda f: parse_decimal(fixed_text(f)).cast("decimal(18,9)")), F.lit(0))
    return F.when(v.isNotNull(), F.when(scaled < 1_000_000_000, scaled.cast("decimal(18,9)")).otherwise(lexeme))


def side_name(name: Column) -> Column:
    """buy, sell or unknown of either spelling of the enum."""
    n = F.lower(F.regexp_replace(name, "^AGGRESSOR_SIDE_", ""))
    return F.when(n.isin("buy", "sell"), n).otherwise("unknown")


def tape_rows(events: DataFrame) -> DataFrame:
    """Trades and quotes of envelopes as tape rows; other kinds are left out."""
    fixed = lambda name: fixed_value(F.col(f"payload.{name}"))
    rows = events.where("kind in ('trade', 'quote')").select(
        "kind", F.col("venue_id").alias("venue"), F.col("instrument_id").alias("instrument"), fixed("trade.price").alias("price"), fixed("trade.quantity").alias("quantity"),
        F.when(F.col("kind") == "trade", side_name(F.col("payload.trade.aggressor"))).alias("aggressor"), F.col("payload.trade.trade_id").alias("trade_id"),
        fixed("quote.bid_price").alias("bid_price"), fixed("quote.bid_quantity").alias("bid_quantity"), fixed("quote.ask_price").alias("ask_price"), fixed("quote.ask_quantity").alias("ask_quantity"),
        F.col("exchange_ts.ns").alias("exchange_ts_ns"), F.col("receive_ts.ns").alias("receive_ts_ns"), "session_id", "frame_seq", "event_index",
    )
    return rows.withColumn("notional", notional())


def replay_page(events: DataFrame, offset: int, limit: int) -> DataFrame:
    """Tape rows of envelopes number ``offset`` to ``offset + limit``, numbered over all kinds in the
    order of receive time, session, frame and index: numbers come from counts of an hour, then from a
    window inside the hours that the page meets."""
    hour = F.floor(F.col("receive_ts.ns") / 3_600_000_000_000).cast("long")
    limit = max(1, min(limit, 500))
    rows = events.withColumn("__hour", hour)
    counts = rows.groupBy("__hour").count()
    before = F.sum("count").over(Window.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1))  # a row an hour
    met = counts.withColumn("__before", F.coalesce(before, F.lit(0))).where((F.col("__before") < offset + limit) & (F.col("__before") + F.col("count") > offset))
    order = Window.partitionBy("__hour").orderBy("receive_ts.ns", "session_id", "frame_seq", "event_index")
    numbered = rows.join(met.drop("count"), "__hour").withColumn("row_no", F.col("__before") + F.row_number().over(order) - 1)
    return tape_rows(numbered.where((F.col("row_no") >= offset) & (F.col("row_no") < offset + limit)).drop("__hour", "__before"))


def write_events(events: DataFrame, path: str) -> None:
    """JSON lines by kind; absent fields are left out, as readers expect."""
    names = [c for c in events.columns if c != "kind"]
    events.select("kind", F.to_json(F.struct(*names)).alias("value")).write.partitionBy("kind").text(path)


#: Commands of the line grammar, by their fields (fixed values).
GRAMMAR = {
    "TRADE": r"^TRADE (?<seq>[0-9]+) (?<price>\S+) (?<quantity>\S+) (?<side>BUY|SELL)(?: (?<id>\S+))?$",
    "QUOTE": r"^QUOTE (\S+) (\S+)(?: (\S+) (\S+))?$",
    "CANDLE": r"^CANDLE (\S+) (\S+) (\S+) (\S+) (\S+) ([0-9]+) ([0-9]+)$",
    "BOOK_SNAP": r"^BOOK_SNAP ([0-9]+) BID (\S+) ASK (\S+)$",
    "BOOK_DELTA": r"^BOOK_DELTA ([0-9]+) (BID|ASK) (UPSERT|DELETE) (\S+)(?: (\S+))?$",
}


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Test-venue command lines as columns: kind, seq, side, operation, price, quantity, trade_id, bids,
    asks and fields (of quotes and candles). Unknown commands have kind ``unknown``."""
    v = F.col(value)
    part = lambda kind, n: F.nullif(F.regexp_extract(v, GRAMMAR[kind], n), F.lit(""))
    word = F.split_part(v, F.lit(" "), F.lit(1))
    kind = F.coalesce(*[F.when(v.rlike(p), k.lower()) for k, p in GRAMMAR.items()], F.when(word.isin("SUB", "UNSUB", "STATS24H", "DISCONNECT"), F.lower(word)), F.lit("unknown"))
    levels = lambda text: F.transform(F.split(text, ","), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("decimal(18,9)").alias("price"), F.split_part(x, F.lit(":"), F.lit(2)).cast("decimal(18,9)").alias("quantity")))
    return lines.select(
        *lines.columns, kind.alias("kind"), F.coalesce(part("TRADE", 1), part("BOOK_SNAP", 1), part("BOOK_DELTA", 1)).cast("long").alias("seq"), F.lower(F.coalesce(part("TRADE", 4), part("BOOK_DELTA", 2))).alias("side"),
        F.lower(part("BOOK_DELTA", 3)).alias("operation"), F.coalesce(part("TRADE", 2), part("BOOK_DELTA", 4)).cast("decimal(18,9)").alias("price"), F.coalesce(part("TRADE", 3), part("BOOK_DELTA", 5)).cast("decimal(18,9)").alias("quantity"),
        part("TRADE", 5).alias("trade_id"), levels(part("BOOK_SNAP", 2)).alias("bids"), levels(part("BOOK_SNAP", 3)).alias("asks"), F.when(kind.isin("quote", "candle"), F.slice(F.split(v, " "), 2, 7)).alias("fields"),
    )
