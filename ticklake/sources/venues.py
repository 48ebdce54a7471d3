"""Venue messages to events: JSON text in, one row an event out.

A venue is a list of rules; each rule names its kind of event, the condition that tells its messages,
and its fields. Prices and quantities are read as text, so lexemes stay exact. A message is parsed once,
into columns that all rules of its venue read. It gives the numbers of the rules that hold, one row each, and
the fields are expressions over such a row, so that Spark compiles them and reads no field that nobody asks
for: no Python, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decimals import parse_decimal

FIELDS = {
    "kind": "string", "symbol": "string", "price": "decimal(38,18)", "quantity": "decimal(38,18)", "side": "string", "trade_id": "string", "bid_price": "decimal(38,18)", "bid_quantity": "decimal(38,18)", "ask_price": "decimal(38,18)",
    "ask_quantity": "decimal(38,18)", "open": "decimal(38,18)", "high": "decimal(38,18)", "low": "decimal(38,18)", "close": "decimal(38,18)", "volume": "decimal(38,18)", "interval": "string", "start_ns": "bigint", "rate": "decimal(38,18)",
    "next_funding_ns": "bigint", "bids": "array<array<string>>", "asks": "array<array<string>>", "first_seq": "bigint", "last_seq": "bigint", "previous_seq": "bigint", "quote_volume": "decimal(38,18)", "snapshot": "boolean", "checksum": "bigint", "exchange_ts_ns": "bigint",
}


@dataclass(frozen=True)
class Event:
    """A rule: its event's kind and fields, of messages where ``when`` holds."""

    kind: Column
    when: Column
    fields: dict[str, Column]


@dataclass(frozen=True)
class Each:
    """Rules of each element of ``rows``, of messages where ``when`` holds. An element's events stand together."""

    rows: Column
    rule: Callable[[Column], list[Event]]
    when: Column


Rules = list[Event | Each]


def event(kind: str | Column, when: Column, **fields: Column) -> Event:
    return Event(F.lit(kind) if isinstance(kind, str) else kind, F.coalesce(when, F.lit(False)), fields)


def each(rows: Column, rule: Callable[[Column], Event | list[Event]], when: Column | None = None) -> Each:
    listed = lambda x: got if isinstance(got := rule(x), list) else [got]
    return Each(rows, listed, F.lit(True) if when is None else F.coalesce(when, F.lit(False)))


def _typed(name: str, value: Column) -> Column:
    """A field of FIELDS from what rules give for it."""
    return parse_decimal(value.cast("string"), exponent=True) if FIELDS[name].startswith("decimal") else value.cast(FIELDS[name])


#: What the rules of the venue at hand read of a message, as columns before the rules' own.
_read: list[list[tuple[str, Column]]] = []


def parsed(text: Column, schema: str) -> Column:
    """``text`` read as JSON, once a message: rules refer to it as to a column. Not for use inside a lambda."""
    return stored(F.from_json(text, schema))


def stored(value: Column) -> Column:
    if not _read:
        return value
    _read[-1].append((f"__read_{len(_read[-1])}", value))
    return F.col(_read[-1][-1][0])


def ms(c: Column) -> Column:
    return c.try_cast("long") * 1_000_000


def taker(maker_is_buyer: Column) -> Column:
    return F.when(maker_is_buyer, "sell").otherwise("buy")


#: Message shapes of public venue feeds, by what is read of them (fixed values).
#: Keys that differ in case only need a map: struct fields are told apart without case.
KEYED = "map<string,string>"
OKX = "struct<arg:struct<channel:string,instId:string>,action:string,data:array<string>>"
OKX_ROW = "struct<instId:string,tradeId:string,px:string,sz:string,side:string,ts:string,bidPx:string,bidSz:string,askPx:string,askSz:string,bids:array<array<string>>,asks:array<array<string>>,checksum:bigint,seqId:string,prevSeqId:string,markPx:string,idxPx:string,fundingRate:string,nextFundingTime:string,oi:string,details:array<struct<side:string,bkPx:string,sz:string,ts:string>>>"
BYBIT = "struct<topic:string,type:string,ts:string,data:string>"
BYBIT_BOOK = "struct<s:string,b:array<array<string>>,a:array<array<string>>,u:string,seq:string>"
BYBIT_CANDLE = "array<struct<start:string,interval:string,open:string,close:string,high:string,low:string,volume:string>>"
KRAKEN = "struct<channel:string,type:string,data:array<string>>"
KRAKEN_ROW = "struct<symbol:string,price:string,qty:string,side:string,trade_id:string,timestamp:string,bid:string,bid_qty:string,ask:string,ask_qty:string,bids:array<struct<price:string,qty:string>>,asks:array<struct<price:string,qty:string>>,checksum:bigint,open:string,high:string,low:string,close:string,volume:string,interval:string,interval_begin:string>"
COINBASE = "struct<type:string,product_id:string,price:string,size:string,side:string,trade_id:string,time:string,best_bid:string,best_bid_size:string,best_ask:string,best_ask_size:string,bids:array<array<string>>,asks:array<array<string>>,changes:array<array<string>>,sequence:string>"


def binance(raw: Column) -> Rules:
    j = parsed(raw, KEYED)
    e, k, o = j["e"], parsed(j["k"], KEYED), parsed(F.when(j["e"] == "forceOrder", j["o"]), KEYED)
    book = (e == "depthUpdate") | j["lastUpdateId"].isNotNull()  # b and a are numbers elsewhere
    bids, asks = (parsed(F.when(book, F.coalesce(j[a], j[b])), "array<array<string>>") for a, b in (("b", "bids"), ("a", "asks")))
    candle = dict(open=k["o"], high=k["h"], low=k["l"], close=k["c"], volume=k["v"], interval=k["i"], start_ns=ms(k["t"]))
    return [
        event("trade", e.isin("trade", "aggTrade"), symbol=j["s"], price=j["p"], quantity=j["q"], side=taker(j["m"] == "true"), trade_id=F.coalesce(j["t"], j["a"]), exchange_ts_ns=ms(j["T"])),
        event("quote", (e.isNull() | (e == "bookTicker")) & j["lastUpdateId"].isNull() & j["A"].isNotNull() & j["b"].isNotNull() & j["s"].isNotNull(), symbol=j["s"], bid_price=j["b"], bid_quantity=j["B"], ask_price=j["a"], ask_quantity=j["A"], exchange_ts_ns=ms(j["T"])),
        event("candle", e == "kline", symbol=j["s"], exchange_ts_ns=ms(j["E"]), **candle),
        event("book_delta", e == "depthUpdate", symbol=j["s"], bids=bids, asks=asks, first_seq=j["U"], last_seq=j["u"], previous_seq=j["pu"], snapshot=F.lit(False), exchange_ts_ns=ms(j["E"])),
        event("book_snapshot", j["lastUpdateId"].isNotNull(), bids=bids, asks=asks, last_seq=j["lastUpdateId"], snapshot=F.lit(True)),
        event("mark_price", e == "markPriceUpdate", symbol=j["s"], price=j["p"], exchange_ts_ns=ms(j["E"])),
        event("index_price", (e == "markPriceUpdate") & j["i"].isNotNull(), symbol=j["s"], price=j["i"], exchange_ts_ns=ms(j["E"])),
        event("funding", (e == "markPriceUpdate") & (F.coalesce(j["r"], F.lit("")) != ""), symbol=j["s"], rate=j["r"], next_funding_ns=ms(j["T"]), exchange_ts_ns=ms(j["E"])),
        event("index_price", e == "indexPriceUpdate", symbol=j["i"], price=j["p"], exchange_ts_ns=ms(j["E"])),
        event("open_interest", j["openInterest"].isNotNull(), symbol=j["symbol"], quantity=j["openInterest"], exchange_ts_ns=ms(j["time"])),
        event("statistics_24h", e == "24hrTicker", symbol=j["s"], open=j["o"], high=j["h"], low=j["l"], close=j["c"], volume=j["v"], quote_volume=j["q"], exchange_ts_ns=ms(j["E"])),
        event("liquidation", e == "forceOrder", symbol=o["s"], price=F.coalesce(o["ap"], o["p"]), quantity=o["q"], side=F.lower(o["S"]), exchange_ts_ns=ms(o["T"])),
    ]


def okx(raw: Column, *, first_only: bool = False) -> Rules:
    """All rows of a frame's ``data``; first_only: the first of each frame."""
    j = parsed(raw, OKX)
    channel, symbol = j["arg"]["channel"], j["arg"]["instId"]
    data = F.slice(j["data"], 1, 1) if first_only else j["data"]

    candle = channel.startswith("candle")
    rows = stored(F.transform(data, lambda t: F.struct(F.from_json(F.when(~candle, t), OKX_ROW).alias("r"), F.from_json(F.when(candle, t), "array<string>").alias("c"))))

    def row(x: Column) -> list[Event]:
        r, c = x["r"], x["c"]
        at = dict(symbol=F.coalesce(r["instId"], symbol), exchange_ts_ns=ms(r["ts"]))
        first = r["details"][0]
        return [
            event("trade", channel.isin("trades", "trades-all"), price=r["px"], quantity=r["sz"], side=r["side"], trade_id=r["tradeId"], **at),
            event("quote", channel == "tickers", bid_price=r["bidPx"], bid_quantity=r["bidSz"], ask_price=r["askPx"], ask_quantity=r["askSz"], **at),
            event(F.when(j["action"] == "snapshot", "book_snapshot").otherwise("book_delta"), channel.startswith("books"), bids=r["bids"], asks=r["asks"], checksum=r["checksum"], last_seq=r["seqId"], previous_seq=r["prevSeqId"], snapshot=j["action"] == "snapshot", **at),
            event("mark_price", channel == "mark-price", price=r["markPx"], **at), event("index_price", channel == "index-tickers", price=r["idxPx"], **at),
            event("funding", channel == "funding-rate", rate=r["fundingRate"], next_funding_ns=ms(r["nextFundingTime"]), **at), event("open_interest", channel == "open-interest", quantity=r["oi"], **at),
            event("liquidation", channel == "liquidation-orders", price=first["bkPx"], quantity=first["sz"], side=first["side"], symbol=at["symbol"], exchange_ts_ns=ms(first["ts"])),
            event("candle", candle, symbol=symbol, start_ns=ms(c[0]), open=c[1], high=c[2], low=c[3], close=c[4], volume=c[5], interval=F.lower(F.substring(channel, 7, 9))),
        ]

    return [each(rows, row)]


def bybit(raw: Column) -> Rules:
    j = parsed(raw, BYBIT)
    topic, at = j["topic"], ms(j["ts"])
    data = lambda name, schema: parsed(F.when(topic.startswith(name), j["data"]), schema)
    book = data("orderbook", BYBIT_BOOK)
    name = F.element_at(F.split(topic, r"\."), -1)
    trades = each(data("publicTrade", f"array<{KEYED}>"), lambda t: event("trade", topic.startswith("publicTrade"), symbol=t["s"], price=t["p"], quantity=t["v"], side=F.lower(t["S"]), trade_id=t["i"], exchange_ts_ns=ms(t["T"])))
    # the venue gives the side of the position, the forced order has the other
    forced = each(data("allLiquidation", f"array<{KEYED}>"), lambda t: event("liquidation", topic.startswith("allLiquidation"), symbol=t["s"], price=t["p"], quantity=t["v"], side=taker(t["S"] == "Buy"), exchange_ts_ns=ms(t["T"])))
    candles = each(data("kline", BYBIT_CANDLE), lambda c: event("candle", topic.startswith("kline"), symbol=name, open=c["open"], high=c["high"], low=c["low"], close=c["close"], volume=c["volume"], interval=c["interval"], start_ns=ms(c["start"]), exchange_ts_ns=at))
    snapshot = j["type"] == "snapshot"
    level = event(F.when(snapshot, "book_snapshot").otherwise("book_delta"), topic.startswith("orderbook"), symbol=book["s"], bids=book["b"], asks=book["a"], last_seq=book["u"], snapshot=snapshot, exchange_ts_ns=at)
    t = data("tickers", KEYED)
    tick, now = topic.startswith("tickers"), dict(symbol=t["symbol"], exchange_ts_ns=at)
    measures = [
        event("mark_price", tick & t["markPrice"].isNotNull(), price=t["markPrice"], **now), event("index_price", tick & t["indexPrice"].isNotNull(), price=t["indexPrice"], **now),
        event("funding", tick & (F.coalesce(t["fundingRate"], F.lit("")) != ""), rate=t["fundingRate"], next_funding_ns=ms(t["nextFundingTime"]), **now), event("open_interest", tick & t["openInterest"].isNotNull(), quantity=t["openInterest"], **now),
        event("statistics_24h", tick & t["lastPrice"].isNotNull(), open=t["prevPrice24h"], high=t["highPrice24h"], low=t["lowPrice24h"], close=t["lastPrice"], volume=t["volume24h"], quote_volume=t["turnover24h"], **now),
    ]
    return [level, *measures, trades, forced, candles]


def kraken(raw: Column) -> Rules:
    j = parsed(raw, KRAKEN)
    channel = j["channel"]
    micros = lambda t: F.unix_micros(F.try_to_timestamp(t)) * 1000
    pairs = lambda side: F.transform(side, lambda x: F.array(x["price"], x["qty"]))

    rows = stored(F.transform(j["data"], lambda t: F.from_json(t, KRAKEN_ROW)))

    def row(r: Column) -> list[Event]:
        at = dict(symbol=r["symbol"], exchange_ts_ns=micros(r["timestamp"]))
        snapshot = j["type"] == "snapshot"
        return [
            event("trade", channel == "trade", price=r["price"], quantity=r["qty"], side=r["side"], trade_id=r["trade_id"], **at), event("quote", channel == "ticker", bid_price=r["bid"], bid_quantity=r["bid_qty"], ask_price=r["ask"], ask_quantity=r["ask_qty"], **at),
            event(F.when(snapshot, "book_snapshot").otherwise("book_delta"), channel == "book", bids=pairs(r["bids"]), asks=pairs(r["asks"]), checksum=r["checksum"], snapshot=snapshot, **at),
            event("candle", channel == "ohlc", open=r["open"], high=r["high"], low=r["low"], close=r["close"], volume=r["volume"], interval=r["interval"], start_ns=micros(r["interval_begin"]), **at),
        ]

    return [each(rows, row)]


def coinbase(raw: Column) -> Rules:
    """The side given is the maker's, so the taker's is the other."""
    j = parsed(raw, COINBASE)
    at = dict(symbol=j["product_id"], exchange_ts_ns=F.unix_micros(F.try_to_timestamp(j["time"])) * 1000)
    side = lambda name: F.transform(F.filter(j["changes"], lambda x: x[0] == name), lambda x: F.slice(x, 2, 2))
    return [
        event("trade", j["type"].isin("match", "last_match"), price=j["price"], quantity=j["size"], side=taker(j["side"] == "buy"), trade_id=j["trade_id"], last_seq=j["sequence"], **at),
        event("quote", j["type"] == "ticker", bid_price=j["best_bid"], bid_quantity=j["best_bid_size"], ask_price=j["best_ask"], ask_quantity=j["best_ask_size"], **at),
        event("book_snapshot", j["type"] == "snapshot", bids=j["bids"], asks=j["asks"], snapshot=F.lit(True), **at), event("book_delta", j["type"] == "l2update", bids=side("buy"), asks=side("sell"), snapshot=F.lit(False), **at),
    ]


def coinbase_candles(rows: Column, symbol: Column) -> Column:
    """The first row of a REST answer: time in seconds, low, high, open, close, volume."""
    c = F.from_json(rows, "array<array<string>>")[0]
    fields = dict(kind=F.lit("candle"), symbol=symbol, start_ns=c[0].cast("long") * 1_000_000_000, low=c[1], high=c[2], open=c[3], close=c[4], volume=c[5])
    return F.when(c.isNotNull(), F.struct(*[_typed(n, fields.get(n, F.lit(None))).alias(n) for n in FIELDS]))


VENUES: dict[str, Callable[[Column], Rules]] = {"binance": binance, "okx": okx, "bybit": bybit, "kraken": kraken, "coinbase": coinbase}


def normalize(raw: DataFrame, venue: str, *, value: str = "value", keep: tuple[str, ...] | None = None, **options) -> DataFrame:
    """Events of a venue's frames with the frame's other columns (or those of ``keep``) and ``event_index``.
    A frame that no rule knows gives one row of kind ``unknown_message``."""
    rest = [c for c in raw.columns if c != value] if keep is None else list(keep)
    from .more_venues import MORE  # they build on the rules here

    _read.append([])
    try:
        rules = (VENUES | MORE)[venue](F.col(value), **options)
        rules = [each(stored(x.rows), x.rule, x.when) if isinstance(x, Each) else x for x in rules]
    finally:
        columns = _read.pop()
    for name, column in columns:  # a later one may read an earlier one
        raw = raw.withColumn(name, column)
    numbers, named = _numbered(rules)
    rows = raw.select("*", F.posexplode_outer(numbers).alias("__at", "__rule"))
    rule = F.col("__rule").bitwiseAND(RULES - 1)
    by_rule = lambda cases: reduce(lambda c, x: c.when(rule == x[0], x[1]), cases, F.when(rule.isNull(), None))
    out = [F.coalesce(by_rule([(k, e.kind) for k, e in named]), F.lit("unknown_message")).alias("kind")]
    for name in list(FIELDS)[1:]:
        text = FIELDS[name].startswith("decimal")  # one number is parsed, whatever rule gives it
        cases = [(k, e.fields[name].cast("string") if text else _typed(name, e.fields[name])) for k, e in named if name in e.fields]
        out.append(_typed(name, by_rule(cases) if cases else F.lit(None)).alias(name))
    return rows.select(*rest, F.coalesce("__at", F.lit(0)).alias("event_index"), *out)


#: Rules that a venue has at most; above these bits a number has the place of an element.
RULES = 64


def _numbered(rules: Rules) -> tuple[Column, list[tuple[int, Event]]]:
    """The numbers of the rules that hold for a message, in their order, and the rules by number, of elements as of the
    one whose place the number has."""
    groups, named, single = [], [], []

    def number(rule: Event) -> Column:
        named.append((len(named), rule))
        return F.when(rule.when, len(named) - 1).otherwise(-1)

    def close() -> None:
        if single:
            groups.append(F.array_remove(F.array(*single), -1))
            single.clear()

    for x in rules:
        if isinstance(x, Event):
            single.append(number(x))
            continue
        close()
        first = len(named)
        named += [(first + k, e) for k, e in enumerate(x.rule(F.get(x.rows, F.floor(F.col("__rule") / RULES).cast("int"))))]
        held = lambda t, at: F.array(*[F.when(e.when, at * RULES + first + k).otherwise(-1) for k, e in enumerate(x.rule(t))])  # noqa: B023, E731
        found = F.array_remove(F.flatten(F.transform(x.rows, held)), -1)
        groups.append(F.when(x.when & x.rows.isNotNull(), found).otherwise(F.array().cast("array<int>")))
    close()
    assert len(named) <= RULES
    return (F.concat(*groups) if len(groups) > 1 else groups[0]), named
