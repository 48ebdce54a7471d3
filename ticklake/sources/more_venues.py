"""Messages of further venues to events, by the rules of ``venues``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import as_of
from .venues import KEYED, Event, Rules, each, event, ms, parsed, stored, taker

PAIRS = "array<array<string>>"


def _iso_ns(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text)) * 1000


def _text(c: Column) -> Column:
    """A JSON value as read from an array of texts: quoted strings lose their quotes."""
    return F.regexp_replace(c, '^"|"$', "")


def _where(rule: Event, when: Column) -> Event:
    return event(rule.kind, when & rule.when, **rule.fields)


def kraken_futures(raw: Column) -> Rules:
    """A quote's missing sizes are 0, as the venue's adapters have it."""
    j = parsed(raw, KEYED)
    feed, at = j["feed"], dict(symbol=j["product_id"], exchange_ts_ns=ms(F.coalesce(j["time"], j["timestamp"])))
    level = lambda side: F.transform(parsed(j[side], "array<struct<price:string,qty:string>>"), lambda x: F.array(x["price"], x["qty"]))
    one = lambda side: F.when(j["side"] == side, F.array(F.array(j["price"], j["qty"]))).otherwise(F.array().cast(PAIRS))
    trade = lambda t: event("trade", t["price"].isNotNull(), symbol=F.coalesce(t["product_id"], j["product_id"]), price=t["price"], quantity=t["qty"], side=t["side"], trade_id=t["uid"], exchange_ts_ns=ms(t["time"]))
    tick = feed == "ticker"
    return [
        event("trade", feed == "trade", price=j["price"], quantity=j["qty"], side=j["side"], trade_id=j["uid"], last_seq=j["seq"], **at),
        event("liquidation", (feed == "trade") & (j["type"] == "liquidation"), price=j["price"], quantity=j["qty"], side=j["side"], **at),
        event("quote", tick, bid_price=j["bid"], bid_quantity=F.coalesce(j["bid_size"], F.lit("0")), ask_price=j["ask"], ask_quantity=F.coalesce(j["ask_size"], F.lit("0")), **at),
        event("statistics_24h", tick, open=j["open"], high=j["high"], low=j["low"], close=j["last"], volume=j["volume"], quote_volume=j["volumeQuote"], **at),
        event("mark_price", tick & j["markPrice"].isNotNull(), price=j["markPrice"], **at), event("index_price", tick & j["index"].isNotNull(), price=j["index"], **at),
        event("open_interest", tick & j["openInterest"].isNotNull(), quantity=j["openInterest"], **at),
        event("funding", tick & j["funding_rate"].isNotNull(), rate=j["funding_rate"], next_funding_ns=ms(j["next_funding_rate_time"]), **at),
        event("book_snapshot", feed == "book_snapshot", bids=level("bids"), asks=level("asks"), last_seq=j["seq"], snapshot=F.lit(True), **at),
        event("book_delta", feed == "book", bids=one("buy"), asks=one("sell"), last_seq=j["seq"], snapshot=F.lit(False), **at),
        each(parsed(j["trades"], f"array<{KEYED}>"), trade, feed == "trade_snapshot"),
    ]


def deribit(raw: Column) -> Rules:
    """A trade that liquidates a side adds a liquidation. Statistics have no open."""
    p = parsed(raw, "struct<params:struct<channel:string,data:string>>")["params"]
    channel, text = p["channel"], p["data"]
    kind = F.get(F.split(channel, r"\."), F.lit(0))
    j, trades = parsed(F.when(kind != "trades", text), KEYED), parsed(F.when(kind == "trades", text), f"array<{KEYED}>")
    at = dict(symbol=j["instrument_name"], exchange_ts_ns=ms(j["timestamp"]))
    stats = parsed(j["stats"], KEYED)
    side = lambda name: F.transform(parsed(j[name], PAIRS), lambda x: F.array(x[1], F.when(x[0] == "delete", "0").otherwise(x[2])))
    own = lambda t: dict(symbol=t["instrument_name"], price=t["price"], quantity=t["amount"], side=t["direction"], exchange_ts_ns=ms(t["timestamp"]))
    tick, snapshot = kind == "ticker", j["type"] == "snapshot"
    return [
        each(trades, lambda t: event("trade", t["trade_id"].isNotNull(), trade_id=t["trade_id"], **own(t)), kind == "trades"),
        each(trades, lambda t: event("liquidation", t["liquidation"].isin("T", "M", "MT"), **own(t)), kind == "trades"),
        event("quote", tick, bid_price=j["best_bid_price"], bid_quantity=j["best_bid_amount"], ask_price=j["best_ask_price"], ask_quantity=j["best_ask_amount"], **at),
        event("statistics_24h", tick & j["stats"].isNotNull(), high=stats["high"], low=stats["low"], close=j["last_price"], volume=stats["volume"], quote_volume=stats["volume_usd"], **at),
        event("mark_price", tick & j["mark_price"].isNotNull(), price=j["mark_price"], **at), event("index_price", tick & j["index_price"].isNotNull(), price=j["index_price"], **at),
        event("funding", tick & j["funding_8h"].isNotNull(), rate=j["funding_8h"], **at), event("open_interest", tick & j["open_interest"].isNotNull(), quantity=j["open_interest"], **at),
        event(F.when(snapshot, "book_snapshot").otherwise("book_delta"), kind == "book", bids=side("bids"), asks=side("asks"), last_seq=j["change_id"], previous_seq=j["prev_change_id"], snapshot=snapshot, **at),
        event("candle", channel.startswith("chart.trades"), symbol=F.get(F.split(channel, r"\."), F.lit(2)), open=j["open"], high=j["high"], low=j["low"], close=j["close"], volume=j["volume"], interval=F.get(F.split(channel, r"\."), F.lit(3)), start_ns=ms(j["tick"])),
        event("index_price", kind == "deribit_price_index", symbol=j["index_name"], price=j["price"], exchange_ts_ns=ms(j["timestamp"])),
    ]


def bitstamp(raw: Column) -> Rules:
    """Full books replace each other; the texts of prices are preferred to the numbers."""
    m = parsed(raw, "struct<event:string,channel:string,data:string>")
    j, channel = parsed(m["data"], KEYED), m["channel"]
    at = dict(symbol=F.element_at(F.split(channel, "_"), -1), exchange_ts_ns=j["microtimestamp"].cast("long") * 1000)
    book = dict(bids=parsed(j["bids"], PAIRS), asks=parsed(j["asks"], PAIRS))
    return [
        event("trade", m["event"] == "trade", price=F.coalesce(j["price_str"], j["price"]), quantity=F.coalesce(j["amount_str"], j["amount"]), side=F.when(j["type"] == "0", "buy").otherwise("sell"), trade_id=j["id"], **at),
        event("book_snapshot", channel.startswith("order_book") & j["bids"].isNotNull(), snapshot=F.lit(True), last_seq=j["microtimestamp"], **book, **at),
        event("book_delta", channel.startswith("diff_order_book") & j["bids"].isNotNull(), snapshot=F.lit(False), last_seq=j["microtimestamp"], **book, **at),
    ]


def gemini(raw: Column) -> Rules:
    """Times come in nanoseconds; a range of update numbers that runs backwards is no event."""
    j = parsed(raw, KEYED)
    at = dict(symbol=j["s"], exchange_ts_ns=j["E"])
    depth = j["U"].isNotNull() & (j["U"].cast("long") <= j["u"].cast("long"))
    return [
        event("trade", j["t"].isNotNull() & j["p"].isNotNull(), price=j["p"], quantity=j["q"], side=taker(j["m"] == "true"), trade_id=j["t"], **at),
        event("quote", j["B"].isNotNull() & j["A"].isNotNull(), bid_price=j["b"], bid_quantity=j["B"], ask_price=j["a"], ask_quantity=j["A"], last_seq=j["u"], **at),
        event("book_delta", depth, bids=parsed(F.when(depth, j["b"]), PAIRS), asks=parsed(F.when(depth, j["a"]), PAIRS), first_seq=j["U"], last_seq=j["u"], snapshot=F.lit(False), **at),
        event("book_snapshot", j["lastUpdateId"].isNotNull(), bids=parsed(j["bids"], PAIRS), asks=parsed(j["asks"], PAIRS), last_seq=j["lastUpdateId"], snapshot=F.lit(True)),
    ]


def coinbase_advanced(raw: Column) -> Rules:
    """The side of a trade is the maker's, so the taker's is the other."""
    m = parsed(raw, "struct<channel:string,timestamp:string,sequence_num:string,events:array<struct<type:string,product_id:string,trades:array<map<string,string>>,tickers:array<map<string,string>>,updates:array<map<string,string>>,candles:array<map<string,string>>>>>")
    channel, now = m["channel"], _iso_ns(m["timestamp"])
    flat = lambda name: stored(F.flatten(F.transform(m["events"], lambda e: F.coalesce(e[name], F.array().cast("array<map<string,string>>")))))

    def book(e):
        side = lambda name: F.transform(F.filter(e["updates"], lambda u: u["side"] == name), lambda u: F.array(u["price_level"], u["new_quantity"]))
        snapshot = e["type"] == "snapshot"
        return event(F.when(snapshot, "book_snapshot").otherwise("book_delta"), e["updates"].isNotNull(), symbol=e["product_id"], bids=side("bid"), asks=side("offer"), last_seq=m["sequence_num"], snapshot=snapshot, exchange_ts_ns=now)

    tick = lambda t: dict(symbol=t["product_id"], exchange_ts_ns=now)
    tickers, ticker = flat("tickers"), channel.isin("ticker", "ticker_batch")
    return [
        each(flat("trades"), lambda t: event("trade", t["price"].isNotNull(), symbol=t["product_id"], price=t["price"], quantity=t["size"], side=taker(F.upper(t["side"]) == "BUY"), trade_id=t["trade_id"], last_seq=m["sequence_num"], exchange_ts_ns=_iso_ns(t["time"])), channel == "market_trades"),
        each(tickers, lambda t: event("quote", t["best_bid"].isNotNull() & t["best_ask"].isNotNull(), bid_price=t["best_bid"], bid_quantity=t["best_bid_quantity"], ask_price=t["best_ask"], ask_quantity=t["best_ask_quantity"], **tick(t)), ticker),
        each(tickers, lambda t: event("statistics_24h", t["price"].isNotNull(), high=t["high_24_h"], low=t["low_24_h"], close=t["price"], volume=t["volume_24_h"], **tick(t)), ticker),
        each(m["events"], book, channel.isin("l2_data", "level2")),
        each(flat("candles"), lambda c: event("candle", c["start"].isNotNull(), symbol=c["product_id"], open=c["open"], high=c["high"], low=c["low"], close=c["close"], volume=c["volume"], start_ns=c["start"].cast("long") * 1_000_000_000), channel == "candles"),
    ]


def coinbase_intl(raw: Column) -> Rules:
    """One ``last_seq`` runs through all messages of a session (``fold_sessions`` checks it)."""
    j = parsed(raw, KEYED)
    channel, at = F.upper(j["channel"]), dict(symbol=j["product_id"], last_seq=j["sequence"], exchange_ts_ns=_iso_ns(j["time"]))
    side = F.when(j["aggressor_side"].isin("BUY", "OPENING_FILL"), "buy").when(j["aggressor_side"] == "SELL", "sell").otherwise("unknown")
    changes = parsed(j["changes"], PAIRS)
    part = lambda name: F.transform(F.filter(changes, lambda x: x[0] == name), lambda x: F.slice(x, 2, 2))
    snapshot = F.upper(j["type"]) == "SNAPSHOT"
    return [
        event("trade", channel.isin("MATCH", "RFQ_MATCH"), price=j["trade_price"], quantity=j["trade_qty"], side=side, trade_id=j["match_id"], **at),
        event("quote", (channel == "LEVEL1") & j["bid_price"].isNotNull() & j["ask_price"].isNotNull(), bid_price=j["bid_price"], bid_quantity=j["bid_qty"], ask_price=j["ask_price"], ask_quantity=j["ask_qty"], **at),
        event("book_snapshot", (channel == "LEVEL2") & snapshot, bids=parsed(j["bids"], PAIRS), asks=parsed(j["asks"], PAIRS), snapshot=F.lit(True), **at),
        event("book_delta", (channel == "LEVEL2") & ~snapshot, bids=part("BUY"), asks=part("SELL"), snapshot=F.lit(False), **at),
    ]


def bitfinex_channels(raw: DataFrame, *, value: str = "value", keys: list[str] = ["session"], order: str = "frame_seq") -> DataFrame:  # noqa: B006
    """(keys, channel_id, order, channel, symbol, interval) of what a venue acknowledged, in its place: from there on a
    number means that channel, or after an unsubscription none."""
    j = F.from_json(F.when(F.col(value).rlike(r"^\s*\{"), F.col(value)), KEYED)  # texts of other shapes are costly to refuse
    key = F.split(j["key"], ":", 3)
    on = lambda x: F.when(j["event"] == "subscribed", x)
    symbol = F.when(j["channel"] == "candles", F.get(key, F.lit(2))).otherwise(j["symbol"])
    interval = F.when(j["channel"] == "candles", F.lower(F.get(key, F.lit(1))))
    return raw.where(j["event"].isin("subscribed", "unsubscribed")).select(*keys, j["chanId"].cast("long").alias("channel_id"), order, on(j["channel"]).alias("channel"), on(symbol).alias("symbol"), on(interval).alias("interval"))


def bind_channels(raw: DataFrame, *, value: str = "value", keys: list[str] = ["session"], order: str = "frame_seq", block: int = 100_000) -> DataFrame:  # noqa: B006
    """Frames with the ``channel``, ``symbol`` and ``interval`` that their channel number had at their place in the session,
    as ``bitfinex`` reads them. A number that is used again names later frames only."""
    number = F.get(F.from_json(F.col(value), "array<string>"), F.lit(0)).try_cast("long")
    told = bitfinex_channels(raw, value=value, keys=keys, order=order)
    return as_of(raw.withColumn("channel_id", number), told, [*keys, "channel_id"], ["channel", "symbol", "interval"], time=order, block=block)


def bitfinex(raw: Column) -> Rules:
    """Frames of ``bind_channels``. Amounts carry the side in their sign; of a trade's two messages the
    first counts; a count of 0 deletes a level; sizes of 0 in a quote are unknown."""
    channel, symbol, interval = F.col("channel"), F.col("symbol"), F.col("interval")
    top = parsed(raw, "array<string>")
    kind, body = F.get(top, F.lit(1)), F.try_element_at(top, F.lit(-1))
    row = parsed(body, "array<string>")
    nested = F.substring(F.get(row, F.lit(0)), 1, 1) == "["
    rows = parsed(F.when(nested | (channel == "status"), body), "array<array<string>>")
    amount = lambda x: x.cast("decimal(38,18)")
    signed = lambda x: F.when(amount(x) > 0, "buy").when(amount(x) < 0, "sell").otherwise("unknown")
    bare = lambda x: F.regexp_replace(x, "^-", "")
    some = lambda x: F.when(amount(x) != 0, x)
    trade = lambda t: event("trade", F.get(t, F.lit(3)).isNotNull(), symbol=symbol, trade_id=F.get(t, F.lit(0)), exchange_ts_ns=ms(F.get(t, F.lit(1))), quantity=bare(F.get(t, F.lit(2))), side=signed(F.get(t, F.lit(2))), price=F.get(t, F.lit(3)))
    candle = lambda c: event("candle", F.get(c, F.lit(5)).isNotNull(), symbol=symbol, interval=interval, start_ns=ms(F.get(c, F.lit(0))), open=F.get(c, F.lit(1)), close=F.get(c, F.lit(2)), high=F.get(c, F.lit(3)), low=F.get(c, F.lit(4)), volume=F.get(c, F.lit(5)))

    def liquidation(x):
        side = F.when(amount(F.get(x, F.lit(5))) > 0, "sell").when(amount(F.get(x, F.lit(5))) < 0, "buy").otherwise("unknown")
        matched = (_text(F.get(x, F.lit(0))) == "pos") & (F.coalesce(F.get(x, F.lit(8)), F.lit("1")).isin("1", "true"))
        return event("liquidation", matched, symbol=_text(F.get(x, F.lit(4))), price=F.coalesce(F.get(x, F.lit(11)), F.get(x, F.lit(6))), quantity=bare(F.get(x, F.lit(5))), side=side, exchange_ts_ns=ms(F.get(x, F.lit(2)).try_cast("double").cast("long")))

    level = lambda x: F.array(F.get(x, F.lit(0)), F.when(F.get(x, F.lit(1)) == "0", "0").otherwise(bare(F.get(x, F.lit(2)))))
    side = lambda levels, buy: F.transform(F.filter(levels, lambda x: (amount(F.get(x, F.lit(2))) > 0) == buy), level)
    book = lambda levels, snapshot, when: event("book_snapshot" if snapshot else "book_delta", when, symbol=symbol, bids=side(levels, F.lit(True)), asks=side(levels, F.lit(False)), snapshot=F.lit(snapshot))
    tick, beat = channel == "ticker", _text(F.coalesce(kind, F.lit(""))) == "hb"
    named = channel.isNotNull() & ~beat
    return [
        each(F.when(F.size(top) == 2, rows), trade, named & (channel == "trades") & nested), _where(trade(row), named & (channel == "trades") & (_text(kind) == "te")),
        event("quote", named & tick, symbol=symbol, bid_price=F.get(row, F.lit(0)), bid_quantity=some(F.get(row, F.lit(1))), ask_price=F.get(row, F.lit(2)), ask_quantity=some(F.get(row, F.lit(3)))),
        event("statistics_24h", named & tick & F.get(row, F.lit(9)).isNotNull(), symbol=symbol, close=F.get(row, F.lit(6)), volume=F.get(row, F.lit(7)), high=F.get(row, F.lit(8)), low=F.get(row, F.lit(9))),
        book(rows, True, named & (channel == "book") & nested), book(F.array(row), False, named & (channel == "book") & ~nested),
        each(rows, candle, named & (channel == "candles") & nested), _where(candle(row), named & (channel == "candles") & ~nested), each(rows, liquidation, named & (channel == "status")),
    ]


MORE = {
    "kraken_futures": kraken_futures, "deribit": deribit, "bitstamp": bitstamp, "gemini": gemini, "coinbase_advanced": coinbase_advanced, "coinbase_intl": coinbase_intl, "bitfinex": bitfinex,
}
