"""Golden values, folds against plain models, sources and streams."""

from __future__ import annotations

import json
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ticklake.functions import decimals, scalars
from ticklake.operators import books, flow, sampling, stream_quality, windows
from ticklake.sources import events, records, venues
from ticklake.streaming import books as live
from ticklake.streaming.bars import distinct_stream, stream_bars

TRADES = "event_id long, kind string, venue string, instrument int, price decimal(18,9), quantity decimal(18,9), aggressor string, exchange_ts_ns long, sec long"


def trade(i, side, price, quantity, sec):
    return (i, "trade", "v", 1, Decimal(str(price)), Decimal(str(quantity)), side, sec * 10**9, sec)


def one(df, expr):
    return df.select(expr.alias("x")).first().x


# scalar functions


def test_decimals(spark):
    df = spark.createDataFrame([(x,) for x in ("123.45", "-0.001", ".5", "1e3", "9.74e-6", "-8713e4", "", "1.2.3", "1e", " 1")], "t string")
    rows = {r.t: r for r in df.select("t", decimals.split_decimal(F.col("t")).alias("s"), decimals.parse_decimal(F.col("t"), exponent=True).alias("v"), decimals.parse_error(F.col("t"), exponent=True).alias("e")).collect()}
    want = {"123.45": (12345, 2), "-0.001": (-1, 3), ".5": (5, 1), "1e3": (1000, 0), "9.74e-6": (974, 8), "-8713e4": (-87130000, 0)}
    assert {k: tuple(rows[k].s) for k in want} == want
    assert rows["9.74e-6"].v == Decimal("0.00000974") and rows[""].e == "Empty" and rows["1.2.3"].e == rows["1e"].e == rows[" 1"].e == "InvalidSyntax"


def test_rescale_modes(spark):
    df = spark.createDataFrame([(Decimal("1.25"),), (Decimal("-1.25"),), (Decimal("2.50"),)], "v decimal(10,2)")
    modes = {m: [r.x if r.x is None else str(r.x) for r in df.select(decimals.rescale(F.col("v"), 1, m).alias("x")).collect()] for m in ("exact", "toward_zero", "away_from_zero", "floor", "ceil", "half_away")}
    assert modes["exact"] == [None, None, "2.5"] and modes["toward_zero"] == ["1.2", "-1.2", "2.5"] and modes["away_from_zero"] == ["1.3", "-1.3", "2.5"]
    assert modes["floor"] == ["1.2", "-1.3", "2.5"] and modes["ceil"] == ["1.3", "-1.2", "2.5"] and modes["half_away"] == ["1.3", "-1.3", "2.5"]


def test_parts_of_a_coefficient(spark):
    df = spark.createDataFrame([(12345, 0, 2), (-1, 0, 0), (-1, -1, 3), (5, 0, 1), (1000, 0, 2)], "lo long, hi long, scale int")
    got = [r.x for r in df.select(decimals.from_parts(F.col("lo"), F.col("hi"), F.col("scale")).alias("x")).collect()]
    assert got == ["123.45", "18446744073709551615", "-0.001", "0.5", "10.00"]


def test_scalars(spark):
    df = spark.createDataFrame([(45285.2, "45285.2", "0.00100000")], "p double, a string, b string")
    assert one(df, decimals.checksum_lexeme(F.col("a"))) == "452852" and one(df, decimals.checksum_lexeme(F.col("b"))) == "100000"
    assert one(df, F.crc32(F.lit("123456789").cast("binary"))) == 3421780262 and records.crc32c(b"123456789") == 0xE3069283
    assert one(df, scalars.imbalance_percent(F.lit(3.0), F.lit(1.0))) == 50 and one(df, scalars.imbalance_percent(F.lit(0.0), F.lit(0.0))) == 0
    assert one(df, scalars.quantize(F.lit("-2.5").cast("decimal(18,9)"), "1")) == -2 and one(df, scalars.ns_to_sec(F.lit(-1))) == -1
    assert one(df, scalars.spread_bps(F.lit(101.0), F.lit(100.0))) is None and one(df, scalars.percent_change(F.lit(0.0), F.lit(1.0))) is None
    assert [one(df, scalars.classify_band(F.lit(x))) for x in (2.9, 3.0, -7.0, 11.0)] == [None, "small", "mid", "high"]
    assert one(df, scalars.venue_heat(F.lit(False), F.lit(9e9), F.lit(9e9), F.lit(100.0), F.lit(0.0))) == 0


# trade flow


def test_cumulative_delta(spark):
    t = spark.createDataFrame([trade(1, "buy", 100, 2, 1), trade(2, "sell", 100, 1, 2), trade(3, "buy", 100, 0.5, 3), trade(4, "unknown", 100, 9, 3)], TRADES)
    r = flow.cvd_totals(t).first()
    assert (r.cvd, r.buy_usd, r.sell_usd, r.trades) == (150, 250, 100, 4)
    w = spark.createDataFrame([trade(1, "buy", 100, 10, 100), trade(2, "sell", 1, 10, 200)], TRADES)
    assert [(r.trades, r.cvd) for r in flow.cvd_totals(flow.in_window(w, 50, now=F.lit(210))).collect()] == [(1, -10)]


def test_running_sums_cross_blocks(spark):
    rnd = random.Random(1)
    rows = [trade(i, rnd.choice(["buy", "sell", "unknown"]), rnd.randrange(1, 50), rnd.randrange(9), rnd.randrange(5 * 86_400)) for i in range(400)]
    got = {r.event_id: r.cvd for r in flow.cvd_points(spark.createDataFrame(rows, TRADES).repartition(7)).collect()}
    total = 0
    for r in sorted(rows, key=lambda r: (r[8], r[7], r[0])):
        total += {"buy": 1, "sell": -1}.get(r[6], 0) * r[4] * r[5]
        assert got[r[0]] == total


def test_as_of_crosses_blocks(spark):
    rnd = random.Random(2)
    left = [(i, "k", rnd.randrange(10 * 86_400)) for i in range(200)] + [(999, "other", 5)]
    right = [("k", rnd.randrange(10 * 86_400), i) for i in range(60)]
    got = {r.id: r.value for r in windows.as_of(spark.createDataFrame(left, "id long, k string, sec long"), spark.createDataFrame(right, "k string, sec long, value long"), ["k"], ["value"], tie="value").collect()}
    for i, k, s in left:
        before = [(t, v) for kk, t, v in right if kk == k and t <= s]
        assert got[i] == (max(before)[1] if before else None)


def test_book_numbers(spark):
    rows = [("b", "bid", 100, 2), ("b", "bid", 99, 3), ("b", "ask", 101, 1), ("b", "ask", 102, 1)]
    levels = spark.createDataFrame([(b, s, Decimal(p), Decimal(q)) for b, s, p, q in rows], "book_id string, side string, price decimal(18,0), quantity decimal(18,0)")
    r = books.pressure(levels, 10).first()
    assert (r.bid_usd, r.ask_usd) == (497, 203) and abs(r.bid_percent - 71) < 1e-9
    assert {(r.side, r.cum_quantity) for r in books.ladder(levels, 2).where("level = 2").collect()} == {("bid", 5), ("ask", 2)}
    assert books.slots(levels, 3).count() == 6 and books.slots(levels, 3).where("price is null").count() == 2


# ordered folds


def test_throttle_keeps_the_greedy_choice(spark):
    rnd = random.Random(4)
    rows = [(k, t, float(rnd.randrange(100))) for k in ("a", "b") for t in sorted(rnd.sample(range(2000), 150))]
    got = {(r.k, r.time) for r in sampling.throttled(spark.createDataFrame(rows, "k string, time long, bps double").repartition(9), 25, keys=["k"]).collect()}
    want, last = set(), {}
    for k, t, _ in rows:
        if k not in last or t - last[k] >= 25:
            last[k] = t
            want.add((k, t))
    assert got == want


def updates(rows):
    return [(b, o, s, f, u, p, [(float(x), float(y)) for x, y in bids], [(float(x), float(y)) for x, y in asks]) for b, o, s, f, u, p, bids, asks in rows]


UPDATES = "book string, ord long, snapshot boolean, first_seq long, last_seq long, previous_seq long, bids array<struct<p: double, q: double>>, asks array<struct<p: double, q: double>>"


@pytest.fixture(scope="module")
def feed(spark):
    rows = updates([
        ("a", 1, False, 1, 1, None, [(1, 1)], []), ("a", 2, True, None, 10, None, [(100, 1), (99, 2)], [(101, 2)]), ("a", 3, False, 8, 9, None, [(98, 1)], []), ("a", 4, False, 9, 12, None, [(100, 0)], [(102, 5)]),
        ("a", 5, False, 13, 13, None, [(101.5, 1)], []), ("a", 6, False, 13, 14, None, [], [(101, 0)]), ("a", 7, False, 17, 18, None, [(97, 1)], []), ("a", 8, False, 19, 19, None, [(96, 1)], []), ("a", 9, True, None, 30, None, [(50, 1)], [(60, 1)]),
        ("b", 1, True, None, 5, None, [(10, 1)], [(9, 1)]), ("b", 2, True, None, 6, None, [(10, 1)], [(11, 1)]),
    ])
    return spark.createDataFrame(rows, UPDATES)


WANT = [
    ("a", 1, "buffered", None, None), ("a", 2, "", 100, 101), ("a", 3, "stale", 100, 101), ("a", 4, "", 99, 101), ("a", 5, "crossed", 99, 101), ("a", 6, "", 99, 102), ("a", 7, "gap", None, None), ("a", 8, "buffered", None, None), ("a", 9, "", 50, 60),
    ("b", 1, "crossed snapshot", None, None), ("b", 2, "", 10, 11),
]


def test_book_fold(feed):
    got = live.fold_books(feed.repartition(5)).orderBy("book", "ord").collect()
    assert [(r.book, r.ord, r.reason, r.best_bid, r.best_ask) for r in got] == WANT
    kept = {r.ord: r.best_bid for r in live.fold_books(feed.where("book = 'a'"), lenient=True).collect()}
    assert kept[7] == 99
    assert live.fold_books(feed.where("false")).count() == 0


@pytest.mark.parametrize(("rule", "seq", "first", "last", "previous", "want"), [
    ("plus_one", 5, None, 6, None, "apply"), ("plus_one", 5, None, 7, None, "gap"), ("previous", 5, None, 9, 5, "apply"), ("previous", 5, None, 9, 4, "gap"), ("drop_stale", 5, None, 5, None, "skip"), ("drop_stale", 5, None, 99, None, "apply"),
    ("at_most_next", 5, 6, 8, None, "apply"), ("at_most_next", 5, 7, 8, None, "gap"), ("replace", 5, None, 1, None, "apply"),
])
def test_continuity_rules(rule, seq, first, last, previous, want):
    assert live.continuity(rule, live.Book(seq=seq, validity="valid", bridged=True), first, last, previous) == want


def test_fold_equals_last_change_of_each_level(spark):
    """Without gaps or crossings the ordered fold and the distributed form agree."""
    rnd = random.Random(6)
    rows, flat = [("x", 0, True, None, 0, None, [(p, 1) for p in range(50, 100)], [(p, 1) for p in range(101, 150)])], []
    for i in range(1, 300):
        rows.append(("x", i, False, i, i, None, [(rnd.randrange(50, 100), rnd.randrange(3))], [(rnd.randrange(101, 150), rnd.randrange(3))]))
    for b, o, s, _, _, _, bids, asks in rows:
        flat += [(b, o, s, "bid", float(p), float(q)) for p, q in bids] + [(b, o, s, "ask", float(p), float(q)) for p, q in asks]
    last = live.fold_books(spark.createDataFrame(updates(rows), UPDATES)).orderBy(F.desc("ord")).first()
    at = live.book_at(spark.createDataFrame(flat, "book string, ord long, snapshot boolean, side string, price double, quantity double"))
    r = at.agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("b"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("a"), F.count("*").alias("n")).first()
    assert (last.best_bid, last.best_ask, last.levels) == (r.b, r.a, r.n)


# streams


def drain(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_books_equal_batch(spark, feed, tmp_path):
    src = str(tmp_path / "updates")
    for a, b in ((1, 3), (4, 6), (7, 99)):
        feed.where(F.col("ord").between(a, b)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = drain(live.stream_books(stream), "append", tmp_path, "live_books").orderBy("book", "ord").collect()
    assert [(r.book, r.ord, r.reason, r.best_bid, r.best_ask) for r in got] == WANT


def test_stream_bars_equal_batch(spark, tmp_path):
    from ticklake.operators.bars import ohlcv

    rows = [trade(i, "buy", 100 + i % 7, 1, i * 13 % 600) for i in range(100)]
    df = spark.createDataFrame(rows, TRADES)
    src = str(tmp_path / "trades")
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    table = drain(stream_bars(stream, 60), "update", tmp_path, "live_bars")
    last = table.groupBy("venue", "instrument", "time").agg(F.max_by(F.struct("open", "high", "low", "close", "trades"), "trades").alias("r")).select("venue", "instrument", "time", "r.*")
    want = ohlcv(df, 60).select("venue", "instrument", "time", "open", "high", "low", "close", "trades")
    assert sorted(last.collect()) == sorted(want.collect())
    ids = spark.readStream.schema(df.schema).parquet(src).withColumn("trade_id", (F.col("event_id") % 10).cast("string"))
    assert drain(distinct_stream(ids), "append", tmp_path, "live_ids").count() == 10


# sources


def envelope(i, payload):
    return {"schema_version": 1, "venue_id": 2, "instrument_id": 3, "connection_id": 1, "session_id": 1, "frame_seq": i, "event_index": 0, "receive_ts": {"ns": i * 10**12}, "flags": 0, "payload": payload}


def fixed(coefficient, scale):
    return {"value": {"coefficient_lo": coefficient % 2**64, "coefficient_hi": coefficient >> 64, "scale": scale}}


def test_event_lines(spark, tmp_path):
    lines = [envelope(i, {"trade": {"price": fixed(12345, 2), "quantity": fixed(5, 1), "aggressor": "AGGRESSOR_SIDE_BUY", "trade_id": str(i)}} if i % 2 else {"venue_status": {"message": "ok"}}) for i in range(10)]
    lines.append(envelope(10, {"funding": {"rate": fixed(-1, 3)}}))
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, lines)))
    df = events.read_events(spark, str(tmp_path / "e.jsonl"))
    assert {r.kind: r["count"] for r in df.groupBy("kind").count().collect()} == {"trade": 5, "venue_status": 5, "funding": 1}
    r = events.tape_rows(df).first()
    assert (r.price, r.quantity, r.aggressor, r.notional) == (Decimal("123.45"), Decimal("0.5"), "buy", Decimal("61.725"))
    assert one(df.where("kind = 'funding'"), events.fixed_text(F.col("payload.funding.rate"))) == "-0.001"
    page = events.replay_page(df, 2, 4).collect()  # rows 2 to 5 hold two trades
    assert sorted(r.frame_seq for r in page) == [3, 5]
    events.write_events(df, str(tmp_path / "out"))
    again = events.read_events(spark, str(tmp_path / "out"))
    assert sorted(events.tape_rows(again).collect()) == sorted(events.tape_rows(df).collect())
    (tmp_path / "bad.jsonl").write_text('{"schema_version": ')
    assert events.read_events(spark, str(tmp_path / "bad.jsonl"), strict=False).first()._corrupt


def test_command_lines(spark):
    df = spark.createDataFrame([(x,) for x in ("TRADE 5 100.5 2 BUY id1", "TRADE 6 1 1 SELL", "BOOK_SNAP 7 BID 10:1,9:2 ASK 11:3", "BOOK_DELTA 8 ASK DELETE 11", "QUOTE 1 2", "SUB X", "NOPE")], "value string")
    r = events.parse_lines(df).collect()
    assert [x.kind for x in r] == ["trade", "trade", "book_snap", "book_delta", "quote", "sub", "unknown"]
    assert (r[0].seq, r[0].side, r[0].price, r[0].trade_id, r[1].trade_id) == (5, "buy", Decimal("100.5"), "id1", None)
    assert [int(x.price) for x in r[2].bids] == [10, 9] and (r[3].side, r[3].operation, r[3].quantity) == ("ask", "delete", None) and r[4]["fields"] == ["1", "2"]


FRAMES = {
    "binance": [
        ('{"e":"trade","E":2,"s":"BTCUSDT","t":9,"p":"100.10","q":"0.5","T":1,"m":true}', [("trade", "100.10", "sell")]),
        ('{"e":"depthUpdate","E":2,"s":"BTCUSDT","U":1,"u":3,"pu":0,"b":[["1.0","2"]],"a":[]}', [("book_delta", None, None)]), ('{"lastUpdateId":100,"bids":[["100.0","1"]],"asks":[["101.0","2"]]}', [("book_snapshot", None, None)]),
        ('{"e":"markPriceUpdate","E":1,"s":"BTCUSDT","p":"10","i":"11","r":"0.0001","T":5}', [("mark_price", "10", None), ("index_price", "11", None), ("funding", None, None)]),
        ('{"e":"forceOrder","E":1,"o":{"s":"BTCUSDT","S":"SELL","p":"9","q":"1","T":4}}', [("liquidation", "9", "sell")]), ('{"result":null,"id":1}', [("unknown_message", None, None)]),
    ],
    "okx": [('{"arg":{"channel":"trades","instId":"BTC-USDT"},"data":[{"instId":"BTC-USDT","tradeId":"1","px":"7","sz":"1","side":"buy","ts":"1"},{"instId":"BTC-USDT","tradeId":"2","px":"8","sz":"1","side":"sell","ts":"2"}]}', [("trade", "7", "buy"), ("trade", "8", "sell")])],
    "bybit": [('{"topic":"publicTrade.BTCUSDT","type":"snapshot","ts":3,"data":[{"T":1,"s":"BTCUSDT","S":"Buy","v":"1","p":"5","i":"x"}]}', [("trade", "5", "buy")]), ('{"topic":"allLiquidation.BTCUSDT","type":"snapshot","ts":3,"data":[{"T":1,"s":"BTCUSDT","S":"Buy","v":"1","p":"5"}]}', [("liquidation", "5", "sell")])],
    "kraken": [('{"channel":"trade","type":"update","data":[{"symbol":"BTC/USD","price":1.50,"qty":2,"side":"buy","trade_id":1,"timestamp":"2024-01-01T00:00:00.000001Z"}]}', [("trade", "1.50", "buy")])],
    "coinbase": [('{"type":"match","product_id":"BTC-USD","price":"3","size":"1","side":"buy","trade_id":4,"time":"2024-01-01T00:00:00Z"}', [("trade", "3", "sell")])],
}


@pytest.mark.parametrize("venue", sorted(FRAMES))
def test_venue_frames(spark, venue):
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(FRAMES[venue])], "id int, value string")
    got = venues.normalize(df, venue).orderBy("id", "event_index").collect()
    want = [(i, k, p and Decimal(p), s) for i, (_, rows) in enumerate(FRAMES[venue]) for k, p, s in rows]
    assert [(r.id, r.kind, r.price, r.side) for r in got] == want


def test_quality_operators(spark):
    seq = spark.createDataFrame([("s", x) for x in (1, 2, 5, 9, 200_003)], "session string, seq long")
    assert sorted((r.after, r.next, r.missing) for r in stream_quality.sequence_gaps(seq).collect()) == [(2, 5, 2), (5, 9, 3), (9, 200_003, 199_993)]
    frames = spark.createDataFrame([("s", 1, 0, 0), ("s", 2, 10**9, 10**9), ("s", 3, 5 * 10**9, 2 * 10**9)], "session string, frame_seq long, receive_ts_ns long, monotonic_ns long")
    assert [(r.frame_seq, r.jump_ns) for r in stream_quality.clock_jumps(frames).collect()] == [(3, 3 * 10**9)]
    t = spark.createDataFrame([(1, "v", "a", 5, 1.0, 1.0), (2, "v", "a", 4, 1.0, 1.0), (3, "v", None, 4, 1.0, 1.0), (4, "v", None, 4, 1.0, 1.0)], "event_id long, venue string, trade_id string, exchange_ts_ns long, price double, quantity double")
    assert sorted(r.event_id for r in stream_quality.distinct_trades(t).collect()) == [2, 3, 4]
    assert sorted(r.event_id for r in stream_quality.distinct_trades(t, by_content=True).collect()) == [2, 3]
    status = spark.createDataFrame([(9, 5000, False, 0, 3), (1, 10, True, 5, 5)], "age_s int, lag_ms int, has_book boolean, trades int, quotes int")
    assert [r.badges for r in stream_quality.market_quality(status).collect()] == [["stale", "lag", "no-l2", "quotes-only"], []]
