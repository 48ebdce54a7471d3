"""Queries that write venue messages of the tape's trades and read them again, and that fold updates to
books, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bars, books, sampling
from ..sources.accounts import account_events
from ..sources.more_venues import bind_channels
from ..sources.tables import book_levels, depth_history, read_table, trades
from ..sources.venues import normalize
from ..streaming.books import fold_books, fold_sessions
from .catalog import query

#: A trade as each venue writes it; <id> <p> <q> <ms> <us> <ns> are its fields, <s> and <S> its side, <m> the other one.
TRADE = {
    "binance": '{"e":"trade","s":"BTCUSDT","t":<id>,"p":"<p>","q":"<q>","T":<ms>,"m":<sold>}',
    "okx": '{"arg":{"channel":"trades","instId":"BTC-USDT"},"data":[{"instId":"BTC-USDT","tradeId":"<id>","px":"<p>","sz":"<q>","side":"<s>","ts":"<ms>"}]}',
    "bybit": '{"topic":"publicTrade.BTCUSDT","type":"snapshot","ts":<ms>,"data":[{"T":<ms>,"s":"BTCUSDT","S":"<S>","v":"<q>","p":"<p>","i":"<id>"}]}',
    "kraken": '{"channel":"trade","type":"update","data":[{"symbol":"BTC/USD","side":"<s>","price":<p>,"qty":<q>,"trade_id":<id>,"timestamp":"2024-01-01T00:00:00.000001Z"}]}',
    "coinbase": '{"type":"match","trade_id":<id>,"side":"<m>","size":"<q>","price":"<p>","product_id":"BTC-USD","time":"2024-01-01T00:00:00Z"}',
    "kraken_futures": '{"feed":"trade","product_id":"PI_XBTUSD","uid":"<id>","side":"<s>","type":"fill","seq":1,"time":<ms>,"qty":<q>,"price":<p>}',
    "deribit": '{"params":{"channel":"trades.BTC-PERPETUAL.raw","data":[{"trade_id":"<id>","timestamp":<ms>,"price":<p>,"instrument_name":"BTC-PERPETUAL","direction":"<s>","amount":<q>}]}}',
    "bitstamp": '{"event":"trade","channel":"live_trades_btcusd","data":{"id":<id>,"amount_str":"<q>","price_str":"<p>","type":<sell>,"microtimestamp":"<us>"}}',
    "gemini": '{"E":<ns>,"s":"btcusd","t":<id>,"p":"<p>","q":"<q>","m":<sold>}',
    "coinbase_advanced": '{"channel":"market_trades","timestamp":"2024-01-01T00:00:00Z","sequence_num":0,"events":[{"type":"update","trades":[{"trade_id":"<id>","product_id":"BTC-USD","price":"<p>","size":"<q>","side":"<m>","time":"2024-01-01T00:00:00Z"}]}]}',
    "coinbase_intl": '{"sequence":1,"product_id":"BTC-PERP","time":"2024-01-01T00:00:00Z","channel":"MATCH","type":"UPDATE","match_id":"<id>","trade_qty":"<q>","aggressor_side":"<U>","trade_price":"<p>"}',
    "bitfinex": '[7,"te",[<id>,<ms>,<signed>,<p>]]',
}
#: A bid's new quantity likewise.
BID = {
    "binance": '{"e":"depthUpdate","E":<ms>,"s":"BTCUSDT","U":<id>,"u":<id>,"b":[["<p>","<q>"]],"a":[]}',
    "okx": '{"arg":{"channel":"books","instId":"BTC-USDT"},"action":"update","data":[{"asks":[],"bids":[["<p>","<q>","0","1"]],"ts":"<ms>","seqId":<id>,"prevSeqId":0}]}',
    "bybit": '{"topic":"orderbook.50.BTCUSDT","type":"delta","ts":<ms>,"data":{"s":"BTCUSDT","b":[["<p>","<q>"]],"a":[],"u":<id>,"seq":1}}',
    "kraken": '{"channel":"book","type":"update","data":[{"symbol":"BTC/USD","bids":[{"price":<p>,"qty":<q>}],"asks":[],"checksum":1,"timestamp":"2024-01-01T00:00:00Z"}]}',
    "coinbase": '{"type":"l2update","product_id":"BTC-USD","time":"2024-01-01T00:00:00Z","changes":[["buy","<p>","<q>"]]}',
    "kraken_futures": '{"feed":"book","product_id":"PI_XBTUSD","side":"buy","seq":<id>,"price":<p>,"qty":<q>,"timestamp":<ms>}',
    "deribit": '{"params":{"channel":"book.BTC-PERPETUAL.raw","data":{"type":"change","timestamp":<ms>,"instrument_name":"BTC-PERPETUAL","change_id":<id>,"prev_change_id":0,"bids":[["change",<p>,<q>]],"asks":[]}}}',
    "bitstamp": '{"event":"data","channel":"diff_order_book_btcusd","data":{"microtimestamp":"<us>","bids":[["<p>","<q>"]],"asks":[]}}',
    "gemini": '{"e":"depthUpdate","E":<ns>,"s":"btcusd","U":<id>,"u":<id>,"b":[["<p>","<q>"]],"a":[]}',
    "coinbase_advanced": '{"channel":"l2_data","timestamp":"2024-01-01T00:00:00Z","sequence_num":<id>,"events":[{"type":"update","product_id":"BTC-USD","updates":[{"side":"bid","price_level":"<p>","new_quantity":"<q>"}]}]}',
    "coinbase_intl": '{"sequence":<id>,"product_id":"BTC-PERP","time":"2024-01-01T00:00:00Z","channel":"LEVEL2","type":"UPDATE","changes":[["BUY","<p>","<q>"]]}',
    "bitfinex": "[8,[<p>,1,<q>]]",
}
ACKS = '{"event":"subscribed","channel":"trades","chanId":7,"symbol":"tBTCUSD"}', '{"event":"subscribed","channel":"book","chanId":8,"symbol":"tBTCUSD"}'


def _filled(template: str) -> Column:
    buy = F.col("aggressor") == "buy"
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    fields = {
        "id": F.col("event_id").cast("string"), "p": text("price"), "q": text("quantity"), "ms": F.floor(F.col("exchange_ts_ns") / 1_000_000).cast("string"), "us": F.floor(F.col("exchange_ts_ns") / 1000).cast("string"), "ns": F.col("exchange_ts_ns").cast("string"),
        "s": F.when(buy, "buy").otherwise("sell"), "S": F.when(buy, "Buy").otherwise("Sell"), "U": F.when(buy, "BUY").otherwise("SELL"), "m": F.when(buy, "sell").otherwise("buy"), "sold": F.when(buy, "false").otherwise("true"),
        "sell": F.when(buy, "0").otherwise("1"), "signed": F.concat(F.when(buy, "").otherwise("-"), text("quantity")),
    }
    parts = [p.partition(">") for p in template.split("<")]
    return F.concat(F.lit(parts[0][0]), *[x for name, _, rest in parts[1:] for x in (fields[name], F.lit(rest))])


def _events(spark, sf_dir, templates: dict[str, str]) -> DataFrame:
    rows = trades(spark, sf_dir).where("aggressor <> 'unknown' and quantity > 0")
    out = []
    for venue, template in templates.items():
        raw = rows.select("event_id", F.lit(1).alias("session"), _filled(template).alias("value"))
        if venue == "bitfinex":
            acks = spark.createDataFrame([(-1, 1, x) for x in ACKS], "event_id long, session int, value string")
            raw = bind_channels(raw.unionByName(acks), order="event_id").where("event_id >= 0")
        out.append(normalize(raw, venue, keep=("event_id",)).withColumn("venue", F.lit(venue)))
    return reduce(DataFrame.unionByName, out)


EVERY = f"v as (select unnest({list(TRADE)}) as feed), t as (select * from trades where aggressor <> 'unknown' and quantity > 0)"


@query("event_id:l venue kind side price:d quantity:d trade_id", sql=EVERY + ", q as (select event_id, feed as venue, 'trade' as kind, aggressor as side, price, quantity, event_id::varchar as trade_id from t, v)")
def normalized_trades(spark, sf_dir):
    return _events(spark, sf_dir, TRADE)


@query("event_id:l venue kind bid:d size:d", sql=EVERY + ", q as (select event_id, feed as venue, 'book_delta' as kind, price as bid, quantity as size from t, v)")
def normalized_book_changes(spark, sf_dir):
    got = _events(spark, sf_dir, BID)
    return got.withColumns({"bid": F.col("bids")[0][0], "size": F.col("bids")[0][1]})


def _updates(spark, sf_dir) -> DataFrame:
    """Runs of numbered updates with holes, a snapshot now and then, of 32 books."""
    n = F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0")
    level = lambda p: F.array(F.array(p.cast("string"), F.lit("1")))
    return rows.select(
        F.concat(F.lit("b"), F.pmod(F.floor(n / 500), F.lit(32)).cast("string")).alias("book"), n.alias("ord"), (n % 83 == 0).alias("snapshot"), n.alias("first_seq"), n.alias("last_seq"), (n - 1).alias("previous_seq"),
        level(100 + n % 7).alias("bids"), level(200 + n % 5).alias("asks"), F.pmod(n, F.lit(3)).alias("session"),
    )


FOLD = """u as (select 'b' || (o_orderkey // 500) % 32 as book, o_orderkey as n, o_orderkey % 83 = 0 as snapshot from orders where o_orderkey % 97 <> 0), l as (select *, lag(n) over (partition by book order by n) as before from u),
  r as (select *, sum(snapshot::int) over (partition by book order by n) as run from l), g as (select *, not snapshot and n <> before + 1 as hole from r), h as (select *, sum(hole::int) over (partition by book, run order by n) as holes from g),
  q as (select book, n as ord, case when run = 0 then 'uninitialized' when holes > 0 then 'invalid' else 'valid' end as validity, case when run = 0 then 'buffered' when hole and holes = 1 then 'gap' when holes > 0 then 'buffered' else '' end as reason from h)"""


@query("book ord:l validity reason", sql=FOLD)
def book_fold(spark, sf_dir):
    return fold_books(_updates(spark, sf_dir), rule="plus_one")


@query("book ord:l best_bid:d levels:l", sql="""u as (select 'b' || (o_orderkey // 500) % 32 as book, o_orderkey as n, 100 + o_orderkey % 7 as bid, o_orderkey % 83 = 0 as snapshot, 200 + o_orderkey % 5 as ask from orders where o_orderkey % 97 <> 0), r as (select *, sum(snapshot::int) over (partition by book order by n) as run from u),
  f as (select *, row_number() over (partition by book, run, bid order by n) = 1 as nb, row_number() over (partition by book, run, ask order by n) = 1 as na from r),
  q as (select book, n as ord, case when run > 0 then max(bid) over w end as best_bid, case when run > 0 then sum(nb::int + na::int) over w else 0 end as levels from f window w as (partition by book, run order by n))""")  # fmt: skip
def books_without_numbers(spark, sf_dir):
    return fold_books(_updates(spark, sf_dir), rule="replace")


@query("session:l ord:l validity", sql="""u as (select o_orderkey % 3 as session, o_orderkey as n, 'b' || (o_orderkey // 500) % 32 as book, o_orderkey % 83 = 0 as snapshot from orders where o_orderkey % 97 <> 0),
  l as (select *, coalesce(lag(n) over (partition by session order by n) + 3 <> n, false) as hole, min(n) over (partition by session, book) as started from u), h as (select *, sum(hole::int) over (partition by session order by n) as holes from l),
  s as (select *, last_value(case when snapshot then holes end ignore nulls) over (partition by session, book order by n) as since, first_value(holes - hole::int) over (partition by session, book order by n) as first_holes from h),
  q as (select session, n as ord, case when since is not null then case when since = holes then 'valid' else 'invalid' end when holes > first_holes then 'invalid' else 'uninitialized' end as validity from s)""")  # fmt: skip
def session_fold(spark, sf_dir):
    return fold_sessions(_updates(spark, sf_dir).withColumn("last_seq", F.floor(F.col("ord") / 3).cast("long")))


@query("event_id:l kind symbol order_id status price:d quantity:d filled:d fee:d", sql="""t as (select * from trades where aggressor <> 'unknown'), q as (
  select event_id, 'order' as kind, 'BTCUSDT' as symbol, event_id::varchar as order_id, 'PARTIALLY_FILLED' as status, price, quantity + 1 as quantity, quantity as filled, null::double as fee from t
  union all select event_id, 'fill', 'BTCUSDT', event_id::varchar, null, price + 1, quantity, null, 0.25 from t where aggressor = 'buy')""")  # fmt: skip
def account_orders(spark, sf_dir):
    rows = trades(spark, sf_dir).where("aggressor <> 'unknown'")
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    more = lambda c: (F.col(c) + 1).cast("decimal(18,2)").cast("string")
    kind = F.when(F.col("aggressor") == "buy", "TRADE").otherwise("CANCELED")
    value = F.format_string('{"e":"executionReport","E":1,"s":"BTCUSDT","c":"c","q":"%s","p":"%s","x":"%s","X":"PARTIALLY_FILLED","i":%d,"l":"%s","z":"%s","L":"%s","n":"0.25","t":5}', more("quantity"), text("price"), kind, "event_id", text("quantity"), text("quantity"), more("price"))
    return account_events(rows.select("event_id", value.alias("value")), "binance")


@query("venue instrument time:l open:d close:d volume:d buy_quantity:d sell_quantity:d", sql="""q as (select venue, instrument, sec - sec % 3600 as time, arg_min(price, (exchange_ts_ns, event_id)) as open, arg_max(price, (exchange_ts_ns, event_id)) as close, sum(quantity) as volume,
  sum(case aggressor when 'buy' then quantity else 0 end) as buy_quantity, sum(case aggressor when 'sell' then quantity else 0 end) as sell_quantity from trades group by 1, 2, 3)""")  # fmt: skip
def bars_without_unknown_sides(spark, sf_dir):
    return bars.ohlcv(trades(spark, sf_dir), 3600, unknown="ignore")


@query("venue instrument time:l volume:d buy_quantity:d sell_quantity:d buy_notional:d", sql="""q as (select venue, instrument, sec - sec % 3600 as time, sum(quantity) as volume, sum(quantity * case aggressor when 'buy' then 1 when 'sell' then 0 else 0.5 end) as buy_quantity,
  sum(quantity * case aggressor when 'sell' then 1 when 'buy' then 0 else 0.5 end) as sell_quantity, sum(price * quantity * case aggressor when 'buy' then 1 when 'sell' then 0 else 0.5 end) as buy_notional from trades group by 1, 2, 3)""")  # fmt: skip
def volume_bars(spark, sf_dir):
    return bars.ohlcv(trades(spark, sf_dir), 3600, unknown="half")


@query("venue instrument day:l time:l buy_usd:d sell_usd:d", sql="""f as (select venue, instrument, sec // 86400 as day, sec as time, sum(case aggressor when 'buy' then price * quantity else 0 end)::double as b, 0 - sum(case aggressor when 'sell' then price * quantity else 0 end)::double as s from trades group by 1, 2, 3, 4),
  n as (select *, lead(time) over (partition by venue, instrument, day order by time) as after from f), g as (select *, unnest(range(time, case when after - time > 2 then after else time + 1 end)) as at_ from n),
  q as (select venue, instrument, day, at_ as time, case when at_ = time then b else 0 end as buy_usd, case when at_ = time then s else 0 end as sell_usd from g)""")  # fmt: skip
def zero_filled_flow(spark, sf_dir):
    days = trades(spark, sf_dir).withColumn("day", F.floor(F.col("sec") / 86_400).cast("long"))
    return bars.zero_filled_flow(days, keys=["venue", "instrument", "day"])


@query("book_id:l imbalance_percent:d", "book", sql="""r as (select * from book where quantity > 0 qualify row_number() over (partition by book_id, side order by case side when 'bid' then -price else price end) <= 10),
  s as (select book_id, coalesce(sum(price * quantity) filter (where side = 'bid'), 0)::double as b, coalesce(sum(price * quantity) filter (where side = 'ask'), 0)::double as a from r group by 1), q as (select book_id, case when a + b > 0 then (b - a) / (a + b) * 100 end as imbalance_percent from s)""")  # fmt: skip
def book_imbalance(spark, sf_dir):
    return books.book_imbalance(book_levels(spark, sf_dir))


@query("book_id:l t:l levels:l", "depth", sql="""x as (select book_id, max(t) as tip from depth group by 1), d as (select distinct book_id, t from depth), a as (select d.book_id, t, case when t >= tip - 6000 then 250 when t >= tip - 12000 then 1000 else 5000 end as w from d join x using (book_id)),
  k as (select book_id, w, t - t % w as bucket, max(t) as t from a group by 1, 2, 3), n as (select book_id, t from k qualify row_number() over (partition by book_id order by t desc) <= 20), q as (select book_id, t, count(*) as levels from depth semi join n on depth.book_id = n.book_id and depth.t = n.t group by 1, 2)""")  # fmt: skip
def compacted_depth(spark, sf_dir):
    kept = sampling.compacted_depth(depth_history(spark, sf_dir), keys=["book_id"], most=20, recent_ms=6000, mid_ms=12_000)
    return kept.groupBy("book_id", "t").agg(F.count(F.lit(1)).alias("levels"))
