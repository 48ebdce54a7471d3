"""Queries of alert rules, and of small operators that had none, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, symbols
from ..operators import alerts, bars, books, markets, movers
from ..sources.tables import book_levels, listings, tape, trades, venue_states
from ..sources.venues import FIELDS, coinbase_candles
from ..streaming.books import fold_books
from . import catalog, feeds
from .catalog import HOUR, KEYS, bars_sql, query

#: A counter of a venue's trades that starts again from 0 now and then, sampled with each of them.
SAMPLES = """s as (select venue as id, sec, event_id, (event_id % 500) as value from trades),
  i as (select *, lag(value) over (partition by id order by sec, event_id) as before from s),
  n as (select *, case when before is null then 0 when value < before then value else value - before end as increase from i)"""


def _samples(spark, sf_dir):
    return trades(spark, sf_dir).select(F.col("venue").alias("id"), "sec", "event_id", F.pmod("event_id", F.lit(500)).alias("value"))


@query("id sec:l event_id:l value:l increase:l", sql=SAMPLES + ", q as (select * from n)")
def counter_increases(spark, sf_dir):
    return alerts.increases(_samples(spark, sf_dir), keys=["id"], order=["event_id"])


RATES = SAMPLES + """, b as (select id, ceil(sec / 600.0)::bigint * 600 as slot, sum(increase) as increase from n group by 1, 2),
  w as (select id, unnest(range(slot, slot + 3600, 600)) as time, increase from b), r as (select id, time, sum(increase) / 3600 as per_second from w group by 1, 2)"""


@query("id time:l per_second:d", sql=RATES + ", q as (select * from r)")
def counter_rates(spark, sf_dir):
    counted = alerts.increases(_samples(spark, sf_dir), keys=["id"], order=["event_id"])
    return alerts.rates(counted, keys=["id"], window=3600, step=600)


@query("id time:l per_second:d since:l state", sql=RATES + """, e as (select *, per_second > 0.15 as on_, lag(per_second > 0.15) over v as prior, time - lag(time) over v as gap from r window v as (partition by id order by time)),
  g as (select *, case when on_ and not coalesce(prior and gap <= 600, false) then time end as began from e), h as (select *, case when on_ then last_value(began ignore nulls) over (partition by id order by time) end as since from g),
  q as (select id, time, per_second, since, case when not on_ then 'inactive' when time - since >= 1800 then 'firing' else 'pending' end as state from h)""")  # fmt: skip
def rate_alerts(spark, sf_dir):
    counted = alerts.increases(_samples(spark, sf_dir), keys=["id"], order=["event_id"])
    rate = alerts.rates(counted, keys=["id"], window=3600, step=600)
    return alerts.states(rate, F.col("per_second") > 0.15, 1800, keys=["id"], step=600)


@query("event_id:l operation", sql="q as (select event_id, case when quantity % 4 = 0 then 'delete' else 'upsert' end as operation from tape)")
def level_operations(spark, sf_dir):
    return tape(spark, sf_dir).withColumn("operation", books.level_operation(F.col("quantity") % 4))


@query("book ord:l bid_price:d ask_price:d", sql="""u as (select 'b' || (o_orderkey // 500) % 32 as book, o_orderkey as n, 100 + o_orderkey % 7 as bid, o_orderkey % 83 = 0 as snapshot, 200 + o_orderkey % 5 as ask from orders where o_orderkey % 97 <> 0),
  r as (select *, sum(snapshot::int) over (partition by book order by n) as run from u), f as (select *, max(bid) over w as bid_price, min(ask) over w as ask_price from r window w as (partition by book, run order by n)),
  q as (select book, n as ord, bid_price, ask_price from f where run > 0)""")  # fmt: skip
def book_quotes(spark, sf_dir):
    return books.quotes_of(fold_books(feeds._updates(spark, sf_dir), rule="replace"))


@query("book_id:l tick:d", "book", sql=f"z as ({catalog.oracle_sql()['inferred_tick']}), q as (select book_id, case when book_id % 3 = 1 then book_id / 100.0 else tick end as tick from z)")
def resolved_ticks(spark, sf_dir):
    levels = book_levels(spark, sf_dir)
    wanted = levels.select("book_id").distinct().withColumn("tick", F.when(F.col("book_id") % 3 == 1, F.col("book_id") / 100).when(F.col("book_id") % 3 == 2, F.lit(0.0)))
    return books.resolved_tick(levels, wanted)


@query("venue symbol instrument:l", "listings", sql="q as (select distinct venue, symbol, instrument from listings where (venue, symbol) in (select (venue, symbol) from listings where instrument % 5 = 0))")
def requested_markets(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return markets.requested(rows, rows.where("instrument % 5 = 0")).distinct()


@query("way venue symbol instrument:l", "listings", sql="""a as (select *, instrument % 4 > 0 as active from listings), q as (select 'ids' as way, venue, symbol, instrument from a where instrument in (3, 14, 15, 92)
  union all select 'symbols', venue, symbol, instrument from a where symbol in ('BTCUSDT', 'XBT/USD') union all select 'active', venue, symbol, instrument from a where active)""")  # fmt: skip
def selected_instruments(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("active", F.col("instrument") % 4 > 0)
    ways = {"ids": {"ids": [3, 14, 15, 92]}, "symbols": {"symbols": ["BTCUSDT", "XBT/USD"]}, "active": {}}
    parts = [markets.selected(rows, **how).select(F.lit(way).alias("way"), "venue", "symbol", "instrument") for way, how in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("venue symbol place:l", "listings", sql="m as (select venue, symbol, instrument, substr(symbol, 1, 3) as asset from listings), q as (select venue, symbol, row_number() over (order by case when asset = 'BTC' then 0 else 1 end, venue, symbol, instrument) as place from m)")
def ordered_markets(spark, sf_dir):
    from pyspark.sql import Window

    rows = listings(spark, sf_dir).withColumn("asset", F.substring("symbol", 1, 3))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*markets.market_order("BTC"), "instrument")))  # a catalog's rows


@query("venue receive_ts_ns:l mid:d", sql="q as (select distinct venue, exchange_ts_ns - exchange_ts_ns % 36000000000000 as receive_ts_ns, floor(price) + 0.5 as mid from tape where kind = 'quote')")
def distinct_quotes(spark, sf_dir):
    ts, bid = F.col("exchange_ts_ns"), F.floor("price").cast("decimal(18,1)")
    quotes = tape(spark, sf_dir).where("kind = 'quote'").select("venue", (ts - ts % 36_000_000_000_000).alias("receive_ts_ns"), bid.alias("bid_price"), (bid + 1).alias("ask_price"))
    return markets.distinct_quotes(quotes).withColumn("mid", (F.col("bid_price") + F.col("ask_price")) / 2)


@query("event_id:l ns:l start:l end_:l interval:l", sql="q as (select event_id, exchange_ts_ns + 7 as ns, sec - sec % 86400 as start, sec - sec % 86400 + 86399 as end_, [60, 300, 900, 3600, 86400][event_id % 5 + 1]::bigint * 1000000000 as interval from tape)")
def event_times(spark, sf_dir):
    """RFC 3339 texts with nine digits, days and candle intervals of all events."""
    t = tape(spark, sf_dir)
    micros = F.expr("exchange_ts_ns div 1000")
    text = F.concat(F.date_format(F.timestamp_seconds("sec"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lit("007Z"))
    day = scalars.utc_day_bounds(F.col("sec"))
    name = F.element_at(F.array(*[F.lit(x) for x in symbols.INTERVALS]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.select("event_id", symbols.rfc3339_ns(text).alias("ns"), day["start"].alias("start"), day["end"].alias("end_"), symbols.interval_ns(name).alias("interval"))


MOVES = bars_sql("h", HOUR) + """, m as (select venue, instrument, time, notional::double as notional, avg(notional::double) over w as mean, count(*) over w as prior, (close::double - open::double) / open::double * 100 as change from h
  window w as (partition by venue, instrument order by time rows between 24 preceding and 1 preceding)), g as (select * from m where coalesce(mean > 0 and notional >= mean * 1.2, false))"""


@query("venue instrument time:l kind band change:d limited", sql=MOVES + """, q as (select venue, instrument, time, case when change > 0 then 'up_high_volume' else 'down_high_volume' end as kind,
  case when abs(change) >= 7 and abs(change) < 11 then 'small' when abs(change) >= 11 and abs(change) < 15 then 'mid' when abs(change) >= 15 then 'high' end as band, change, prior < 24 as limited from g where abs(change) >= 7)""")  # fmt: skip
def high_volume_moves(spark, sf_dir):
    h = bars.ohlcv(trades(spark, sf_dir), HOUR)
    return movers.high_volume_moves(bars.high_volume_gate(h, times=1.2), h)


@query("venue instrument:l start_ns:l open:d high:d low:d close:d volume:d", sql=bars_sql("h", HOUR) + ", q as (select venue, instrument, time * 1000000000 as start_ns, open, high, low, close, volume from h)")
def rest_candles(spark, sf_dir):
    """Bars as a REST answer lists them, read again."""
    h = bars.ohlcv(trades(spark, sf_dir), HOUR)
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    row = F.concat(F.lit("[["), F.concat_ws(",", F.col("time").cast("string"), *map(text, ("low", "high", "open", "close", "volume"))), F.lit("]]"))
    got = h.select(*KEYS, coinbase_candles(row, F.lit("BTC-USD")).alias("e"))
    return got.select(*KEYS, *[f"e.{n}" for n in FIELDS if n in ("start_ns", "open", "high", "low", "close", "volume")])


@query("section total:l live:l", "listings", sql="m as (select l.*, coalesce(live, false) as live from listings l left join states using (venue)), q as (select venue as section, count(*) as total, count(*) filter (where live) as live from m group by 1)")
def venue_sections(spark, sf_dir):
    rows = listings(spark, sf_dir).join(venue_states(spark, sf_dir).select("venue", "live"), "venue", "left").withColumns({"live": F.coalesce("live", F.lit(False)), "kind": F.lit("spot")})
    return markets.sections(rows, "venue")
