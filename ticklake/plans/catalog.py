"""Market-data queries by name, and the SQL that checks them.

Results carry longs, strings and doubles rounded to six places, so both engines print the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bars, books, cross_venue, flow, movers, sampling, stream_quality, windows
from ..sources.tables import SQL, book_levels, instruments, sequence_ids, tape, trades
from ..streaming.books import book_at

HOUR, DAY = 3600, 86_400
KEYS = ["venue", "instrument"]
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def plain(df: DataFrame, columns: str) -> DataFrame:
    """The named columns; ``name:d`` as a rounded double, ``name:l`` as a long."""
    kind = {"d": lambda c: F.round(c.cast("double"), 6), "l": lambda c: c.cast("long")}
    return df.select(*[(kind[k](F.col(n)) if k else F.col(n)).alias(n) for n, _, k in (x.partition(":") for x in columns.split())])


def query(columns: str, views: str = "tape", sql: str | None = None):
    """Register a query, and its SQL: ``sql`` is one or more named queries, the last named ``q``."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir), columns)
        if sql:
            kind = {"d": "round({0}::double, 6) as {0}", "l": "{0}::bigint as {0}", "": "{0}"}
            out = ", ".join(kind[k].format(n) for n, _, k in (x.partition(":") for x in columns.split()))
            _oracle[f.__name__] = f"with recursive {', '.join(SQL[v] for v in views.split())}, {sql} select {out} from q"
        return f

    return add


def bars_sql(name: str, step: int, source: str = "trades") -> str:
    return f"""{name} as (select venue, instrument, sec - sec % {step} as time, arg_min(price, (exchange_ts_ns, event_id)) as open, max(price) as high, min(price) as low,
  arg_max(price, (exchange_ts_ns, event_id)) as close, sum(quantity) as volume, sum(price * quantity) as notional, count(*) as trades,
  sum(case when aggressor = 'buy' then quantity else 0 end) as buy_quantity, sum(case when aggressor = 'buy' then 0 else quantity end) as sell_quantity,
  sum(case when aggressor = 'buy' then price * quantity else 0 end) as buy_notional from {source} group by all)"""


BARS = "venue instrument time:l open:d high:d low:d close:d volume:d notional:d trades:l buy_quantity:d sell_quantity:d buy_notional:d"


@query(BARS, sql=bars_sql("q", HOUR))
def bars_hourly(spark, sf_dir):
    return bars.ohlcv(trades(spark, sf_dir), HOUR)


@query("venue instrument time:l open:d high:d low:d close:d volume:d trades:l", sql=bars_sql("h", HOUR) + f""", q as (select venue, instrument, time - time % {DAY} as time, arg_min(open, h.time) as open, max(high) as high, min(low) as low,
  arg_max(close, h.time) as close, sum(notional) as volume, sum(trades) as trades from h group by 1, 2, 3)""")  # fmt: skip
def bars_daily_rolled_up(spark, sf_dir):
    return bars.roll_up(bars.ohlcv(trades(spark, sf_dir), HOUR), DAY)


@query("venue instrument high:d low:d volume:d notional:d trades:l first_sec:l last_sec:l last_price:d previous_price:d", sql="""q as (select venue, instrument, max(price) as high, min(price) as low, sum(quantity) as volume, sum(price * quantity) as notional, count(*) as trades,
  min(sec) as first_sec, max(sec) as last_sec, list(price order by exchange_ts_ns desc, event_id desc)[1] as last_price, list(price order by exchange_ts_ns desc, event_id desc)[2] as previous_price from trades group by 1, 2)""")  # fmt: skip
def session_stats(spark, sf_dir):
    return bars.session_stats(trades(spark, sf_dir))


@query("venue instrument volume:d notional:d trades:l trades_per_min:d", sql=bars_sql("h", HOUR) + f""", tip as (select venue, instrument, max(time) as tip from h group by 1, 2), q as (
  select venue, instrument, sum(volume) as volume, sum(notional) as notional, sum(trades) as trades, sum(trades) / {DAY} * 60 as trades_per_min from h join tip using (venue, instrument) where time >= tip - {DAY} group by 1, 2)""")  # fmt: skip
def window_stats(spark, sf_dir):
    return bars.window_stats(bars.ohlcv(trades(spark, sf_dir), HOUR), DAY)


@query("venue instrument time:l notional:d prior_mean:d prior_bars:l high_volume limited", sql=bars_sql("h", HOUR) + """, m as (select venue, instrument, time, notional, avg(notional::double) over w as prior_mean, count(*) over w as prior_bars from h
  window w as (partition by venue, instrument order by time rows between 24 preceding and 1 preceding)), q as (select *, coalesce(prior_mean > 0 and notional >= prior_mean * 3, false) as high_volume, prior_bars < 24 as limited from m)""")  # fmt: skip
def high_volume_gate(spark, sf_dir):
    return bars.high_volume_gate(bars.ohlcv(trades(spark, sf_dir), HOUR), times=3)


LINES = f"""lines as (select venue, instrument, sec - sec % {HOUR} as time, arg_max(price, (exchange_ts_ns, event_id)) as price, sum(case when kind = 'trade' then price * quantity else 0 end) as notional,
  count(*) filter (where kind = 'trade') as trades from tape where price > 0 group by all)"""


@query("venue instrument time:l price:d notional:d trades:l", sql=LINES + ", q as (select * from lines)")
def venue_lines(spark, sf_dir):
    return bars.venue_lines(tape(spark, sf_dir), HOUR)


@query("instrument time:l volume:d trades:l", sql=f"q as (select instrument, sec - sec % {HOUR} as time, sum(quantity) as volume, count(*) as trades from trades group by 1, 2)")
def volume_over_venues(spark, sf_dir):
    return bars.merge_volume(bars.ohlcv(trades(spark, sf_dir), HOUR))


@query("venue instrument time:l volume:d", sql=bars_sql("h", HOUR) + f""", g as (select venue, instrument, unnest(range(min(time), max(time) + 1, {HOUR})) as time from h group by 1, 2),
  q as (select g.venue, g.instrument, g.time, coalesce(volume, 0) as volume from g left join h using (venue, instrument, time))""")  # fmt: skip
def zero_filled_bars(spark, sf_dir):
    return bars.zero_filled(bars.ohlcv(trades(spark, sf_dir), HOUR), HOUR)


@query("venue instrument time:l value:d", sql=bars_sql("h", HOUR) + f""", g as (select venue, instrument, unnest(range(min(time), max(time) + 1, {HOUR})) as time from h group by 1, 2),
  q as (select g.venue, g.instrument, g.time, close as value from g asof join h on g.venue = h.venue and g.instrument = h.instrument and g.time >= h.time)""")  # fmt: skip
def held_closes(spark, sf_dir):
    h = bars.ohlcv(trades(spark, sf_dir), HOUR)
    return windows.step_hold(h, KEYS, "close", time="time", step=HOUR).withColumnRenamed("close", "value")


@query("event_id:l venue instrument sec:l quantity:d price:d", sql="""r as (select venue, instrument, sec, arg_max(price, event_id) as price from trades group by 1, 2, 3), q as (
  select l.event_id, l.venue, l.instrument, l.sec, l.quantity, r.price from (select * from tape where kind = 'quote') l asof left join r on l.venue = r.venue and l.instrument = r.instrument and l.sec >= r.sec)""")  # fmt: skip
def quotes_as_of_trades(spark, sf_dir):
    t = tape(spark, sf_dir)
    return windows.as_of(t.where("kind = 'quote'").select("event_id", *KEYS, "sec", "quantity"), t.where("kind = 'trade'"), KEYS, ["price"], tie="event_id")


@query("venue instrument cvd:d buy_usd:d sell_usd:d buy_quantity:d sell_quantity:d trades:l", sql="""q as (select venue, instrument, sum(case aggressor when 'buy' then 1 when 'sell' then -1 else 0 end * price * quantity) as cvd,
  coalesce(sum(price * quantity) filter (where aggressor = 'buy'), 0) as buy_usd, coalesce(sum(price * quantity) filter (where aggressor = 'sell'), 0) as sell_usd,
  coalesce(sum(quantity) filter (where aggressor = 'buy'), 0) as buy_quantity, coalesce(sum(quantity) filter (where aggressor = 'sell'), 0) as sell_quantity, count(*) as trades from trades group by 1, 2)""")  # fmt: skip
def cvd_totals(spark, sf_dir):
    return flow.cvd_totals(trades(spark, sf_dir))


@query("event_id:l venue instrument cvd:d cum_buy:d cum_sell:d", sql="""q as (select event_id, venue, instrument, sum(case aggressor when 'buy' then 1 when 'sell' then -1 else 0 end * price * quantity) over w as cvd,
  sum(case when aggressor = 'buy' then price * quantity else 0 end) over w as cum_buy, sum(case when aggressor = 'sell' then price * quantity else 0 end) over w as cum_sell
  from trades window w as (partition by venue, instrument order by exchange_ts_ns, event_id rows unbounded preceding))""")  # fmt: skip
def cvd_points(spark, sf_dir):
    return flow.cvd_points(trades(spark, sf_dir))


@query("venue instrument time:l buy_usd:d sell_usd:d", sql="""q as (select venue, instrument, sec as time, coalesce(sum(price * quantity) filter (where aggressor = 'buy'), 0) as buy_usd,
  coalesce(sum(price * quantity) filter (where aggressor = 'sell'), 0) as sell_usd from trades group by 1, 2, 3)""")  # fmt: skip
def cvd_histogram(spark, sf_dir):
    return flow.cvd_histogram(trades(spark, sf_dir))


HALF = "sum(case aggressor when 'buy' then quantity when 'sell' then 0 else quantity / 2 end) as {0}, sum(case aggressor when 'sell' then quantity when 'buy' then 0 else quantity / 2 end) as {1}, sum(price * quantity) as usd"
STEP = "floor(price / 5 + 0.5)::bigint * 5 as price_step"
SIGNED = "sum(case aggressor when 'buy' then 1 when 'sell' then -1 else 0 end * price * quantity) as delta_usd"


@query("venue instrument price_step:d buy_quantity:d sell_quantity:d delta_usd:d usd:d", sql=f"""c as (select venue, instrument, {STEP}, {HALF.format('buy_quantity', 'sell_quantity')}, {SIGNED} from trades group by 1, 2, 3),
  m as (select *, (min(price_step) over w + max(price_step) over w) / 2 as middle from c window w as (partition by venue, instrument)),
  q as (select * from m qualify row_number() over (partition by venue, instrument order by abs(price_step - middle), price_step) <= 48)""")  # fmt: skip
def volume_at_price(spark, sf_dir):
    return flow.volume_at_price(trades(spark, sf_dir), "5")


@query("venue instrument time:l price_step:d bid_quantity:d ask_quantity:d usd:d", sql=f"""c as (select venue, instrument, sec - sec % {HOUR} as time, {STEP}, {HALF.format('ask_quantity', 'bid_quantity')} from trades group by 1, 2, 3, 4),
  q as (select * from c qualify row_number() over (partition by venue, instrument order by usd desc, time desc, price_step desc) <= 400)""")  # fmt: skip
def footprint(spark, sf_dir):
    return flow.footprint(trades(spark, sf_dir), HOUR, "5")


@query("venue instrument time_ms:l price_step:d usd:d delta_usd:d buy_usd:d sell_usd:d trades:l", sql=f"""c as (select venue, instrument, sec * 1000 // 500 * 500 as time_ms, {STEP}, sum(price * quantity) as usd, {SIGNED}, count(*) as trades,
    sum(price * quantity * case aggressor when 'buy' then 1 when 'sell' then 0 else 0.5 end) as buy_usd, sum(price * quantity * case aggressor when 'buy' then 0 when 'sell' then 1 else 0.5 end) as sell_usd from trades group by 1, 2, 3, 4),
  q as (select * from c qualify row_number() over (partition by venue, instrument order by time_ms desc, price_step desc) <= 180)""")  # fmt: skip
def trade_bubbles(spark, sf_dir):
    return flow.bubbles(trades(spark, sf_dir), "5")


@query("venue instrument aggressor cents:l quantity:d prints:l newest_ns:l", sql="q as (select venue, instrument, aggressor, floor(price * 100 + 0.5) as cents, sum(quantity) as quantity, count(*) as prints, max(exchange_ts_ns) as newest_ns from trades group by 1, 2, 3, 4)")
def print_groups(spark, sf_dir):
    return flow.print_groups(trades(spark, sf_dir))


@query("event_id:l venue instrument aggressor quantity:d mean_of_others:d", sql="""s as (select venue, instrument, sum(quantity) as total, count(*) as n from trades group by 1, 2),
  l as (select * from trades qualify row_number() over (partition by venue, instrument order by exchange_ts_ns desc, event_id desc) <= 48),
  h as (select l.*, (total - quantity)::double / (n - 1) as mean_of_others from l join s using (venue, instrument) where n > 1),
  q as (select * from h where mean_of_others > 0 and quantity::double >= 1.5 * mean_of_others and aggressor in ('buy', 'sell') qualify row_number() over (partition by venue, instrument, aggressor order by exchange_ts_ns desc, event_id desc) = 1)""")  # fmt: skip
def large_orders(spark, sf_dir):
    return flow.large_orders(trades(spark, sf_dir), times=1.5)


HEURISTICS = """p as (select venue, instrument, sum(case when aggressor = 'buy' then price * quantity else 0 end) / 100 as ask_usd, sum(case when aggressor = 'sell' then price * quantity else 0 end) / 100 as bid_usd from trades group by 1, 2),
  t as (select *, price * quantity as usd, lead(aggressor) over w as side2, lead(sec) over w as sec2, lead(price) over w as price2 from trades window w as (partition by venue, instrument order by exchange_ts_ns, event_id)),
  r as (select t.*, case aggressor when 'buy' then ask_usd when 'sell' then bid_usd end as opposite from t join p using (venue, instrument) where usd >= 25000),
  f as (select *, 'large' as finding from r union all select *, 'sweep' from r where opposite > 0 and usd >= opposite::double * 0.35
    union all select *, 'absorption' from r where opposite is not null and side2 = aggressor and abs(sec2 - sec) <= 2 and abs(price2 - price) / price < 0.00015 and opposite > usd / 2),
  d as (select *, case when aggressor = 'unknown' then null else aggressor end as side from f qualify row_number() over (partition by venue, instrument, finding, aggressor, sec, floor(usd + 0.5) order by exchange_ts_ns desc, event_id desc) = 1),
  q as (select * from d qualify row_number() over (partition by venue, instrument order by exchange_ts_ns desc, event_id desc, finding desc) <= 12)"""


@query("event_id:l venue instrument finding side usd:d", sql=HEURISTICS)
def flow_heuristics(spark, sf_dir):
    t = trades(spark, sf_dir)
    totals = flow.cvd_totals(t)
    rest = totals.select(*KEYS, (F.col("buy_usd") / 100).alias("ask_usd"), (F.col("sell_usd") / 100).alias("bid_usd"))
    return flow.flow_heuristics(t, rest)


RANKED = "ranked as (select *, row_number() over (partition by book_id, side order by case side when 'bid' then -price else price end) as level from book where quantity > 0)"


@query("book_id:l bid:d ask:d mid:d spread:d spread_bps:d", "book", sql="""b as (select book_id, max(price) filter (where side = 'bid') as bid, min(price) filter (where side = 'ask') as ask from book where quantity > 0 group by 1),
  q as (select *, (bid::double + ask) / 2 as mid, ask - bid as spread, case when bid > 0 and ask >= bid then (ask::double - bid) / ((ask::double + bid) / 2) * 10000 end as spread_bps from b)""")  # fmt: skip
def best_prices(spark, sf_dir):
    return books.best_prices(book_levels(spark, sf_dir))


@query("book_id:l side level:l price:d quantity:d cum_quantity:d cum_usd:d", "book", sql=RANKED + """, q as (select book_id, side, level, price, quantity, sum(quantity) over w as cum_quantity, sum(price * quantity) over w as cum_usd
  from ranked where level <= 25 window w as (partition by book_id, side order by level rows unbounded preceding))""")  # fmt: skip
def depth_ladder(spark, sf_dir):
    return books.ladder(book_levels(spark, sf_dir), 25)


@query("book_id:l bid_usd:d ask_usd:d bid_quantity:d ask_quantity:d imbalance_percent:d bid_percent:d buy_percent_by_quantity:d", "book", sql=RANKED + """, s as (select book_id, coalesce(sum(price * quantity) filter (where side = 'bid'), 0)::double as bid_usd,
  coalesce(sum(price * quantity) filter (where side = 'ask'), 0)::double as ask_usd, coalesce(sum(quantity) filter (where side = 'bid'), 0)::double as bid_quantity, coalesce(sum(quantity) filter (where side = 'ask'), 0)::double as ask_quantity
  from ranked where level <= 8 group by 1), q as (select *, (bid_usd - ask_usd) / (bid_usd + ask_usd) * 100 as imbalance_percent, bid_usd / (bid_usd + ask_usd) * 100 as bid_percent, bid_quantity / (bid_quantity + ask_quantity) * 100 as buy_percent_by_quantity from s)""")  # fmt: skip
def book_pressure(spark, sf_dir):
    return books.pressure(book_levels(spark, sf_dir), 8)


@query("book_id:l side price_step:d usd:d", "book", sql=RANKED + ", q as (select book_id, side, floor(price / 100 + 0.5) * 100 as price_step, sum(price * quantity) as usd from ranked where level <= 50 group by 1, 2, 3)")
def depth_sample(spark, sf_dir):
    return books.depth_sample(book_levels(spark, sf_dir), "100", 50)


@query("book_id:l price_step:d bid_quantity:d ask_quantity:d cum_bid:d cum_ask:d", "book", sql="""e as (select book_id, max(price) filter (where side = 'bid')::double as b, min(price) filter (where side = 'ask')::double as a from book where quantity > 0 group by 1), m as (select book_id, coalesce((b + a) / 2, b, a) as mid from e),
  near as (select book.* from book join m using (book_id) where quantity > 0 and abs(price - mid) <= greatest(mid * 0.0025, 800)), ranked as (select *, row_number() over (partition by book_id, side order by case side when 'bid' then -price else price end) as level from near),
  c as (select book_id, floor(price / 10 + 0.5) * 10 as price_step, coalesce(sum(quantity) filter (where side = 'bid'), 0) as bid_quantity, coalesce(sum(quantity) filter (where side = 'ask'), 0) as ask_quantity
    from ranked where level <= 50 group by 1, 2),
  q as (select *, sum(bid_quantity) over (partition by book_id order by price_step desc rows unbounded preceding) as cum_bid, sum(ask_quantity) over (partition by book_id order by price_step rows unbounded preceding) as cum_ask from c)""")  # fmt: skip
def price_ladder(spark, sf_dir):
    return books.price_ladder(book_levels(spark, sf_dir), "10", 50)


@query("book_id:l tick:d", "book", sql=RANKED + ", g as (select book_id, price - lag(price) over (partition by book_id, side order by price) as gap from ranked where level <= 8), q as (select book_id, coalesce(min(gap) filter (where gap > 0), 0.01) as tick from g group by 1)")
def inferred_tick(spark, sf_dir):
    return books.inferred_tick(book_levels(spark, sf_dir))


@query("book_id:l probe:d resting_price:d side quantity:d", "book", sql="""p as (select book_id, unnest([100100, 190000, 199000, 201000, 260005])::decimal(18,0) as probe from (select distinct book_id from book)),
  h as (select p.book_id, p.probe, b.price as resting_price, b.side, b.quantity from p join book b on b.book_id = p.book_id and abs(b.price - p.probe) <= 80 qualify row_number() over (partition by p.book_id, p.probe order by abs(b.price - p.probe), b.price, b.side) = 1),
  q as (select p.book_id, p.probe, h.resting_price, h.side, h.quantity from p left join h using (book_id, probe))""")  # fmt: skip
def resting_at_price(spark, sf_dir):
    levels = book_levels(spark, sf_dir)
    probes = levels.select("book_id").distinct().select("book_id", F.explode(F.array(*[F.lit(p).cast("decimal(18,0)") for p in (100100, 190000, 199000, 201000, 260005)])).alias("price"))
    return books.resting_at(levels, probes, F.lit(10))


@query("instrument time:l high:d low:d high_venue low_venue venues:l span:d bps:d", sql=LINES + """, q as (select instrument, time, max(price) as high, min(price) as low, list(venue order by price desc, venue)[1] as high_venue, list(venue order by price, venue)[1] as low_venue, count(*) as venues,
  max(price) - min(price) as span, (max(price) - min(price))::double / ((max(price) + min(price))::double / 2) * 10000 as bps from lines group by 1, 2 having count(*) >= 2)""")  # fmt: skip
def venue_discrepancy(spark, sf_dir):
    return cross_venue.discrepancy(bars.venue_lines(tape(spark, sf_dir), HOUR))


HELD = LINES + f""", g as (select venue, instrument, unnest(range(min(time), max(time) + 1, {HOUR})) as time from lines group by 1, 2),
  held as (select g.venue, g.instrument, g.time, price from g asof join lines l on g.venue = l.venue and g.instrument = l.instrument and g.time >= l.time)"""
SPREAD = """{0} as (select instrument, time, max(price) as high, min(price) as low, count(*) as venues, (max(price) - min(price))::double / ((max(price) + min(price))::double / 2) * 10000 as bps from held group by 1, 2 having count(*) >= 2)"""


@query("instrument time:l high:d low:d venues:l bps:d", sql=HELD + ", " + SPREAD.format("q"))
def discrepancy_history(spark, sf_dir):
    return cross_venue.discrepancy_history(bars.venue_lines(tape(spark, sf_dir), HOUR), HOUR)


@query("instrument time:l bps:d", sql=HELD + ", " + SPREAD.format("h") + f""", o as (select *, row_number() over (partition by instrument order by time) as n from h where bps >= 5000),
  r as (select instrument, n, time, bps, time as last, true as alert from o where n = 1 union all select o.instrument, o.n, o.time, o.bps, case when o.time - r.last >= {6 * HOUR} then o.time else r.last end, o.time - r.last >= {6 * HOUR} from r join o on o.instrument = r.instrument and o.n = r.n + 1),
  q as (select * from r where alert)""")  # fmt: skip
def discrepancy_alerts(spark, sf_dir):
    history = cross_venue.discrepancy_history(bars.venue_lines(tape(spark, sf_dir), HOUR), HOUR)
    return sampling.alerts(history, 5000, 6 * HOUR, keys=["instrument"])


@query("venue instrument time:l price:d percent:d", sql=LINES + """, f as (select venue, instrument, arg_min(price, time) as first from lines group by 1, 2), q as (
  select venue, instrument, time, price, (price - first)::double / first::double * 100 as percent from lines join f using (venue, instrument))""")  # fmt: skip
def percent_lines(spark, sf_dir):
    return cross_venue.percent_lines(bars.venue_lines(tape(spark, sf_dir), HOUR))


PULSE = """v as (select venue, instrument, venue <> 'v4' as live, count(*) / 43200.0::double as tpm, sum(price * quantity)::double / 43200 as upm,
    case when instrument = 1 then null else (sum(quantity) % 40)::double end as spread, ((sum(quantity) % 200) - 100)::double as lean from trades group by 1, 2),
  h as (select *, case when live then least(100, greatest(0, 0.4 * (100 * (1 - exp(-tpm / 40))) + 0.35 * (100 * (1 - exp(-upm / 250000))) + 0.15 * least(100, abs(lean) * 1.2) + 0.1 * greatest(0, 100 - coalesce(spread, 0) * 8))) else 0 end as heat from v),
  s as (select instrument, coalesce(sum(tpm) filter (where live), 0) as trades_per_min, coalesce(sum(upm) filter (where live), 0) as usd_per_min, median(coalesce(spread, 0)) filter (where live) as median_spread,
    median(coalesce(lean, 0)) filter (where live) as book_imbalance, avg(heat) as average_heat, count(*) filter (where live) as live_venues from h group by 1),
  q as (select *, greatest(0, least(100, average_heat * 0.75 + least(15, abs(coalesce(book_imbalance, 0)) * 0.25))) as score from s)"""


@query("instrument trades_per_min:d usd_per_min:d median_spread:d book_imbalance:d average_heat:d live_venues:l score:d", sql=PULSE)
def market_pulse(spark, sf_dir):
    minutes = 30 * 1440
    total = F.sum("quantity")
    v = trades(spark, sf_dir).groupBy(*KEYS).agg((F.count(F.lit(1)) / minutes).alias("trades_per_min"), (F.sum(F.col("price") * F.col("quantity")).cast("double") / minutes).alias("usd_per_min"), (total % 40).cast("double").alias("s"), (total % 200 - 100).cast("double").alias("imbalance_percent"))
    v = v.withColumn("live", F.col("venue") != "v4").withColumn("spread_bps", F.when(F.col("instrument") != 1, F.col("s")))
    return cross_venue.pulse(v)


@query("venue instrument time:l score:d spike", sql=bars_sql("h", HOUR) + """, m as (select venue, instrument, time, notional::double / 1000 as score, count(*) over w as n, avg(notional::double / 1000) over w as mean, stddev_pop(notional::double / 1000) over w as dev from h
  window w as (partition by venue, instrument order by time rows between unbounded preceding and 1 preceding)), q as (select *, coalesce(n >= 4 and score >= 24 and score >= mean + greatest(12, 1.5 * dev), false) as spike from m)""")  # fmt: skip
def pulse_spikes(spark, sf_dir):
    h = bars.ohlcv(trades(spark, sf_dir), HOUR).select(*KEYS, "time", (F.col("notional").cast("double") / 1000).alias("score"))
    return cross_venue.spikes(h, keys=KEYS, threshold=24)


@query("venue instrument time:l close:d", sql=bars_sql("h", HOUR) + """, r as (select venue, instrument, time, close, row_number() over (partition by venue, instrument order by time) - 1 as r, count(*) over (partition by venue, instrument) as n from h),
  i as (select distinct n, floor(i * (n - 1) / 99 + 0.5)::bigint as r from (select distinct n from r), range(100) t(i)), q as (select r.venue, r.instrument, r.time, r.close from r left join i using (n, r) where n <= 100 or i.r is not null or r.r = n - 1)""")  # fmt: skip
def stride_downsample(spark, sf_dir):
    return sampling.stride(bars.ohlcv(trades(spark, sf_dir), HOUR), 100, keys=KEYS)


AGE = f"""tip as (select venue, instrument, max(time) as tip from h group by 1, 2), a as (select h.*, case when time >= tip - {3 * DAY} then {HOUR} when time >= tip - {10 * DAY} then {4 * HOUR} else {DAY} end as width from h join tip using (venue, instrument)),
  q as (select venue, instrument, max(time) as time, arg_max(close, time) as close from a group by venue, instrument, width, time - time % width)"""


@query("venue instrument time:l close:d", sql=bars_sql("h", HOUR) + ", " + AGE)
def tiered_downsample(spark, sf_dir):
    h = bars.ohlcv(trades(spark, sf_dir), HOUR).select(*KEYS, "time", "close")
    return sampling.by_age(h, keys=KEYS, recent=3 * DAY, mid=10 * DAY, steps=(HOUR, 4 * HOUR, DAY))


@query("venue instrument time:l close:d", sql=bars_sql("h", HOUR) + f", tip as (select venue, instrument, max(time) as tip from h group by 1, 2), q as (select h.* from h join tip using (venue, instrument) where time >= tip - {2 * DAY})")
def retained_points(spark, sf_dir):
    return sampling.retained(bars.ohlcv(trades(spark, sf_dir), HOUR), 2 * DAY, keys=KEYS)


@query("venue instrument time:l ema:d", sql=bars_sql("h", DAY) + """, recursive_rows as (select *, row_number() over (partition by venue, instrument order by time) as n from h),
  q as (select venue, instrument, time, list_reduce(list(close::double) over (partition by venue, instrument order by time rows unbounded preceding), lambda e, x: e + 0.22 * (x - e)) as ema from recursive_rows)""")  # fmt: skip
def smoothed_closes(spark, sf_dir):
    return sampling.moving_average(bars.ohlcv(trades(spark, sf_dir), DAY).select(*KEYS, "time", "close"), 0.22, keys=KEYS, value="close")


@query("session:l after:l next:l missing:l", "seq", sql="g as (select session, lag(seq) over (partition by session order by seq) as after, seq as next from seqs), q as (select *, next - after - 1 as missing from g where next > after + 1)")
def sequence_gaps(spark, sf_dir):
    return stream_quality.sequence_gaps(sequence_ids(spark, sf_dir), block=1000)


@query("event_id:l venue price:d quantity:d", sql="q as (select * from trades qualify row_number() over (partition by venue, price, quantity order by exchange_ts_ns, event_id) = 1)")
def distinct_prints(spark, sf_dir):
    return stream_quality.first_of(trades(spark, sf_dir), ["venue", "price", "quantity"], "exchange_ts_ns", "event_id")


@query("event_id:l venue kind row:l", sql="t as (select *, row_number() over (partition by venue order by exchange_ts_ns desc, case kind when 'trade' then 0 else 1 end, event_id desc) as row from tape), q as (select * from t where row <= 50)")
def newest_tape(spark, sf_dir):
    return stream_quality.newest_merged(tape(spark, sf_dir), 50, keys=["venue"])


@query("event_id:l venue sec:l", sql=f"q as (select event_id, venue, sec from (select *, sec - sec % {HOUR} as h from tape) qualify row_number() over (partition by venue, h order by event_id) <= 2)")
def rate_capped_tape(spark, sf_dir):
    return stream_quality.rate_capped(tape(spark, sf_dir).withColumn("h", scalars.bucket("sec", HOUR)), 2, keys=["venue"], time="h")


@query("event_id:l venue queued", sql="q as (select event_id, venue, row_number() over (partition by venue order by event_id desc) <= 100 as queued from tape)")
def queue_keeps_newest(spark, sf_dir):
    return stream_quality.queue_outcome(tape(spark, sf_dir), 100, "drop_oldest", keys=["venue"])


@query("venue last_event_ns:l last_trade_ns:l last_quote_ns:l trades:l quotes:l lag_ms:l", sql="""q as (select venue, max(exchange_ts_ns) as last_event_ns, max(exchange_ts_ns) filter (where kind = 'trade') as last_trade_ns, max(exchange_ts_ns) filter (where kind = 'quote') as last_quote_ns,
  count(*) filter (where kind = 'trade') as trades, count(*) filter (where kind = 'quote') as quotes, (2000000000000000000 - max(exchange_ts_ns)) // 1000000 as lag_ms from tape group by 1)""")  # fmt: skip
def venue_status(spark, sf_dir):
    return stream_quality.venue_status(tape(spark, sf_dir), now_ns=F.lit(2_000_000_000_000_000_000))


@query("venue le:d cumulative:l", sql="""b as (select unnest([5, 10, 25, 50, 75, 90]::double[] || [1e300]) as le), q as (select venue, le, count(*) filter (where quantity::double <= le) as cumulative from tape cross join b group by 1, 2)""")
def quantity_histogram(spark, sf_dir):
    got = stream_quality.histogram(tape(spark, sf_dir), "quantity", [5, 10, 25, 50, 75, 90], keys=["venue"])
    return got.withColumn("le", F.least("le", F.lit(1e300)))


@query("symbol venues:l live_venues:l names", sql="c as (select distinct venue, 'SYM' || instrument as symbol from tape), q as (select symbol, count(*) as venues, count(*) filter (where venue <> 'v4') as live_venues, string_agg(venue, ',' order by venue) as names from c group by 1)")
def asset_coverage(spark, sf_dir):
    return stream_quality.coverage(instruments(spark, sf_dir))


MOVERS = bars_sql("b", HOUR) + f""", tip as (select venue, instrument, max(time) as now, min(time) as oldest from b group by 1, 2), r as (select b.*, now, oldest from b join tip using (venue, instrument)),
  m as (select venue, instrument, now, oldest, arg_max(close, time)::double as close, arg_max(close, time) filter (where time <= now - 300)::double as c5, arg_max(close, time) filter (where time <= now - 7200)::double as c2,
    max(high) filter (where time >= now - {DAY}) as h1, max(high) filter (where time >= now - {7 * DAY}) as h7, max(high) filter (where time >= now - {30 * DAY}) as h30,
    min(low) filter (where time >= now - {DAY}) as l1, min(low) filter (where time >= now - {7 * DAY}) as l7, min(low) filter (where time >= now - {30 * DAY}) as l30, arg_max(high, time) as lh, arg_max(low, time) as ll,
    arg_min(open, time) filter (where time >= now - now % {DAY})::double as o, max(high) filter (where time >= now - now % {DAY})::double as h, min(low) filter (where time >= now - now % {DAY})::double as l from r group by 1, 2, 3, 4),
  x as (select *, (close - c5) / c5 * 100 as d5, (close - c2) / c2 * 100 as d2, now - oldest as span from m),
  k as (select *, 'new_24h_high' as kind, lh::double as change from x where span >= 60 and lh >= h1 union all select *, 'new_24h_low', ll::double from x where span >= 60 and ll <= l1
    union all select *, 'new_7d_high', lh::double from x where span >= {7 * DAY - 60} and lh >= h7 union all select *, 'new_7d_low', ll::double from x where span >= {7 * DAY - 60} and ll <= l7
    union all select *, 'new_30d_high', lh::double from x where span >= {30 * DAY - 60} and lh >= h30 union all select *, 'new_30d_low', ll::double from x where span >= {30 * DAY - 60} and ll <= l30
    union all select *, 'rise_5m', d5 from x where d5 >= 3 union all select *, 'fall_5m', d5 from x where d5 <= -3 union all select *, 'rise_2h', d2 from x where d2 >= 3 union all select *, 'fall_2h', d2 from x where d2 <= -3
    union all select *, 'pullback', (h - o) / o * 100 from x where (h - o) / o * 100 >= 8 and (h - close) / h * 100 between 0 and 5 union all select *, 'rally', (l - o) / o * 100 from x where (l - o) / o * 100 <= -8 and (close - l) / l * 100 >= 5),
  q as (select *, case when kind[:4] in ('rise', 'fall') then case when abs(change) < 7 then 'small' when abs(change) < 11 then 'mid' else 'high' end end as band from k)"""


@query("venue instrument kind band change:d", sql=MOVERS)
def mover_statuses(spark, sf_dir):
    return movers.statuses(movers.measures(bars.ohlcv(trades(spark, sf_dir), HOUR)))


@query("book_id:l side price:d quantity:d", "book", sql="""u as (select l_suppkey as book_id, case l_linestatus when 'O' then 'bid' else 'ask' end as side, floor(l_extendedprice / l_quantity / 100)::bigint * 100 as price, l_quantity % 5 as quantity, l_orderkey as ord, l_orderkey % 50 = 0 as snapshot, l_linenumber as n from lineitem),
  s as (select book_id, max(ord) as start from u where snapshot group by 1), f as (select u.* from u join s using (book_id) where ord >= start qualify row_number() over (partition by book_id, side, price order by ord desc, n desc, quantity desc) = 1),
  q as (select * from f where quantity > 0)""")  # fmt: skip
def books_from_updates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("book_id"), F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 100) * 100).alias("price"), (F.col("l_quantity") % 5).alias("quantity"),
        F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") % 5).alias("q")).alias("ord"), (F.col("l_orderkey") % 50 == 0).alias("snapshot"), "l_orderkey",
    )
    # a snapshot's rows share their place
    rows = rows.withColumn("ord", F.when(F.col("snapshot"), F.struct(F.col("l_orderkey").alias("o"), F.lit(0).cast("int").alias("n"), F.lit(0.0).alias("q"))).otherwise(F.col("ord")))
    return book_at(rows, keys=["book_id"])


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


from . import captures, feeds, measures, rules, screens  # noqa: E402, F401  (register more queries with the decorator above)
