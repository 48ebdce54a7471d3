"""Queries over market lists, health, and depth over time, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols
from ..operators import bars, cross_venue, flow, health, heatmap, markets, movers, sampling
from ..sources.tables import SYMBOLS, VENUE_NAMES, book_levels, depth_history, depth_mids, listings, read_table, system_events, tape, trades, venue_states
from .catalog import HOUR, KEYS, bars_sql, query

# The rules of names as SQL states them, written from the rules and not from the code above.
BASE = """case when bare.base = 'XBT' then 'BTC' when length(bare.base) between 2 and 6 then bare.base when bare.s like 'XBT%' or bare.s like 'BTC%' then 'BTC' when bare.s like 'ETH%' then 'ETH' end"""
KIND = """case when upper(symbol) like '%PERP%' or upper(symbol) like '%SWAP%' then 'perp' when venue in ('deribit', 'binance-usdm', 'binance-coinm', 'okx-swap', 'bybit-linear') or regexp_matches(venue, 'usdm|coinm|swap|linear|perp|futures|inverse') then 'perp'
  when venue in ('gemini', 'bitstamp', 'bitfinex', 'coinbase-spot', 'kraken-spot', 'binance-spot', 'bybit-spot', 'okx-spot') or venue like '%spot%' then 'spot' else 'other' end"""


def bare_sql(source: str) -> str:
    """``bare``: the rows of a view with the symbol's bare name and what comes before its quote currency."""
    return f"""u as (select *, case when regexp_matches(upper(trim(symbol)), '^T[A-Z]') then upper(trim(symbol))[2:] else upper(trim(symbol)) end as up from {source}),
  v as (select *, regexp_replace(regexp_replace(up, '[-_/]', '', 'g'), '(PERPETUAL|PERP|SWAP|SPOT)$', '') as s from u), bare as (select *, regexp_extract(s, '^(.+)(USDT|USDC|USD|EUR|BTC|ETH|BNB)$', 1) as base from v)"""


FORMS = ("BTC", "eth", "xbt", "tSOL", "DOGE1000", "X", "PF_XBT", "1INCH")
ENDS = ("USDT", "-usd", "_EUR", "/BTC", "USD_PERP", "-USDT-SWAP", "-PERPETUAL", "", "usdc", "-BNB-X")


@query("symbol venue base kind pair", sql=f"""n as (select distinct ({list(FORMS)})[user_id % {len(FORMS)} + 1] || ({list(ENDS)})[user_id % {len(ENDS)} + 1] as symbol, ({list(VENUE_NAMES)})[user_id % {len(VENUE_NAMES)} + 1] as venue from events),
  {bare_sql('n')}, q as (select symbol, venue, {BASE} as base, {KIND} as kind, case when regexp_matches(symbol, '^([A-Za-z0-9]+)[-_/]?(USDT|USDC|USD|BTC|ETH|BNB|EUR)$', 'i') then upper(regexp_extract(symbol, '^([A-Za-z0-9]+)[-_/]?(USDT|USDC|USD|BTC|ETH|BNB|EUR)$', 1, 'i')) || '/' || upper(regexp_extract(symbol, '^([A-Za-z0-9]+)[-_/]?(USDT|USDC|USD|BTC|ETH|BNB|EUR)$', 2, 'i')) else regexp_replace(symbol, '-', '/') end as pair from bare)""")  # fmt: skip
def symbol_names(spark, sf_dir):
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod("user_id", F.lit(len(names))) + 1).cast("int"))
    names = read_table(spark, sf_dir, "events").select(F.concat(pick(FORMS), pick(ENDS)).alias("symbol"), pick(VENUE_NAMES).alias("venue")).distinct()
    s = F.col("symbol")
    return names.select("symbol", "venue", symbols.base_asset(s).alias("base"), symbols.market_kind(F.col("venue"), s).alias("kind"), symbols.display_pair(s).alias("pair"))


MARKETS = bare_sql("listings") + f""", markets as (select venue, adapter, symbol, instrument, coalesce(live, true) as live, {KIND} as kind, {BASE} as asset, coalesce(states.events, 0) as events from bare left join states using (venue))"""


def market_rows_of(spark, sf_dir):
    return markets.market_rows(listings(spark, sf_dir), venue_states(spark, sf_dir))


@query("venue adapter symbol instrument:l live kind asset events:l", "listings", sql=MARKETS + ", q as (select * from markets)")
def market_rows(spark, sf_dir):
    return market_rows_of(spark, sf_dir)


@query("venue symbol asset", "listings", sql=MARKETS + ", q as (select * from markets where live and kind = 'perp' and (venue ilike '%e%' or symbol ilike '%e%' or adapter ilike '%e%' or coalesce(asset, '') ilike '%e%' or kind ilike '%e%'))")
def live_markets_with_text(spark, sf_dir):
    return markets.filtered(market_rows_of(spark, sf_dir), live=True, kind="perp", text=" E ")


@query("section total:l live:l rank:l", "listings", sql=MARKETS + ", q as (select coalesce(asset, 'UNKNOWN') as section, count(*) as total, count(*) filter (where live) as live, coalesce(list_position(['BTC', 'ETH', 'SOL', 'XRP', 'BNB'], coalesce(asset, 'UNKNOWN')) - 1, 50) as rank from markets group by 1)")
def asset_sections(spark, sf_dir):
    return markets.sections(market_rows_of(spark, sf_dir), "asset")


@query("asset venue symbol live", "listings", sql=MARKETS + ", q as (select * from markets where asset is not null qualify row_number() over (partition by asset, venue order by instrument, symbol) = 1)")
def asset_venues(spark, sf_dir):
    return markets.asset_venues(listings(spark, sf_dir), venue_states(spark, sf_dir))


@query("user_id:l venue symbol instrument:l", "listings", sql=f"""r as (select distinct user_id, ({list(VENUE_NAMES)})[user_id % {len(VENUE_NAMES)} + 1] as venue, ({list(SYMBOLS)})[user_id % {len(SYMBOLS) + 3} + 1] as symbol, case when user_id % 4 = 0 then user_id end as asked from events),
  n as (select venue, symbol, min(instrument) as found from listings group by 1, 2), q as (select user_id, venue, r.symbol, coalesce(asked, found, 1) as instrument from r left join n using (venue, symbol))""")  # fmt: skip
def resolved_instruments(spark, sf_dir):
    users = read_table(spark, sf_dir, "events").select("user_id").distinct()
    at = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), F.pmod("user_id", F.lit(n)).cast("int"))
    asked = users.select("user_id", at(VENUE_NAMES, len(VENUE_NAMES)).alias("venue"), at(SYMBOLS, len(SYMBOLS) + 3).alias("symbol"), F.when(F.col("user_id") % 4 == 0, F.col("user_id")).alias("instrument"))
    return markets.resolved(asked, listings(spark, sf_dir))


@query("event_id:l venue_name symbol", sql="""c as (select distinct venue, instrument, 'SYM' || instrument as symbol from tape where instrument <> 3), q as (select event_id, case when t.venue in ('v0', 'v1') then upper(t.venue) else 'venue-' || t.venue end as venue_name, symbol from tape t left join c using (venue, instrument))""")
def named_events(spark, sf_dir):
    rows = tape(spark, sf_dir)
    names = rows.where("instrument <> 3").select(*KEYS, F.concat(F.lit("SYM"), F.col("instrument").cast("string")).alias("symbol")).distinct()
    venues = rows.where("venue in ('v0', 'v1')").select("venue", F.upper("venue").alias("name")).distinct()
    return markets.named(rows, names, venues)


@query("event_id:l venue usd:d", sql="q as (select event_id, venue, price * quantity as usd from trades where aggressor = 'buy' and price * quantity >= 10000)")
def large_buys(spark, sf_dir):
    return markets.prints(tape(spark, sf_dir), side="buy", least_usd=10_000).withColumn("usd", F.col("price") * F.col("quantity"))


@query("venue instrument quantity:d usd:d trades:l buy_percent:d trades_per_min:d", sql="""q as (select venue, instrument, sum(quantity) as quantity, sum(price * quantity) as usd, count(*) as trades,
  100 * sum(case aggressor when 'buy' then price * quantity else 0 end)::double / nullif(sum(case when aggressor in ('buy', 'sell') then price * quantity else 0 end)::double, 0) as buy_percent, count(*) / (max(sec) - min(sec) + 1) * 60 as trades_per_min from trades group by 1, 2)""")  # fmt: skip
def tape_totals(spark, sf_dir):
    return markets.tape_totals(trades(spark, sf_dir))


@query("event_id:l high:d low:d volume:d", sql="q as (select event_id, max(price) over w as high, min(price) over w as low, sum(quantity) over w as volume from trades window w as (partition by venue, instrument order by sec, exchange_ts_ns, event_id rows unbounded preceding))")
def running_session(spark, sf_dir):
    return markets.running_session(trades(spark, sf_dir))


@query("event_id:l venue instrument usd:d large", sql="""t as (select *, price * quantity as usd, price * quantity >= 48000 as large from trades), h as (select venue, instrument from t group by 1, 2 having bool_or(large)),
  l as (select * from t where large qualify row_number() over (partition by venue, instrument order by exchange_ts_ns desc, event_id desc) <= 24), s as (select t.* from t anti join h using (venue, instrument) where usd > 0 qualify row_number() over (partition by venue, instrument order by usd desc, event_id desc) <= 18),
  q as (select * from l union all select * from s)""")  # fmt: skip
def flag_rows(spark, sf_dir):
    return markets.flags(trades(spark, sf_dir), large_usd=48_000)


@query("event_id:l fresh", sql="""h as (select *, 'k' || event_id % 4000 as trade_id, 0 as n from trades where event_id % 3 > 0), a as (select *, 'k' || event_id % 4000 as trade_id, 1 as n from trades where event_id % 3 = 0), b as (select * from h union all select * from a),
  l as (select * from b qualify row_number() over (partition by trade_id order by n desc, exchange_ts_ns desc) = 1), x as (select max(sec) as now from trades), k as (select l.* from l, x where sec >= now - 864000 qualify row_number() over (partition by venue, instrument order by exchange_ts_ns desc, event_id desc) <= 60),
  q as (select event_id, trade_id not in (select trade_id from h) as fresh from k)""")  # fmt: skip
def focus_tape(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("trade_id", F.concat(F.lit("k"), (F.col("event_id") % 4000).cast("string")))
    now = t.agg(F.max("sec")).first()[0]  # one number
    return markets.merged_tape(t.where("event_id % 3 > 0"), t.where("event_id % 3 = 0"), now=F.lit(now), seconds=864_000, most=60)


@query("venue gaps:l checksum_mismatches:l invalidations:l resyncs:l drops:l parse_failures:l valid_books:l", "system", sql="""b as (select venue, session, instrument, arg_max(kind, seq) as last from system where kind in ('book_valid', 'book_invalidated') group by 1, 2, 3), g as (select venue, count(distinct instrument) as valid_books from b where last = 'book_valid' group by 1),
  c as (select venue, count(*) filter (where kind = 'sequence_gap') as gaps, count(*) filter (where kind = 'checksum_mismatch') as checksum_mismatches, count(*) filter (where kind = 'book_invalidated') as invalidations, count(*) filter (where kind = 'resync_started') as resyncs,
    sum(case kind when 'dropped' then count else 0 end) as drops, count(*) filter (where kind = 'parse_failure') as parse_failures from system group by 1), q as (select c.*, coalesce(valid_books, 0) as valid_books from c left join g using (venue))""")  # fmt: skip
def system_counters(spark, sf_dir):
    return health.counters(system_events(spark, sf_dir))


@query("gaps:l drops:l valid_books:l", "system", sql="""c as (select venue, count(*) filter (where kind = 'sequence_gap') as gaps, sum(case kind when 'dropped' then count else 0 end) as drops from system group by 1),
  b as (select venue, session, instrument, arg_max(kind, seq) as last from system where kind in ('book_valid', 'book_invalidated') group by 1, 2, 3), g as (select venue, count(distinct instrument) as v from b where last = 'book_valid' group by 1),
  q as (select (select sum(gaps) from c) as gaps, (select sum(drops) from c) as drops, coalesce((select max(v) from g), 0) as valid_books)""")  # fmt: skip
def counters_of_all_venues(spark, sf_dir):
    return health.rolled_up(health.counters(system_events(spark, sf_dir)), sums=["gaps", "drops"], gauges=["valid_books"])


@query("reason dropped:l", "system", sql="q as (select detail as reason, sum(count) as dropped from system where kind = 'dropped' group by 1)")
def drops_by_reason(spark, sf_dir):
    return health.drops_by_reason(system_events(spark, sf_dir))


HEALTH = "s as (select venue, session, count(*) filter (where kind = 'sequence_gap' and count < 2) as gaps, count(*) filter (where kind = 'book_invalidated' and count < 1) as invalidations, max(count) * 41 + session * 7 as lag_ms from system group by 1, 2)"


def _venue_state(spark, sf_dir):
    few = lambda kind, n: F.count_if((F.col("kind") == kind) & (F.col("count") < n))
    return system_events(spark, sf_dir).groupBy("venue", "session").agg(few("sequence_gap", 2).alias("gaps"), few("book_invalidated", 1).alias("invalidations"), F.max("count").alias("__m")).select("venue", "session", "gaps", "invalidations", (F.col("__m") * 41 + F.col("session") * 7).alias("lag_ms"))


@query("venue session:l bad lag_step_ms:l", "system", sql=HEALTH + ", q as (select venue, session, gaps > 2 or invalidations > 2 or lag_ms > 4000 as bad, floor(lag_ms / 50 + 0.5) * 50 as lag_step_ms from s)")
def venue_health(spark, sf_dir):
    return health.venue_health(_venue_state(spark, sf_dir))


@query("required_live live_sessions:l ready", "system", sql=HEALTH + ", v as (select venue, venue <> 'v4' as required, max(lag_ms) < 5000 as live, count(*) as sessions from s group by 1), q as (select bool_and(not required or live) as required_live, sum(case when live then sessions else 0 end) as live_sessions, bool_and(not required or live) and sum(case when live then sessions else 0 end) >= 2 as ready from v)")
def readiness(spark, sf_dir):
    venues = _venue_state(spark, sf_dir).groupBy("venue").agg((F.col("venue") != "v4").alias("required"), (F.max("lag_ms") < 5000).alias("live"), F.count(F.lit(1)).alias("sessions"))
    return health.readiness(venues, process_live=F.lit(True), recording_healthy=F.lit(True), least_sessions=2)


GATE = """r as (select venue, instrument, event_id, exchange_ts_ns // 1000000 as t, event_type as raw0, quantity >= 50 as raw from (select tape.*, kind as event_type from tape) where kind = 'trade'), n as (select *, row_number() over w as n, lag(raw) over w as before from r window w as (partition by venue, instrument order by t, event_id)),
  s as (select *, sum(case when n = 1 or raw <> before then 1 else 0 end) over (partition by venue, instrument order by n) as run from n), f as (select *, min(t) over (partition by venue, instrument, run) as start from s),
  h as (select *, case when n = 1 or t - start >= case when raw then 3600000 else 7200000 end then raw end as sure from f), q as (select event_id, last_value(sure ignore nulls) over (partition by venue, instrument order by n) as shown from h)"""


@query("event_id:l shown", sql=GATE)
def steady_flags(spark, sf_dir):
    rows = trades(spark, sf_dir).select(*KEYS, "event_id", F.struct(F.floor(F.col("exchange_ts_ns") / 1_000_000).cast("long").alias("t"), "event_id").alias("at"), (F.col("quantity") >= 50).alias("raw"))
    return health.steadied(rows.withColumn("time_ms", F.col("at.t")), keys=KEYS, hold=(3_600_000, 7_200_000), tie="event_id")


@query("book_id:l t:l price:d bid_usd:d ask_usd:d bid_cum_usd:d ask_cum_usd:d", "depth", sql="""c as (select book_id, t, price, coalesce(sum(usd) filter (where side = 'bid'), 0) as bid_usd, coalesce(sum(usd) filter (where side = 'ask'), 0) as ask_usd from depth group by 1, 2, 3),
  e as (select book_id, t, (min(price) + max(price))::double / 2 as between_ from c group by 1, 2),
  n as (select c.* from c join e using (book_id, t) left join mids using (book_id, t) qualify row_number() over (partition by book_id, t order by abs(price::double - coalesce(mid, between_)), price desc) <= 30),
  q as (select *, case when bid_usd > 0 then sum(bid_usd) over (partition by book_id, t order by price desc rows unbounded preceding) else 0 end as bid_cum_usd,
    case when ask_usd > 0 then sum(ask_usd) over (partition by book_id, t order by price rows unbounded preceding) else 0 end as ask_cum_usd from n)""")  # fmt: skip
def resting_column(spark, sf_dir):
    h = depth_history(spark, sf_dir)
    return heatmap.resting_column(h, depth_mids(h), keys=["book_id", "t"], most=30)


PROBES = (199500.5, 199990.0, 200100.0, 200777.0, 100.0, 300000.0)


@query("book_id:l t:l probe:d bid_price:d bid_usd:d ask_price:d ask_usd:d", "depth", sql=f"""p as (select distinct book_id, t, unnest({list(PROBES)}) as probe from depth),
  x as (select book_id, t, probe, side, price, usd, case when side = 'bid' then price <= probe + 1e-12 else price >= probe - 1e-12 end as good from p join depth using (book_id, t)),
  b as (select book_id, t, probe, arg_max(price, (good, price)) as bid_price, arg_max(usd, (good, price)) as bid_usd from x where side = 'bid' group by 1, 2, 3),
  a as (select book_id, t, probe, arg_max(price, (good, -price)) as ask_price, arg_max(usd, (good, -price)) as ask_usd from x where side = 'ask' group by 1, 2, 3),
  q as (select p.*, bid_price, coalesce(bid_usd, 0) as bid_usd, ask_price, coalesce(ask_usd, 0) as ask_usd from p left join b using (book_id, t, probe) left join a using (book_id, t, probe))""")  # fmt: skip
def nearest_walls(spark, sf_dir):
    h = depth_history(spark, sf_dir)
    probes = h.select("book_id", "t").distinct().select("book_id", "t", F.explode(F.array(*[F.lit(x) for x in PROBES])).alias("probe"))
    return heatmap.nearest_walls(h, probes, keys=["book_id", "t"])


WINDOW = """st as (select distinct book_id, t from depth), rt as (select book_id, t from st qualify row_number() over (partition by book_id order by t desc) <= 14),
  fo as (select mids.book_id, mid from mids join (select book_id, max(t) as t from st group by 1) n on n.book_id = mids.book_id and n.t = mids.t),
  px as (select d.book_id, d.price::double as x from depth d semi join rt on d.book_id = rt.book_id and d.t = rt.t union all select mids.book_id, mid from mids semi join rt on mids.book_id = rt.book_id and mids.t = rt.t),
  wl as (select fo.book_id, fo.mid, coalesce(min(x) filter (where abs(x - fo.mid) <= fo.mid * 0.0075), fo.mid) as wall_low, coalesce(max(x) filter (where abs(x - fo.mid) <= fo.mid * 0.0075), fo.mid) as wall_high from fo join px using (book_id) group by 1, 2),
  hw as (select *, (wall_high - wall_low) / 2 * 1.18 as book_half from wl),
  win as (select *, least(greatest(book_half, mid * 0.00008, 4, 48), greatest(mid * 0.005, book_half, 4)) as half from hw)"""


@query("book_id:l mid:d wall_low:d wall_high:d price_min:d price_max:d", "depth", sql=WINDOW + ", q as (select *, mid - half as price_min, mid + half as price_max from win)")
def price_windows(spark, sf_dir):
    h = depth_history(spark, sf_dir)
    return heatmap.price_window(h, depth_mids(h), 1.0, most_bps=50)


@query("book_id:l place:l t:d sample_t:d", "depth", sql="""ts as (select distinct book_id, t::double as t from depth), e as (select book_id, min(t) as a, greatest(max(t) - min(t), 250) as span from ts group by 1), g as (select *, least(60, greatest(2, ceil(span / 250) + 1))::bigint as n from e),
  c as (select book_id, a, span, n, unnest(range(n)) as column_ from g), x as (select book_id, column_, a + column_ / (n - 1) * span as t from c), q as (select x.book_id, column_ as place, x.t, max(ts.t) as sample_t from x join ts on x.book_id = ts.book_id and ts.t <= x.t group by 1, 2, 3)""")  # fmt: skip
def dense_depth(spark, sf_dir):
    return heatmap.densified(depth_history(spark, sf_dir), most=60)


@query("book_id:l t:l sample_t:l", "depth", sql="""ts as (select distinct book_id, t from depth), n as (select *, lead(t) over (partition by book_id order by t) - t as gap from ts), c as (select *, case when gap > 420 and gap < 10000 then least(gap // 420, 12) - 1 else 0 end as copies from n),
  q as (select book_id, t + k * 420 as t, t as sample_t from (select *, unnest(range(copies + 1)) as k from c))""")  # fmt: skip
def depth_with_gaps_filled(spark, sf_dir):
    return heatmap.filled_gaps(depth_history(spark, sf_dir))


#: Cells of the columns of ``lv``, as ``vl`` and then ``cells``.
CELLS = """w2 as (select book_id, mid - half as lo, mid + half as hi from win), cs as (select book_id, t, min(price) as low, max(price) as high, max(usd) as most, arg_min(usd, price) as low_usd, arg_max(usd, price) as high_usd from lv group by 1, 2),
  gr as (select cs.*, lo, hi, hi - lo as span, r as row, hi - (r + 0.5) / 40 * (hi - lo) as px from cs join w2 using (book_id), range(40) as x(r)),
  nb as (select gr.*, p.price as p0, p.usd as u0, n.price as p1, n.usd as u1 from gr asof left join lv p on gr.book_id = p.book_id and gr.t = p.t and gr.px >= p.price asof left join lv n on gr.book_id = n.book_id and gr.t = n.t and gr.px < n.price),
  vl as (select *, greatest(span * 0.55, (high - low) * 1.2, span / 10) as falloff from nb),
  cells as (select book_id, t, row, greatest(case when p0 is not null and p1 is not null then u0 + (u1 - u0) * (px - p0) / (p1 - p0) when px = p0 then u0 when p1 is null then high_usd * exp(-(px - high) / falloff) * 0.9 else low_usd * exp(-(low - px) / falloff) * 0.9 end,
    most * 0.04 * exp(-abs(px - (low + high) / 2) / (span * 0.7))) as usd from vl)"""
LEVELS = "lv as (select book_id, t, price::double as price, sum(usd)::double as usd from depth where usd > 0 group by 1, 2, 3)"
#: Every third column loses its levels.
THIN = "lv as (select book_id, t, price::double as price, sum(usd)::double as usd from depth where usd > 0 and t % 900 > 0 group by 1, 2, 3)"
HELD = "hd as (select st.book_id, st.t, f.t as source from st asof join (select distinct book_id, t from lv) f on st.book_id = f.book_id and st.t >= f.t)"


@query("book_id:l t:l row:l usd:d", "depth", sql=f"{WINDOW}, {LEVELS}, {CELLS}, q as (select * from cells)")
def heat_grid(spark, sf_dir):
    h = depth_history(spark, sf_dir)
    return heatmap.grid(h, heatmap.price_window(h, depth_mids(h), 1.0, most_bps=50), rows=40)


@query("book_id:l t:l row:l usd:d", "depth", sql=f"{WINDOW}, {THIN}, {CELLS}, {HELD}, q as (select hd.book_id, hd.t, row, usd from hd join cells on cells.book_id = hd.book_id and cells.t = source)")
def held_heat_grid(spark, sf_dir):
    """Columns without levels show the last ones with any."""
    h = depth_history(spark, sf_dir)
    return heatmap.held_grid(h.where("t % 900 > 0"), h.select("book_id", "t"), heatmap.price_window(h, depth_mids(h), 1.0, most_bps=50), rows=40)


@query("book_id:l t:l row:l usd:d", "depth", sql=f"""{THIN}, st as (select distinct book_id, t from depth), {HELD}, x as (select book_id, price::double as x from depth union all select book_id, mid from mids), e as (select book_id, min(x) as a, max(x) as b from x group by 1),
  w as (select book_id, a - (b - a) * 0.08 as lo, b + (b - a) * 0.08 as hi from e), r as (select lv.*, greatest(0, least(39, floor((hi - price) / (hi - lo) * 40)))::bigint as own from lv join w using (book_id)),
  n as (select *, case when own between 1 and 38 then [own - 1, own, own + 1] else [own] end as near from r), c as (select book_id, t, unnest(near) as row, usd / len(near) as usd from n), g as (select book_id, t, row, sum(usd) as usd from c group by 1, 2, 3),
  q as (select hd.book_id, hd.t, row, usd from hd join g on g.book_id = hd.book_id and g.t = source)""")  # fmt: skip
def sparse_heat_grid(spark, sf_dir):
    h = depth_history(spark, sf_dir)
    return heatmap.held_grid(h.where("t % 900 > 0"), h.select("book_id", "t"), heatmap.price_bounds(h, depth_mids(h)), rows=40, sparse=True)


@query("book_id:l t:l mid:d best_bid:d best_ask:d", "depth", sql="""d as (select * from depth where t % 900 > 0 and (side = 'ask' or t % 1200 > 0)), s as (select distinct book_id, t from depth), b as (select book_id, t, max(price) filter (where side = 'bid') as best_bid, min(price) filter (where side = 'ask') as best_ask from d group by 1, 2),
  q as (select s.book_id, s.t, (best_bid::double + best_ask::double) / 2 as mid, best_bid, best_ask from s left join b using (book_id, t))""")  # fmt: skip
def depth_paths(spark, sf_dir):
    h = depth_history(spark, sf_dir)
    thin = h.where("t % 900 > 0 and (side = 'ask' or t % 1200 > 0)")
    return heatmap.paths(thin, h.select("book_id", "t"), depth_mids(thin))


@query("venue instrument kind change:d limited", sql=bars_sql("b", 60) + """, tip as (select venue, instrument, max(time) as now from b group by 1, 2), m as (select b.venue, b.instrument, now, arg_max(close, time)::double as c1, arg_max(close, time) filter (where time <= now - 900)::double as c0 from b join tip using (venue, instrument) group by 1, 2, 3),
  k as (select venue, instrument, time - time % 900 as time, sum(coalesce(notional, volume))::double as n from b group by 1, 2, 3), g as (select *, avg(n) over w as mean, count(*) over w as prior from k window w as (partition by venue, instrument order by time rows between 24 preceding and 1 preceding)),
  x as (select m.venue, m.instrument, (c1 - c0) / c0 * 100 as change, prior < 24 as limited from m join g on g.venue = m.venue and g.instrument = m.instrument and g.time = now - now % 900 where mean > 0 and n >= mean * 0.1),
  q as (select *, case when change >= 0 then 'up_high_volume' else 'down_high_volume' end as kind from x where abs(change) >= 7)""")  # fmt: skip
def volume_statuses(spark, sf_dir):
    return movers.volume_statuses(bars.ohlcv(trades(spark, sf_dir), 60), times=0.1)


@query("venue instrument kind limited", sql="""s as (select venue, instrument, sum(quantity) as total, count(*) as n, max(sec) - min(sec) as span from trades where quantity > 0 group by 1, 2), l as (select * from trades where quantity > 0 qualify row_number() over (partition by venue, instrument order by exchange_ts_ns desc, event_id desc) <= 48),
  h as (select l.*, span from l join s using (venue, instrument) where n > 1 and quantity::double >= 1.5 * ((total - quantity) / (n - 1))::double and aggressor in ('buy', 'sell')), q as (select distinct venue, instrument, 'large_' || aggressor as kind, span < 0.9 * 432000 as limited from h)""")  # fmt: skip
def order_statuses(spark, sf_dir):
    return movers.order_statuses(trades(spark, sf_dir), times=1.5)


@query("venue instrument has_utc_day has_7d has_30d prior_buckets:l", sql=bars_sql("b", 60) + """, t as (select venue, instrument, max(time) as now, min(time) as oldest from b group by 1, 2), q as (select venue, instrument, min(case when time >= now - now % 86400 then time - (now - now % 86400) end) <= 60 as has_utc_day,
  any_value(now - oldest >= 604740) as has_7d, any_value(now - oldest >= 2591940) as has_30d, count(distinct case when time - time % 900 < now - now % 900 then time - time % 900 end) as prior_buckets from b join t using (venue, instrument) group by 1, 2)""")  # fmt: skip
def mover_coverage(spark, sf_dir):
    return movers.coverage_of(bars.ohlcv(trades(spark, sf_dir), 60))
