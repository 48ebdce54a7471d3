"""Queries over scalar measures and small set operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decimals, scalars
from ..operators import bars, books, flow, heatmap, markets, sampling, stream_quality
from ..sources.tables import book_levels, depth_history, tape, trades
from .catalog import DAY, HOUR, KEYS, bars_sql, query


@query("event_id:l floor:d ceil:d half:d cut:d digits:l text", sql="""v as (select event_id, value::decimal(18,2) as p from events), q as (select event_id, floor(p * 10) / 10 as floor, ceil(p * 10) / 10 as ceil, round(p, 1) as half, trunc(p * 10) / 10 as cut,
  (p * 100)::bigint as digits, p::varchar as text from v)""")  # fmt: skip
def decimal_texts(spark, sf_dir):
    text = F.col("value").cast("decimal(18,2)").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("text"))
    value, parts = decimals.parse_decimal(F.col("text")), decimals.split_decimal(F.col("text"))
    at = lambda mode: decimals.rescale(value, 1, mode)
    return rows.select("event_id", at("floor").alias("floor"), at("ceil").alias("ceil"), at("half_away").alias("half"), at("toward_zero").alias("cut"), parts["coefficient"].alias("digits"), "text")


@query("event_id:l venue instrument", sql=f"tip as (select venue, instrument, max(sec) as now from trades group by 1, 2), q as (select event_id, t.venue, t.instrument from trades t join tip using (venue, instrument) where sec between now - {5 * DAY} and now)")
def trades_in_window(spark, sf_dir):
    return flow.in_window(tape(spark, sf_dir), 5 * DAY)


@query("event_id:l odd clamped:d jump:l", sql="q as (select event_id, instrument & 1 = 1 as odd, least(greatest(price, 150), 300) as clamped, case when abs(quantity::bigint * 100000000 - 2500000000) >= 1000000000 then quantity::bigint * 100000000 - 2500000000 end as jump from trades)")
def scalar_measures(spark, sf_dir):
    zero = F.lit(0).cast("long")
    jump = scalars.clock_jump(zero, F.col("quantity").cast("long") * 100_000_000, zero, F.lit(2_500_000_000).cast("long"))
    return trades(spark, sf_dir).select("event_id", scalars.has_flag("instrument", 1).alias("odd"), scalars.clamp(F.col("price"), 150, 300, 200).alias("clamped"), jump.alias("jump"))


@query("venue time:l per_second:d", sql="q as (select venue, sec - sec % 3600 as time, count(*) / 3600 as per_second from tape group by 1, 2)")
def event_rates(spark, sf_dir):
    return stream_quality.event_rates(tape(spark, sf_dir), 60)


@query("venue instrument badge", sql="""s as (select venue, instrument, max(exchange_ts_ns) // 1000000000 % 17 as age_s, max(exchange_ts_ns) // 1000000000 % 6000 as lag_ms, instrument <> 2 as has_book, count(*) filter (where kind = 'trade' and instrument = 1) as trades, count(*) filter (where kind = 'quote') as quotes from tape group by 1, 2),
  q as (select venue, instrument, unnest(list_filter([case when age_s > 8 then 'stale' end, case when lag_ms > 3000 then 'lag' end, case when not has_book then 'no-l2' end, case when trades = 0 and quotes > 0 then 'quotes-only' end], lambda x: x is not null)) as badge from s)""")  # fmt: skip
def quality_badges(spark, sf_dir):
    last = F.floor(F.max("exchange_ts_ns") / 1_000_000_000).cast("long")
    status = tape(spark, sf_dir).groupBy(*KEYS).agg((last % 17).alias("age_s"), (last % 6000).alias("lag_ms"), F.count_if((F.col("kind") == "trade") & (F.col("instrument") == 1)).alias("trades"), F.count_if(F.col("kind") == "quote").alias("quotes"))
    return stream_quality.market_quality(status.withColumn("has_book", F.col("instrument") != 2)).select(*KEYS, F.explode("badges").alias("badge"))


@query("venue instrument time:l", sql=bars_sql("b", HOUR) + f""", o as (select venue, instrument, time, row_number() over (partition by venue, instrument order by time) as n from b),
  r as (select venue, instrument, n, time, time as last, true as kept from o where n = 1 union all select o.venue, o.instrument, o.n, o.time, case when o.time - r.last >= {5 * HOUR} then o.time else r.last end, o.time - r.last >= {5 * HOUR} from r join o on o.venue = r.venue and o.instrument = r.instrument and o.n = r.n + 1), q as (select * from r where kept)""")  # fmt: skip
def throttled_bars(spark, sf_dir):
    return sampling.throttled(bars.ohlcv(trades(spark, sf_dir), HOUR).select(*KEYS, "time"), 5 * HOUR, keys=KEYS)


@query("venue instrument high:d", sql=bars_sql("b", HOUR) + ", q as (select venue, instrument, max(high) as high from b where time between 1704500000 and 1705500000 group by 1, 2)")
def highest_in_range(spark, sf_dir):
    return markets.extreme_in(bars.ohlcv(trades(spark, sf_dir), HOUR), F.lit(1_704_500_000), F.lit(1_705_500_000), "high")


@query("user_id:l symbols", sql="""u as (select user_id, list(distinct event_type order by event_type) as has from events group by 1), q as (select user_id, array_to_string(list_sort(case user_id % 3 when 0 then list_distinct(list_concat(has, ['click', 'refund'])) when 1 then list_filter(has, lambda x: x not in ('click', 'refund')) else ['click', 'refund'] end), ',') as symbols from u)""")
def patched_subscriptions(spark, sf_dir):
    has = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("has"))
    change = F.element_at(F.array(F.lit("add"), F.lit("remove"), F.lit("replace")), (F.col("user_id") % 3 + 1).cast("int"))
    return has.select("user_id", F.array_join(F.array_sort(markets.patched(F.col("has"), change, F.array(F.lit("click"), F.lit("refund")))), ",").alias("symbols"))


@query("venue instrument time:l price:d", sql=f"""l as (select venue, instrument, sec - sec % {HOUR} as time, arg_max(price, (exchange_ts_ns, event_id)) as price from tape where price > 0 group by 1, 2, 3), q as (select * from l where venue in ('v1', 'v3'))""")
def lines_of_kept_venues(spark, sf_dir):
    wanted = tape(spark, sf_dir).where("venue in ('v1', 'v3')")
    return markets.kept_venues(bars.venue_lines(tape(spark, sf_dir), HOUR), wanted)


@query("book_id:l side level:l price:d cum_quantity:d", "book", sql="""r as (select *, row_number() over w as level, sum(quantity) over (w rows unbounded preceding) as cum_quantity from book where quantity > 0 window w as (partition by book_id, side order by case side when 'bid' then -price else price end)),
  g as (select book_id, unnest(['bid', 'ask']) as side from (select distinct book_id from book)), s as (select book_id, side, unnest(range(1, 13)) as level from g), q as (select s.book_id, s.side, s.level, price, cum_quantity from s left join r using (book_id, side, level))""")  # fmt: skip
def depth_slots(spark, sf_dir):
    return books.slots(book_levels(spark, sf_dir), 12)


@query("book_id:l t:l side price:d quantity:d heat:d", "depth", sql="""m as (select book_id, max(usd) as most from depth group by 1), q as (select book_id, t, side, price, usd / price as quantity, least(1, greatest(0, 0.12 + power(ln(1 + usd::double) / ln(1 + most::double), 1 / 1.5) * 0.88)) as heat from depth join m using (book_id))""")
def depth_heat(spark, sf_dir):
    h = heatmap.book_from_sample(depth_history(spark, sf_dir))
    most = h.groupBy("book_id").agg(F.max("usd").alias("most"))
    return h.join(most, "book_id").withColumn("heat", heatmap.intensity(F.col("usd").cast("double"), F.col("most").cast("double"), 1.5))
