"""Market-data views over Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task sums up to levels.
LEVEL_ROWS = 1 << 19


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades and quotes: event_id, kind, venue, instrument, price, quantity, aggressor, exchange_ts_ns, sec."""
    kind = F.when(F.col("event_type").isin("purchase", "error", "click"), "trade").otherwise("quote")
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "error", "sell").otherwise("unknown")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return read_table(spark, sf_dir, "events").select(
        "event_id", kind.alias("kind"), F.concat(F.lit("v"), F.pmod("user_id", F.lit(5)).cast("string")).alias("venue"), (F.pmod("user_id", F.lit(3)).cast("int") + 1).alias("instrument"),
        (100 + F.col("value").cast("decimal(18,2)")).cast("decimal(18,9)").alias("price"), F.get_json_object("props", "$.k").cast("decimal(18,9)").alias("quantity"),
        side.alias("aggressor"), (micros * 1000).alias("exchange_ts_ns"), F.floor(micros / 1_000_000).cast("long").alias("sec"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape(spark, sf_dir).where("kind = 'trade'")


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resting quantity: book_id, side, price, quantity."""
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,0)")
    bid = F.col("l_linestatus") == "O"
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("book_id"), F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 200_000 - unit).otherwise(200_000 + unit).cast("decimal(18,0)").alias("price"), F.col("l_quantity").cast("decimal(18,0)").alias("quantity"),
    )
    # few rows share a level, so sums before the shuffle would only hold most of a task's input
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // LEVEL_ROWS))
    dealt = rows.repartition(tasks, "book_id", "side")  # rankings of a side stay in these tasks
    return dealt.groupBy("book_id", "side", "price").agg(F.sum("quantity").cast("decimal(28,0)").alias("quantity"))


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update numbers with gaps: session, seq."""
    return read_table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0").select(F.pmod(F.floor(F.col("o_orderkey") / 400), F.lit(6)).alias("session"), F.col("o_orderkey").alias("seq"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows: venue, instrument, symbol, live."""
    pairs = tape(spark, sf_dir).select("venue", "instrument").distinct()
    return pairs.select("venue", "instrument", F.concat(F.lit("SYM"), F.col("instrument").cast("string")).alias("symbol"), (F.col("venue") != "v4").alias("live"))


#: Names that venues give themselves and their instruments, for the catalog below.
VENUE_NAMES = ("binance-spot", "okx-swap", "deribit", "kraken-spot", "gemini", "coinbase-intl", "bitfinex-deriv")
SYMBOLS = ("BTCUSDT", "ETH-USDT-SWAP", "tSOLUSD", "PF_XBTUSD", "XRP/USD", "BNBUSD_PERP", "eth-eur", "BTC-PERPETUAL", "dogebtc", "USDT", "XBT/USD", "btc_spot", "1INCH-USDC")
SYSTEM_KINDS = ("sequence_gap", "checksum_mismatch", "book_invalidated", "resync_started", "dropped", "parse_failure", "book_valid")


def _pick(names: tuple[str, ...], index: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(index, F.lit(len(names))) + 1).cast("int"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of all users' instruments: venue, adapter, symbol, instrument."""
    users = read_table(spark, sf_dir, "events").select("user_id").distinct()
    venue = _pick(VENUE_NAMES, "user_id")
    rows = users.select(venue.alias("venue"), F.split(venue, "-")[0].alias("adapter"), _pick(SYMBOLS, "user_id").alias("symbol"), (F.pmod("user_id", F.lit(len(VENUE_NAMES) * len(SYMBOLS)))).cast("int").alias("instrument"))
    return rows.distinct()


def venue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue, live, events of the venues whose users had a purchase."""
    rows = read_table(spark, sf_dir, "events").groupBy(_pick(VENUE_NAMES, "user_id").alias("venue")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "purchase").alias("__n"))
    return rows.where(F.col("venue") != "gemini").select("venue", (F.col("__n") % 2 == 0).alias("live"), "events")


def system_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue, session, instrument, seq, kind, detail, count."""
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), F.pmod("user_id", F.lit(5)).cast("string")).alias("venue"), F.pmod("user_id", F.lit(4)).alias("session"), (F.pmod("user_id", F.lit(3)).cast("int") + 1).alias("instrument"),
        F.col("event_id").alias("seq"), _pick(SYSTEM_KINDS, "event_id").alias("kind"), F.col("event_type").alias("detail"), F.get_json_object("props", "$.k").cast("long").alias("count"),
    )


def depth_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth samples: book_id, t (ms, with one long gap), side, price, usd."""
    unit, bid, n = F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 100).cast("decimal(18,0)"), F.col("l_linestatus") == "O", F.pmod("l_orderkey", F.lit(50))
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(10)).alias("book_id"), (n * 300 + F.when(n > 25, 5000).otherwise(0)).alias("t"), F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 200_000 - unit).otherwise(200_000 + unit).cast("decimal(18,0)").alias("price"), (F.col("l_quantity") * 100).cast("decimal(18,0)").alias("usd"),
    )
    return rows.groupBy("book_id", "t", "side", "price").agg(F.sum("usd").cast("decimal(28,0)").alias("usd"))


def depth_mids(history: DataFrame) -> DataFrame:
    """book_id, t, mid of samples with both sides."""
    best = history.groupBy("book_id", "t").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).cast("double").alias("b"), F.min(F.when(F.col("side") == "ask", F.col("price"))).cast("double").alias("a"))
    return best.select("book_id", "t", ((F.col("b") + F.col("a")) / 2).alias("mid")).where("mid is not null")


def _sql_pick(names: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(x) for x in names)}])[{index} % {len(names)} + 1]"


#: The same views in SQL, for the oracles.
SQL = {
    "tape": """tape as (
  select event_id, case when event_type in ('purchase','error','click') then 'trade' else 'quote' end as kind, 'v' || (user_id % 5) as venue, (user_id % 3)::int + 1 as instrument,
    (100 + value::decimal(18,2))::decimal(18,9) as price, json_extract_string(props, '$.k')::decimal(18,9) as quantity,
    case event_type when 'purchase' then 'buy' when 'error' then 'sell' else 'unknown' end as aggressor, epoch_us(ts) * 1000 as exchange_ts_ns, epoch_us(ts) // 1000000 as sec from events
), trades as (select * from tape where kind = 'trade')""",
    "book": """book as (
  select l_suppkey as book_id, case l_linestatus when 'O' then 'bid' else 'ask' end as side,
    case l_linestatus when 'O' then 200000 - floor(l_extendedprice / l_quantity)::decimal(18,0) else 200000 + floor(l_extendedprice / l_quantity)::decimal(18,0) end as price,
    sum(l_quantity::decimal(18,0)) as quantity from lineitem group by 1, 2, 3
)""",
    "listings": f"""listings as (
  select distinct {_sql_pick(VENUE_NAMES, 'user_id')} as venue, string_split({_sql_pick(VENUE_NAMES, 'user_id')}, '-')[1] as adapter, {_sql_pick(SYMBOLS, 'user_id')} as symbol, (user_id % {len(VENUE_NAMES) * len(SYMBOLS)})::int as instrument from events
), states as (
  select {_sql_pick(VENUE_NAMES, 'user_id')} as venue, count(*) filter (where event_type = 'purchase') % 2 = 0 as live, count(*) as events from events group by 1 having venue <> 'gemini'
)""",
    "system": f"""system as (
  select 'v' || (user_id % 5) as venue, user_id % 4 as session, (user_id % 3)::int + 1 as instrument, event_id as seq, {_sql_pick(SYSTEM_KINDS, 'event_id')} as kind, event_type as detail, json_extract_string(props, '$.k')::bigint as count from events
)""",
    "depth": """depth as (
  select l_suppkey % 10 as book_id, (l_orderkey % 50) * 300 + case when l_orderkey % 50 > 25 then 5000 else 0 end as t, case l_linestatus when 'O' then 'bid' else 'ask' end as side,
    case l_linestatus when 'O' then 200000 - floor(l_extendedprice / l_quantity / 100)::decimal(18,0) else 200000 + floor(l_extendedprice / l_quantity / 100)::decimal(18,0) end as price,
    sum((l_quantity * 100)::decimal(18,0)) as usd from lineitem group by 1, 2, 3, 4
), mids as (
  select * from (select book_id, t, (max(price) filter (where side = 'bid')::double + min(price) filter (where side = 'ask')::double) / 2 as mid from depth group by 1, 2) where mid is not null
)""",
    "seq": "seqs as (select (o_orderkey // 400) % 6 as session, o_orderkey as seq from orders where o_orderkey % 97 <> 0)",
}
