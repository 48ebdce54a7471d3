"""Market lists, catalog lookups, filters over trades, and small tables of a trading screen.

A catalog has (venue, adapter, symbol, instrument) rows, statuses (venue, live, events).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import notional
from ..functions.symbols import asset_rank, base_asset, market_kind
from .stream_quality import last_of
from .windows import running_sums, top

KEYS = ["venue", "instrument"]


def prints(trades: DataFrame, *, side: str | None = None, least_usd: float = 0) -> DataFrame:
    """Trades of one side, of a least turnover."""
    rows = trades.where("kind = 'trade'").where(F.coalesce(notional(), F.lit(0)) >= least_usd)
    return rows.where(F.col("aggressor") == side) if side else rows


def market_rows(catalog: DataFrame, status: DataFrame) -> DataFrame:
    """Every listed symbol with its kind, asset, and its venue's state; venues without one are live."""
    rows = catalog.join(status, "venue", "left")
    return rows.select(
        "venue", F.coalesce("adapter", F.lit("")).alias("adapter"), "symbol", "instrument", F.coalesce("live", F.lit(True)).alias("live"),
        market_kind(F.col("venue"), F.col("symbol")).alias("kind"), base_asset(F.col("symbol")).alias("asset"), F.coalesce("events", F.lit(0)).alias("events"),
    )


def asset_venues(catalog: DataFrame, status: DataFrame, *, order: str = "instrument") -> DataFrame:
    """For each asset and venue that has it the first symbol listed."""
    rows = market_rows(catalog, status).where("asset is not null")
    return top(rows, ["asset", "venue"], 1, order, "symbol")


def filtered(markets: DataFrame, *, live: bool | None = None, kind: str | None = None, text: str = "") -> DataFrame:
    """Market rows by state, kind, and text found in venue, symbol, adapter, asset or kind."""
    rows = markets if live is None else markets.where(F.col("live") == live)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    wanted = text.strip().lower()
    if not wanted:
        return rows
    hit = [F.lower(F.coalesce(c, F.lit(""))).contains(wanted) for c in ("venue", "symbol", "adapter", "asset", "kind")]
    return rows.where(hit[0] | hit[1] | hit[2] | hit[3] | hit[4])


def sections(markets: DataFrame, by: str) -> DataFrame:
    """Totals of market rows by ``asset`` or ``venue``; rows without one are UNKNOWN. rank orders them."""
    name = F.coalesce(by, F.lit("UNKNOWN"))
    out = markets.groupBy(name.alias("section")).agg(F.count(F.lit(1)).alias("total"), F.count_if("live").alias("live"), F.min("kind").alias("kind"))
    return out.withColumn("rank", asset_rank(F.col("section")) if by == "asset" else F.lit(0))


def market_order(selected_asset: str | None = None) -> list[Column]:
    """Rows of the selected asset first, then by venue and symbol."""
    first = F.when(F.col("asset") == selected_asset, 0).otherwise(1) if selected_asset else F.lit(0)
    return [first, F.col("venue"), F.col("symbol")]


def requested(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Catalog rows of the wanted (venue, symbol) pairs."""
    return catalog.join(wanted.select("venue", "symbol").distinct(), ["venue", "symbol"], "left_semi")


def by_native(catalog: DataFrame) -> DataFrame:
    """The first instrument of each (venue, symbol), as lookups find it."""
    return catalog.groupBy("venue", "symbol").agg(F.min("instrument").alias("instrument"))


def resolved(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests (venue, symbol, instrument) with their instrument: the one given, else the symbol's, else 1."""
    found = by_native(catalog).withColumnRenamed("instrument", "__found")
    out = requests.join(found, ["venue", "symbol"], "left")
    return out.withColumn("instrument", F.coalesce("instrument", "__found", F.lit(1))).drop("__found")


def selected(catalog: DataFrame, *, ids: list[int] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Instruments by id, by native symbol, or all active ones (rows without ``active`` are)."""
    if ids is not None:
        return catalog.where(F.col("instrument").isin(*ids))
    if symbols is not None:
        return catalog.where(F.col("symbol").isin(*symbols))
    return catalog.where(F.coalesce("active", F.lit(True))) if "active" in catalog.columns else catalog


def named(events: DataFrame, catalog: DataFrame, venues: DataFrame) -> DataFrame:
    """Events with ``symbol`` and ``venue_name``; a venue without a name is venue-<id>, a symbol can be missing."""
    rows = events.join(catalog.select(*KEYS, "symbol"), KEYS, "left").join(venues.select("venue", F.col("name").alias("__name")), "venue", "left")
    return rows.withColumn("venue_name", F.coalesce("__name", F.concat(F.lit("venue-"), F.col("venue").cast("string")))).drop("__name")


def patched(current: Column, change: Column, symbols: Column) -> Column:
    """A subscription's symbols after an ``add``, ``remove`` or ``replace``."""
    return F.when(change == "add", F.array_union(current, symbols)).when(change == "remove", F.array_except(current, symbols)).otherwise(F.array_distinct(symbols))


def kept_venues(lines: DataFrame, venues: DataFrame) -> DataFrame:
    """Lines of the venues that are still wanted."""
    return lines.join(venues.select("venue").distinct(), "venue", "left_semi")


def tape_totals(trades: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """Quantity, turnover and number of trades, the share bought, and trades a minute of the session."""
    bought = F.sum(F.when(F.col("aggressor") == "buy", notional()).otherwise(0)).cast("double")
    sold = F.sum(F.when(F.col("aggressor") == "sell", notional()).otherwise(0)).cast("double")
    return trades.groupBy(*keys).agg(
        F.sum("quantity").alias("quantity"), F.sum(notional()).alias("usd"), F.count(F.lit(1)).alias("trades"), (F.try_divide(bought, bought + sold) * 100).alias("buy_percent"),
        (F.count(F.lit(1)) / (F.max("sec") - F.min("sec") + 1) * 60).alias("trades_per_min"),
    )


def running_session(trades: DataFrame, *, keys: list[str] = KEYS, block: int = 86_400) -> DataFrame:
    """Each trade with the session's high, low and volume so far. Extremes start each block from those
    of the blocks before it, so a busy instrument is as many tasks as it has blocks."""
    at = F.floor(F.col("sec") / block).cast("long").alias("__block")
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = trades.groupBy(*keys, at).agg(F.max("price").alias("__h"), F.min("price").alias("__l"))
    starts = ends.select(*keys, "__block", F.max("__h").over(before).alias("__high"), F.min("__l").over(before).alias("__low"))
    rows = running_sums(trades, keys, ["exchange_ts_ns", "event_id"], {"volume": F.col("quantity")}, block=block).withColumn("__block", at)
    inside = Window.partitionBy(*keys, "__block").orderBy("sec", "exchange_ts_ns", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__h": F.max("price").over(inside), "__l": F.min("price").over(inside)}).join(starts, [*keys, "__block"])
    return rows.withColumns({"high": F.greatest("__h", "__high"), "low": F.least("__l", "__low")}).drop("__block", "__h", "__l", "__high", "__low")


def extreme_in(bars: DataFrame, start: Column, end: Column, which: str, *, keys: list[str] = KEYS) -> DataFrame:
    """The highest high or lowest low of bars from start to end, both included."""
    value = F.max("high") if which == "high" else F.min("low")
    return bars.where(F.col("time").between(start, end)).groupBy(*keys).agg(value.alias(which))


def distinct_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes of one venue, time and middle price are one."""
    mid = (F.col("bid_price") + F.col("ask_price")) / 2
    return quotes.withColumn("__mid", mid).dropDuplicates(["venue", "receive_ts_ns", "__mid"]).drop("__mid")


def merged_tape(held: DataFrame, arrived: DataFrame, *, now: Column, key: list[str] = ["trade_id"], seconds: int = 1800, most: int = 50_000, keys: list[str] = KEYS) -> DataFrame:  # noqa: B006
    """The focus tape after new rows: of rows with one key the last to arrive stays, of those the newest
    ``most`` of the last ``seconds``. ``fresh`` marks what the tape didn't hold."""
    rows = held.withColumn("__n", F.lit(0)).unionByName(arrived.withColumn("__n", F.lit(1)))
    rows = last_of(rows, key, "__n", "exchange_ts_ns").where(F.col("sec") >= now - seconds)
    rows = top(rows, keys, most, F.desc("exchange_ts_ns"), F.desc("event_id"))
    before = held.select(*key).distinct().withColumn("__held", F.lit(True))
    return rows.join(before, key, "left").withColumn("fresh", F.col("__held").isNull()).drop("__n", "__held")


def flow_markers(findings: DataFrame) -> DataFrame:
    """Findings of ``flow_heuristics`` with the mark they are drawn with and what they aren't."""
    kind = F.col("finding")
    note = F.when(kind == "sweep", "guessed from prints that run through prices; no venue said so").when(kind == "absorption", "guessed from prints at a price that held; single orders aren't seen").otherwise("one large print; nothing says why it was made")
    return findings.withColumns({"marker": F.when(kind == "sweep", "triangle").when(kind == "absorption", "square").otherwise("diamond"), "note": note})


def flags(trades: DataFrame, *, large_usd: float = 15_000, newest: int = 24, most: int = 18, keys: list[str] = KEYS) -> DataFrame:
    """The newest large prints of each key; for keys without one, those of most turnover."""
    rows = trades.withColumn("usd", notional())
    rows = rows.withColumn("large", F.coalesce(F.col("usd") >= large_usd, F.lit(False)))
    order = [F.desc("exchange_ts_ns"), F.desc("event_id")]
    large = top(rows.where("large"), keys, newest, *order)
    has = rows.groupBy(*keys).agg(F.bool_or("large").alias("__has")).where("not __has").select(*keys)
    rest = top(rows.where("not large and usd > 0"), keys, most, F.desc("usd"), F.desc("event_id")).join(has, keys, "left_semi")
    return large.unionByName(rest)


def volume_or_book(cells: DataFrame, levels: DataFrame, *, depth: int = 12, most: int = 22, keys: list[str] = KEYS) -> DataFrame:
    """Volume at price, the highest ``most`` prices of each key; for keys without any, the book's best
    levels as if bids were bought and asks sold."""
    from .books import ranked

    cells = cells.select(*keys, F.col("price_step").alias("price"), "buy_usd", "sell_usd", F.lit(False).alias("from_book"))
    usd = (F.col("price") * F.col("quantity")).cast("decimal(38,9)")
    bid, zero = F.col("side") == "bid", F.lit(0).cast("decimal(38,9)")
    book = ranked(levels, depth, keys=keys).join(cells.select(*keys).distinct(), keys, "left_anti")
    book = book.select(*keys, "price", F.when(bid, usd).otherwise(zero).alias("buy_usd"), F.when(bid, zero).otherwise(usd).alias("sell_usd"), F.lit(True).alias("from_book"))
    return top(cells.unionByName(book), keys, most, F.desc("price"))


def nearest_cell(cells: DataFrame, probes: DataFrame, tick: Column, *, keys: list[str] = KEYS, ticks: int = 2) -> DataFrame:
    """For each probe (keys, price) the nearest price step within ``ticks``; nulls where none."""
    from .books import resting_at

    rows = cells.select(*keys, F.lit("cell").alias("side"), F.col("price_step").alias("price"), F.col("usd").alias("quantity"))
    out = resting_at(rows, probes, tick, keys=keys, ticks=ticks)
    return out.select(*keys, "probe", F.col("resting_price").alias("price_step"), F.col("quantity").alias("usd"))
