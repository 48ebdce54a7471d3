"""Trade-flow measures: cumulative delta, volume at price, footprint, bubbles, heuristics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import aggressor_sign, bucket, buy_share, notional, quantize, sell_share
from .windows import following, running_sums, top

KEYS = ["venue", "instrument"]


def in_window(tape: DataFrame, window: int, *, now: Column | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Trades within ``window`` seconds of ``now`` (default: the key's newest trade), both ends included."""
    trades = tape.where("kind = 'trade'")
    if now is not None:
        return trades.where(F.col("sec").between(now - window, now))
    tip = trades.groupBy(*keys).agg(F.max("sec").alias("__now"))
    return trades.join(tip, keys).where(F.col("sec").between(F.col("__now") - window, F.col("__now"))).drop("__now")


def cvd_totals(trades: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """Signed turnover and its parts; trades of unknown side count in ``trades`` only."""
    usd, sign = notional(), aggressor_sign()
    side = lambda name, x: F.sum(F.when(F.col("aggressor") == name, x).otherwise(0))
    return trades.groupBy(*keys).agg(
        F.sum(usd * sign).alias("cvd"), side("buy", usd).alias("buy_usd"), side("sell", usd).alias("sell_usd"),
        side("buy", F.col("quantity")).alias("buy_quantity"), side("sell", F.col("quantity")).alias("sell_quantity"), F.count(F.lit(1)).alias("trades"),
    )


def cvd_points(trades: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """The running cumulative delta, bought and sold turnover after each trade."""
    usd = notional()
    sums = {"cvd": usd * aggressor_sign(), "cum_buy": F.when(F.col("aggressor") == "buy", usd).otherwise(0), "cum_sell": F.when(F.col("aggressor") == "sell", usd).otherwise(0)}
    return running_sums(trades, keys, ["exchange_ts_ns", "event_id"], sums)


def cvd_histogram(trades: DataFrame, step: int = 1, *, keys: list[str] = KEYS) -> DataFrame:
    usd = notional()
    return trades.groupBy(*keys, bucket("sec", step).alias("time")).agg(
        F.sum(F.when(F.col("aggressor") == "buy", usd).otherwise(0)).alias("buy_usd"), F.sum(F.when(F.col("aggressor") == "sell", usd).otherwise(0)).alias("sell_usd"),
    )


def volume_at_price(trades: DataFrame, tick: str, *, keys: list[str] = KEYS, most: int | None = 48) -> DataFrame:
    """Bought and sold quantity and turnover by price step; unknown trades count half for each. Beyond
    ``most`` steps the ones nearest the middle of the extremes are kept, as the feature asks."""
    usd = notional()
    cells = trades.where("price > 0 and quantity is not null").groupBy(*keys, quantize("price", tick).alias("price_step")).agg(
        F.sum(F.col("quantity") * buy_share("half")).alias("buy_quantity"), F.sum(F.col("quantity") * sell_share("half")).alias("sell_quantity"),
        F.sum(usd * aggressor_sign()).alias("delta_usd"), F.sum(usd).alias("usd"),
    )
    if most is None:
        return cells
    span = cells.groupBy(*keys).agg(((F.min("price_step") + F.max("price_step")) / 2).cast("decimal(18,9)").alias("__middle"))
    near = F.abs(F.col("price_step") - F.col("__middle"))
    return top(cells.join(span, keys), keys, most, near, "price_step").drop("__middle")


def footprint(trades: DataFrame, step: int, tick: str, *, keys: list[str] = KEYS, most: int | None = 400) -> DataFrame:
    """(time, price step) cells: sells hit the bid, buys lift the ask, unknown trades half each."""
    usd = notional()
    cells = trades.where("price > 0").groupBy(*keys, bucket("sec", step).alias("time"), quantize("price", tick).alias("price_step")).agg(
        F.sum(F.col("quantity") * sell_share("half")).alias("bid_quantity"), F.sum(F.col("quantity") * buy_share("half")).alias("ask_quantity"), F.sum(usd).alias("usd"),
    )
    return cells if most is None else top(cells, keys, most, F.desc("usd"), F.desc("time"), F.desc("price_step"))


def bubbles(trades: DataFrame, tick: str, *, step_ms: int = 500, keys: list[str] = KEYS, newest: int = 180, least_usd: float = 0) -> DataFrame:
    """Trades by (time, price step) with total and signed turnover, and turnover bought and sold (unknown
    trades half each); the newest cells of each key."""
    usd = notional()
    half = lambda share: F.sum(F.col("price") * (F.col("quantity") * share)).cast("decimal(38,9)")
    at = F.floor(F.col("sec") * 1000 / step_ms).cast("long") * step_ms
    cells = trades.groupBy(*keys, at.alias("time_ms"), quantize("price", tick).alias("price_step")).agg(F.sum(usd).alias("usd"), F.sum(usd * aggressor_sign()).alias("delta_usd"), half(buy_share("half")).alias("buy_usd"), half(sell_share("half")).alias("sell_usd"), F.count(F.lit(1)).alias("trades"))
    return top(cells.where(F.col("usd") >= least_usd), keys, newest, F.desc("time_ms"), F.desc("price_step"))


def print_groups(trades: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """Prints of one side at one price (two decimals) as one row."""
    cents = F.floor(F.col("price") * 100 + F.lit("0.5").cast("decimal(2,1)")).cast("decimal(20,0)")
    return trades.groupBy(*keys, "aggressor", cents.alias("cents")).agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("prints"), F.max("exchange_ts_ns").alias("newest_ns"))


def large_orders(trades: DataFrame, *, keys: list[str] = KEYS, newest: int = 48, times: float = 50) -> DataFrame:
    """Of the newest prints, the first of each side whose quantity is ``times`` the mean of the key's
    other prints."""
    sums = trades.groupBy(*keys).agg(F.sum("quantity").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    last = top(trades, keys, newest, F.desc("exchange_ts_ns"), F.desc("event_id")).join(sums, keys)
    others = (F.col("__sum") - F.col("quantity")) / F.when(F.col("__n") > 1, F.col("__n") - 1)
    hit = last.withColumn("mean_of_others", others.cast("double")).where((F.col("mean_of_others") > 0) & (F.col("quantity").cast("double") >= times * F.col("mean_of_others")) & F.col("aggressor").isin("buy", "sell"))
    return top(hit, [*keys, "aggressor"], 1, F.desc("exchange_ts_ns"), F.desc("event_id")).drop("__sum", "__n")


def flow_heuristics(trades: DataFrame, pressure: DataFrame, *, keys: list[str] = KEYS, large_usd: float = 25_000, newest: int = 12) -> DataFrame:
    """Large prints, sweeps into a thin opposite side and absorption by depth that refills.

    ``pressure`` (keys, bid_usd, ask_usd) has a row a key. One finding a (kind, side, second, rounded
    turnover) counts; the newest of each key are kept.
    """
    rows = following(trades.withColumn("usd", notional()), keys, ["exchange_ts_ns", "event_id"], ["aggressor", "sec", "price"])
    rows = rows.withColumnsRenamed({"next_aggressor": "__side", "next_sec": "__sec", "next_price": "__price"})
    rows = rows.where(F.col("usd") >= large_usd).join(pressure, keys, "left")
    buy, known = F.col("aggressor") == "buy", F.col("aggressor").isin("buy", "sell")
    opposite = F.when(buy, F.col("ask_usd")).when(F.col("aggressor") == "sell", F.col("bid_usd"))
    sweep = known & (opposite > 0) & (F.col("usd") >= opposite * 0.35)
    again = known & (F.col("__side") == F.col("aggressor")) & (F.abs(F.col("__sec") - F.col("sec")) <= 2) & (F.abs(F.col("__price") - F.col("price")) / F.col("price") < 0.00015)
    absorbed = again & (opposite > F.col("usd") * 0.5)
    kinds = F.filter(F.array(F.lit("large"), F.when(sweep, "sweep"), F.when(absorbed, "absorption")), lambda x: x.isNotNull())
    side = F.when(known, F.col("aggressor"))
    found = rows.select(*keys, "event_id", "exchange_ts_ns", "sec", "price", "usd", side.alias("side"), F.explode(kinds).alias("finding"))
    same = [*keys, "finding", "side", "sec", F.floor(F.col("usd") + F.lit("0.5").cast("decimal(2,1)"))]
    found = found.withColumn("__n", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("exchange_ts_ns"), F.desc("event_id")))).where("__n = 1").drop("__n")
    return top(found, keys, newest, F.desc("exchange_ts_ns"), F.desc("event_id"), F.desc("finding"))
