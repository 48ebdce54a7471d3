"""Time bars and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket, buy_share, notional, sell_share
from .windows import chunks, following, top

KEYS = ["venue", "instrument"]


def in_time() -> Column:
    return F.struct("exchange_ts_ns", "event_id")


def ohlcv(trades: DataFrame, step: int, *, keys: list[str] = KEYS, unknown: str = "sell") -> DataFrame:
    """Bars of ``step`` seconds. Open and close follow event time, not arrival; one shuffle with a
    map-side combine, so a hot instrument costs no more than another."""
    usd, buy, sell = notional(), buy_share(unknown), sell_share(unknown)
    return trades.groupBy(*keys, bucket("sec", step).alias("time")).agg(
        F.min_by("price", in_time()).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", in_time()).alias("close"),
        F.sum("quantity").alias("volume"), F.sum(usd).alias("notional"), F.count(F.lit(1)).alias("trades"),
        F.sum(F.col("quantity") * buy).alias("buy_quantity"), F.sum(F.col("quantity") * sell).alias("sell_quantity"),
        F.sum(usd * buy.cast("int")).alias("buy_notional") if unknown != "half" else F.sum(F.col("price") * (F.col("quantity") * buy)).alias("buy_notional"),
    )


def roll_up(bars: DataFrame, step: int, *, keys: list[str] = KEYS) -> DataFrame:
    """Coarser bars of bars."""
    return bars.groupBy(*keys, bucket("time", step).alias("time")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"),
        F.sum(F.coalesce("notional", "volume", F.lit(0))).alias("volume"), F.sum("trades").alias("trades"),
    )


def session_stats(trades: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """High, low, totals, last price and the price before it."""
    last_two = F.reverse(F.array_sort(F.collect_set(F.struct("exchange_ts_ns", "event_id", "price"))))
    newest = top(trades, keys, 2, F.desc("exchange_ts_ns"), F.desc("event_id")).groupBy(*keys).agg(last_two.alias("__two"))
    newest = newest.select(*keys, F.col("__two")[0]["price"].alias("last_price"), F.get("__two", F.lit(1))["price"].alias("previous_price"))
    totals = trades.groupBy(*keys).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume"), F.sum(notional()).alias("notional"), F.count(F.lit(1)).alias("trades"),
        F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"),
    )
    return totals.join(newest, keys)


def window_stats(bars: DataFrame, window: int, *, keys: list[str] = KEYS) -> DataFrame:
    """Totals of bars at or after a key's newest bar less ``window`` seconds (closed at the left)."""
    tip = bars.groupBy(*keys).agg(F.max("time").alias("__tip"))
    near = bars.join(tip, keys).where(F.col("time") >= F.col("__tip") - window)
    return near.groupBy(*keys).agg(
        F.sum("volume").alias("volume"), F.sum("notional").alias("notional"), F.sum("trades").alias("trades"), (F.sum("trades") / window * 60).alias("trades_per_min"),
    )


def high_volume_gate(bars: DataFrame, *, keys: list[str] = KEYS, rows: int = 24, times: float = 50.0, chunk: int = 100_000) -> DataFrame:
    """Whether a bar's turnover is ``times`` the mean of the bars before it (existing ones, ``rows`` at
    most; fewer are flagged ``limited``). A key's bars are cut to chunks that see the ``rows`` before them."""
    cut = chunks(bars.select(*keys, "time", "notional"), keys, "time", rows=max(chunk, rows), halo=rows, block=30 * 86_400)
    prior = Window.partitionBy(*keys, "__chunk").orderBy("__rank").rowsBetween(-rows, -1)
    mean, n = F.avg(F.col("notional").cast("double")).over(prior), F.count(F.lit(1)).over(prior)
    out = cut.withColumns({"prior_mean": mean, "prior_bars": n}).where("__own").select(*keys, "time", F.col("notional").cast("double").alias("notional"), "prior_mean", "prior_bars")
    gate = F.coalesce((F.col("prior_mean") > 0) & (F.col("notional") >= F.col("prior_mean") * times), F.lit(False))
    return out.withColumn("high_volume", gate).withColumn("limited", F.col("prior_bars") < rows)


def venue_lines(tape: DataFrame, step: int, *, keys: list[str] = KEYS) -> DataFrame:
    """Last price of each bucket over trades and quotes together, turnover and trades of the trades."""
    trade = F.col("kind") == "trade"
    return tape.where("price > 0").groupBy(*keys, bucket("sec", step).alias("time")).agg(
        F.max_by("price", in_time()).alias("price"), F.sum(F.when(trade, notional()).otherwise(0)).alias("notional"), F.count_if(trade).alias("trades"),
    )


def merge_volume(bars: DataFrame, *, by: str = "instrument") -> DataFrame:
    return bars.groupBy(by, "time").agg(F.sum("volume").alias("volume"), F.sum("trades").alias("trades"))


def zero_filled(bars: DataFrame, step: int, *, keys: list[str] = KEYS) -> DataFrame:
    """Bars with the missing steps between a key's first and last as zeros: each bar makes the zeros
    up to the next."""
    rows = following(bars.select(*keys, "time", "volume"), keys, [], ["time"], time="time", block=30 * 86_400)
    rows = rows.withColumn("__to", F.coalesce(F.col("next_time") - step, F.col("time")))
    grid = rows.select(*keys, "time", "volume", F.explode(F.sequence("time", "__to", F.lit(step))).alias("at"))
    return grid.select(*keys, F.col("at").alias("time"), F.when(F.col("at") == F.col("time"), F.col("volume")).otherwise(0).alias("volume"))


def zero_filled_flow(trades: DataFrame, *, keys: list[str] = KEYS, slack: int = 2) -> DataFrame:
    """Turnover bought, and sold as a negative, by second; the seconds of gaps over ``slack`` as zeros."""
    buy, sell = (F.sum(F.when(F.col("aggressor") == side, notional()).otherwise(0)).cast("double") for side in ("buy", "sell"))
    rows = trades.groupBy(*keys, F.col("sec").alias("time")).agg(buy.alias("buy_usd"), (F.lit(0.0) - sell).alias("sell_usd"))
    rows = following(rows, keys, [], ["time"], time="time")
    after = F.col("next_time")
    rows = rows.withColumn("__to", F.when(after - F.col("time") > slack, after - 1).otherwise(F.col("time")))
    grid = rows.select("*", F.explode(F.sequence("time", "__to", F.lit(1).cast("long"))).alias("at"))
    own = lambda c: F.when(F.col("at") == F.col("time"), F.col(c)).otherwise(0.0).alias(c)
    return grid.select(*keys, F.col("at").alias("time"), own("buy_usd"), own("sell_usd"))
