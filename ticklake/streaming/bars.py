"""Bars of a stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import aggressor_sign, notional
from ..operators.bars import KEYS, in_time


def stream_bars(trades: DataFrame, step: int, *, late: int = 3600, keys: list[str] = KEYS) -> DataFrame:
    """Bars that change as trades come (update mode). A trade up to ``late`` seconds behind the newest
    still corrects its bar, as a rebuild from retained trades would."""
    timed = trades.withColumn("__at", F.timestamp_seconds("sec")).withWatermark("__at", f"{late} seconds")
    bars = timed.groupBy(*keys, F.window("__at", f"{step} seconds").alias("__w")).agg(
        F.min_by("price", in_time()).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", in_time()).alias("close"),
        F.sum("quantity").alias("volume"), F.sum(notional()).alias("notional"), F.count(F.lit(1)).alias("trades"), F.sum(notional() * aggressor_sign()).alias("delta"),
    )
    return bars.select(*keys, F.unix_timestamp("__w.start").alias("time"), *bars.columns[len(keys) + 1 :])


def distinct_stream(trades: DataFrame, *, late: int = 3600) -> DataFrame:
    """Trades without repeats of (venue, trade_id) inside the watermark."""
    return trades.withColumn("__at", F.timestamp_seconds("sec")).withWatermark("__at", f"{late} seconds").dropDuplicatesWithinWatermark(["venue", "trade_id"]).drop("__at")
