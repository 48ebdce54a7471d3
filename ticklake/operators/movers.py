"""Mover detection: one row of measures an instrument, then one row a status that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BANDS, HIGH_VOLUME_BANDS, bucket, classify_band, percent_change
from .bars import high_volume_gate, roll_up
from .flow import large_orders

DAY, KEYS = 86_400, ["venue", "instrument"]
#: Change since the day's open and distance from its extreme, in percent (fixed values).
DAY_MOVE, NEAR_EXTREME = 8, 5
KINDS = ("new_24h_high", "new_24h_low", "new_7d_high", "new_7d_low", "new_30d_high", "new_30d_low", "rise_5m", "fall_5m", "rise_2h", "fall_2h", "pullback", "rally", "up_high_volume", "down_high_volume", "large_buy", "large_sell")


def measures(bars: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """Closes now and before, extremes of the ranges and of the UTC day: one aggregation over bars that
    carry their key's newest time; no sort."""
    tip = bars.groupBy(*keys).agg(F.max("time").alias("now"), F.min("time").alias("oldest"))
    t, now = F.col("time"), F.col("now")
    rows = bars.join(tip, keys)
    close = F.col("close").cast("double")
    at_or_before = lambda s: F.max_by(F.when(t <= now - s, close), F.when(t <= now - s, t))
    within = lambda s: t >= now - s
    today = t >= now - F.pmod(now, F.lit(DAY))
    out = {"close": F.max_by(close, t), "close_5m": at_or_before(300), "close_2h": at_or_before(7200)}
    out |= {f"high_{d}d": F.max(F.when(within(d * DAY), F.col("high").cast("double"))) for d in (1, 7, 30)}
    out |= {f"low_{d}d": F.min(F.when(within(d * DAY), F.col("low").cast("double"))) for d in (1, 7, 30)}
    out |= {"last_high": F.max_by(F.col("high").cast("double"), t), "last_low": F.max_by(F.col("low").cast("double"), t)}
    out |= {"day_open": F.min_by(F.when(today, F.col("open").cast("double")), F.when(today, t)), "day_high": F.max(F.when(today, F.col("high").cast("double"))), "day_low": F.min(F.when(today, F.col("low").cast("double")))}
    return rows.groupBy(*keys, "now", "oldest").agg(*[c.alias(n) for n, c in out.items()])


def statuses(m: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """(keys, kind, band, change) for every status that holds. Ranges that history doesn't span are left out."""
    c = F.col
    span = c("now") - c("oldest")
    found: list[tuple[str, Column, Column, Column]] = []
    none = F.lit(None).cast("string")
    for d, name in ((1, "24h"), (7, "7d"), (30, "30d")):
        whole = span >= (60 if d == 1 else d * DAY - 60)
        found += [(f"new_{name}_high", whole & (c("last_high") >= c(f"high_{d}d")), none, c("last_high")), (f"new_{name}_low", whole & (c("last_low") <= c(f"low_{d}d")), none, c("last_low"))]
    for name in ("5m", "2h"):
        change = percent_change(c(f"close_{name}"), c("close"))
        band = classify_band(change, BANDS)
        found += [(f"rise_{name}", (change > 0) & band.isNotNull(), band, change), (f"fall_{name}", (change < 0) & band.isNotNull(), band, change)]
    up, down = percent_change(c("day_open"), c("day_high")), percent_change(c("day_open"), c("day_low"))
    below, above = F.try_divide(c("day_high") - c("close"), c("day_high")) * 100, percent_change(c("day_low"), c("close"))
    found += [("pullback", (up >= DAY_MOVE) & below.between(0, NEAR_EXTREME), none, up), ("rally", (down <= -DAY_MOVE) & (above >= NEAR_EXTREME), none, down)]
    rows = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(k).alias("kind"), b.alias("band"), x.cast("double").alias("change"))) for k, hit, b, x in found])
    out = m.select(*keys, F.explode(F.array_compact(rows)).alias("s")).select(*keys, "s.*")
    return out.withColumn("rank", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int"))


def high_volume_moves(gate: DataFrame, moves: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """(keys, kind, band, change) of bars whose turnover passes the gate and whose price moved by a band:
    ``gate`` has high_volume and limited, ``moves`` open and close, both by (keys, time)."""
    change = percent_change(F.col("open").cast("double"), F.col("close").cast("double"))
    rows = gate.where("high_volume").join(moves.select(*keys, "time", change.alias("change")), [*keys, "time"])
    kind = F.when(F.col("change") > 0, "up_high_volume").otherwise("down_high_volume")
    return rows.select(*keys, "time", kind.alias("kind"), classify_band(F.col("change"), HIGH_VOLUME_BANDS).alias("band"), "change", "limited").where("band is not null")


def volume_statuses(bars: DataFrame, *, keys: list[str] = KEYS, step: int = 900, times: float = 50.0) -> DataFrame:
    """(keys, kind, band, change, limited) where the bucket of the newest bar has ``times`` the mean
    turnover of the 24 before it and the price moved by a band since ``step`` seconds before."""
    tip = bars.groupBy(*keys).agg(F.max("time").alias("now"))
    now, t, close = F.col("now"), F.col("time"), F.col("close").cast("double")
    before = F.max_by(F.when(t <= now - step, close), F.when(t <= now - step, t))
    moved = bars.join(tip, keys).groupBy(*keys, "now").agg(percent_change(before, F.max_by(close, t)).alias("change"))
    buckets = roll_up(bars, step, keys=keys).withColumn("notional", F.col("volume"))
    gate = high_volume_gate(buckets, keys=keys, times=times).where("high_volume")
    rows = moved.withColumn("time", bucket("now", step)).join(gate, [*keys, "time"])
    kind = F.when(F.col("change") >= 0, "up_high_volume").otherwise("down_high_volume")
    return rows.select(*keys, kind.alias("kind"), classify_band(F.col("change"), HIGH_VOLUME_BANDS).alias("band"), "change", "limited").where("band is not null")


def order_statuses(trades: DataFrame, *, keys: list[str] = KEYS, times: float = 50.0, lookback: int = 120 * 3600) -> DataFrame:
    """(keys, kind, band, change, limited): large_buy and large_sell among the newest prints; change is
    the quantity over the mean of the others. Limited: trades span less than nine tenths of ``lookback``."""
    span = trades.where("quantity > 0").groupBy(*keys).agg((F.max("sec") - F.min("sec")).alias("__span"))
    found = large_orders(trades.where("quantity > 0"), keys=keys, times=times).join(span, keys)
    ratio = F.col("quantity").cast("double") / F.col("mean_of_others")
    return found.select(*keys, F.concat(F.lit("large_"), F.col("aggressor")).alias("kind"), F.lit(None).cast("string").alias("band"), ratio.alias("change"), (F.col("__span") < 0.9 * lookback).alias("limited"))


def coverage_of(bars: DataFrame, *, keys: list[str] = KEYS, step: int = 900) -> DataFrame:
    """What history the statuses stand on: has_utc_day (the day's first bar within a minute of midnight),
    has_7d and has_30d (less a minute), prior_buckets (of ``step`` seconds, before the newest bar's)."""
    tip = bars.groupBy(*keys).agg(F.max("time").alias("now"), F.min("time").alias("oldest"))
    rows = bars.join(tip, keys)
    day = F.col("now") - F.pmod("now", F.lit(DAY))
    at = bucket("time", step)
    out = rows.groupBy(*keys, "now", "oldest").agg(
        F.min(F.when(F.col("time") >= day, F.col("time") - day)).alias("__first"), F.count_distinct(F.when(at < bucket("now", step), at)).alias("prior_buckets"),
    )
    span = F.col("now") - F.col("oldest")
    return out.select(*keys, (F.col("__first") <= 60).alias("has_utc_day"), (span >= 7 * DAY - 60).alias("has_7d"), (span >= 30 * DAY - 60).alias("has_30d"), "prior_buckets")
