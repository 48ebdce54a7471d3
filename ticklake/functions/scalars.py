"""Column expressions of the market-data vocabulary. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def notional(price: Column | str = "price", quantity: Column | str = "quantity", given: Column | None = None) -> Column:
    """Price times quantity unless the venue states it; null on decimal overflow."""
    product = F.try_multiply(col(price), col(quantity))
    return product if given is None else F.coalesce(given, product)


def aggressor_sign(aggressor: Column | str = "aggressor") -> Column:
    a = col(aggressor)
    return F.when(a == "buy", 1).when(a == "sell", -1).otherwise(0)


def buy_share(policy: str, aggressor: Column | str = "aggressor") -> Column:
    """Share of a trade that counts as bought. A trade of unknown side is for neither (``ignore``),
    half for each (``half``) or sold (``sell``)."""
    unknown = {"ignore": 0, "half": 0.5, "sell": 0}[policy]
    return F.when(col(aggressor) == "buy", 1).when(col(aggressor) == "sell", 0).otherwise(unknown).cast("decimal(2,1)")


def sell_share(policy: str, aggressor: Column | str = "aggressor") -> Column:
    unknown = {"ignore": 0, "half": 0.5, "sell": 1}[policy]
    return F.when(col(aggressor) == "sell", 1).when(col(aggressor) == "buy", 0).otherwise(unknown).cast("decimal(2,1)")


def event_ns() -> Column:
    """Exchange time if there is one, else receive time."""
    return F.coalesce("exchange_ts_ns", "receive_ts_ns")


def ns_to_sec(ns: Column | str) -> Column:
    return F.floor(col(ns) / F.lit(NS).cast("decimal(19,0)")).cast("long")


def bucket(sec: Column | str, step: int) -> Column:
    s = col(sec)
    return s - F.pmod(s, F.lit(step))


def quantize(price: Column | str, tick: float | str | Column) -> Column:
    """Nearest tick, halves up. Decimal arithmetic, so ticks under one need no rounding after."""
    t = tick if isinstance(tick, Column) else F.lit(str(tick)).cast("decimal(18,9)")
    return (F.floor(col(price) / t + F.lit("0.5").cast("decimal(2,1)")) * t).cast("decimal(18,9)")


def percent_change(before: Column, after: Column) -> Column:
    """Null where ``before`` is 0 or null."""
    return F.when(before != 0, (after - before) / before * 100)


def imbalance_percent(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask) in percent; 0 for an empty book."""
    return F.coalesce(F.when(bid + ask != 0, (bid - ask) / (bid + ask) * 100), F.lit(0.0))


def spread_bps(bid: Column, ask: Column) -> Column:
    """Null if a side is missing, the bid isn't positive, or the book is crossed."""
    return F.when((bid > 0) & (ask >= bid), (ask - bid) / ((ask + bid) / 2) * 10_000)


#: Saturation constants and weights of the activity heat (fixed values).
HEAT_TRADES, HEAT_USD = 40.0, 250_000.0
HEAT_WEIGHTS = (0.4, 0.35, 0.15, 0.1)


def venue_heat(live: Column, trades_per_min: Column, usd_per_min: Column, imbalance: Column, spread: Column | None) -> Column:
    """0 to 100 from trade rate, turnover, book imbalance and spread; 0 for a venue that isn't live."""
    rate = 100 * (1 - F.exp(-F.coalesce(trades_per_min, F.lit(0.0)) / HEAT_TRADES))
    usd = 100 * (1 - F.exp(-F.coalesce(usd_per_min, F.lit(0.0)) / HEAT_USD))
    lean = F.least(F.lit(100.0), F.abs(F.coalesce(imbalance, F.lit(0.0))) * 1.2)
    tight = F.coalesce(F.greatest(F.lit(0.0), 100 - spread * 8), F.lit(50.0)) if spread is not None else F.lit(50.0)
    a, b, c, d = HEAT_WEIGHTS
    return F.when(live, F.greatest(F.lit(0.0), F.least(F.lit(100.0), a * rate + b * usd + c * lean + d * tight))).otherwise(0.0)


def clamp(x: Column, low: float, high: float, fallback: float) -> Column:
    return F.least(F.greatest(F.coalesce(F.when(F.isnan(x.cast("double")), None).otherwise(x), F.lit(fallback)), F.lit(low)), F.lit(high))


def utc_day_bounds(sec: Column) -> Column:
    start = bucket(sec, 86_400)
    return F.struct(start.alias("start"), (start + 86_399).alias("end"))


#: Bands of absolute change in percent: name, least (inclusive), limit (exclusive) (fixed values).
BANDS = (("small", 3, 7), ("mid", 7, 11), ("high", 11, None))
HIGH_VOLUME_BANDS = (("small", 7, 11), ("mid", 11, 15), ("high", 15, None))


def classify_band(change: Column, bands=BANDS) -> Column:
    out = None
    for name, low, high in bands:
        hit = F.abs(change) >= low
        hit = hit if high is None else hit & (F.abs(change) < high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def has_flag(flags: Column | str, bits: int) -> Column:
    """Whether all of ``bits`` are set."""
    return col(flags).bitwiseAND(F.lit(bits)) == bits


def clock_jump(prev_wall: Column, wall: Column, prev_mono: Column, mono: Column, threshold_ns: int = NS) -> Column:
    """Wall-clock time passed beyond monotonic time passed, if it is at least the threshold."""
    delta = (wall - prev_wall) - (mono - prev_mono)
    return F.when(F.abs(delta) >= threshold_ns, delta)
