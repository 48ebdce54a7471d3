"""Comparison of venues: price differences, activity scores, spikes and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import venue_heat
from .windows import step_hold


def discrepancy(lines: DataFrame, *, by: list[str] = ["instrument", "time"], last_on_ties: bool = False) -> DataFrame:  # noqa: B006
    """Span of venues' prices where at least two have one; basis points of the extremes' mean. Of
    venues with equal prices the first by name is named, or the last."""
    tie = F.col("venue")
    order = lambda p: F.struct(p, tie)
    if last_on_ties:
        high, low = F.max_by("venue", order(F.col("price"))), F.max_by("venue", order(-F.col("price")))
    else:
        high, low = F.min_by("venue", order(-F.col("price"))), F.min_by("venue", order(F.col("price")))
    s = lines.where("price is not null").groupBy(*by).agg(F.max("price").alias("high"), F.min("price").alias("low"), high.alias("high_venue"), low.alias("low_venue"), F.count(F.lit(1)).alias("venues")).where("venues >= 2")
    h, w = F.col("high").cast("double"), F.col("low").cast("double")
    return s.withColumns({"span": F.col("high") - F.col("low"), "bps": F.try_divide(h - w, (h + w) / 2) * 10_000})


def discrepancy_history(lines: DataFrame, step: int, *, last_on_ties: bool = False) -> DataFrame:
    """``discrepancy`` at every step, with each venue's last price held."""
    return discrepancy(step_hold(lines, ["venue", "instrument"], "price", time="time", step=step), last_on_ties=last_on_ties)


def pulse(venues: DataFrame, *, by: list[str] = ["instrument"], cross_bps: Column | None = None) -> DataFrame:  # noqa: B006
    """One row a group from (live, trades_per_min, usd_per_min, spread_bps, imbalance_percent) rows.

    Sums and medians take live venues, in which a null spread or imbalance counts as 0; mean heat is
    over all venues, those not live with 0.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    live = F.col("live")
    heat = venue_heat(live, zero("trades_per_min"), zero("usd_per_min"), zero("imbalance_percent"), zero("spread_bps"))
    s = venues.withColumn("__heat", heat).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(live, zero("trades_per_min"))), F.lit(0.0)).alias("trades_per_min"), F.coalesce(F.sum(F.when(live, zero("usd_per_min"))), F.lit(0.0)).alias("usd_per_min"),
        F.median(F.when(live, zero("spread_bps"))).alias("median_spread"), F.median(F.when(live, zero("imbalance_percent"))).alias("book_imbalance"),
        F.avg("__heat").alias("average_heat"), F.count_if(live).alias("live_venues"), *([F.max(cross_bps).alias("cross_bps")] if cross_bps is not None else []),
    )
    cross = F.least(F.lit(25.0), F.abs(F.col("cross_bps")) * 1.5) if cross_bps is not None else F.lit(0.0)
    lean = F.least(F.lit(15.0), F.abs(F.coalesce("book_imbalance", F.lit(0.0))) * 0.25)
    return s.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("average_heat") * 0.75 + F.coalesce(cross, F.lit(0.0)) + lean)))


def spikes(history: DataFrame, *, keys: list[str], value: str = "score", time: str = "time", threshold: float = 72) -> DataFrame:
    """``spike``: at least the threshold, after four points or more, and over their mean by 12 or by one
    and a half of their (population) deviations."""
    prior = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    rise = F.greatest(F.lit(12.0), 1.5 * F.stddev_pop(value).over(prior))
    hit = (F.count(F.lit(1)).over(prior) >= 4) & (F.col(value) >= threshold) & (F.col(value) >= F.avg(value).over(prior) + rise)
    return history.withColumn("spike", F.coalesce(hit, F.lit(False)))


def percent_lines(lines: DataFrame, *, keys: list[str] = ["venue", "instrument"]) -> DataFrame:  # noqa: B006
    """Percent over the first retained price of each line, which is one row a key to join."""
    first = lines.groupBy(*keys).agg(F.min_by("price", "time").alias("__first"))
    return lines.join(first, keys).withColumn("percent", F.try_divide((F.col("price") - F.col("__first")).cast("double"), F.col("__first").cast("double")) * 100).drop("__first")
