"""Continuity, freshness, deduplication, queue models and counters of event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket, clock_jump
from .windows import following, ranks


def sequence_gaps(rows: DataFrame, *, keys: list[str] = ["session"], seq: str = "seq", block: int = 100_000) -> DataFrame:  # noqa: B006
    """Missing runs of update numbers: (keys, after, next, missing). Numbers are compared inside blocks
    of the number line, and blocks by their ends, so one long session is many tasks."""
    at = F.floor(F.col(seq) / block).cast("long")
    own = rows.select(*keys, F.col(seq).alias("__s"), at.alias("__b"))
    inside = own.withColumn("after", F.lag("__s").over(Window.partitionBy(*keys, "__b").orderBy("__s"))).select(*keys, "after", F.col("__s").alias("next"))
    ends = own.groupBy(*keys, "__b").agg(F.min("__s").alias("next"), F.max("__s").alias("__last"))
    between = ends.withColumn("after", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b"))).select(*keys, "after", "next")
    return inside.unionByName(between).where("next > after + 1").withColumn("missing", F.col("next") - F.col("after") - 1)


def first_of(rows: DataFrame, same: list[str], *order: Column | str) -> DataFrame:
    """One row of each set of equal keys, the first by ``order``; a map-side minimum, no sort."""
    rest = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(c).alias(f"__{c}") for c in same]).agg(F.min_by(rest, F.struct(*order)).alias("__row")).select("__row.*")


def last_of(rows: DataFrame, same: list[str], *order: Column | str) -> DataFrame:
    rest = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(c).alias(f"__{c}") for c in same]).agg(F.max_by(rest, F.struct(*order)).alias("__row")).select("__row.*")


def distinct_trades(trades: DataFrame, *, by_content: bool = False) -> DataFrame:
    """First of each (venue, trade_id). Trades without an id all stay, or with ``by_content`` one of
    each (venue, price, quantity, time)."""
    known = first_of(trades.where("trade_id is not null"), ["venue", "trade_id"], "exchange_ts_ns", "event_id")
    rest = trades.where("trade_id is null")
    if by_content:
        rest = first_of(rest, ["venue", "price", "quantity", "exchange_ts_ns"], "event_id")
    return known.unionByName(rest)


def rate_capped(rows: DataFrame, most: int, *, keys: list[str], time: str = "sec", order: str = "event_id") -> DataFrame:
    """The first ``most`` rows of each key and second: the feature is the cap."""
    w = Window.partitionBy(*keys, time).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def newest_merged(tape: DataFrame, limit: int, *, keys: list[str]) -> DataFrame:
    """The newest trades and quotes of each key, trades first at equal times."""
    w = Window.partitionBy(*keys).orderBy(F.desc("exchange_ts_ns"), F.when(F.col("kind") == "trade", 0).otherwise(1), F.desc("event_id"))
    return tape.withColumn("row", F.row_number().over(w)).where(F.col("row") <= max(1, min(limit, 500)))


def queue_outcome(arrivals: DataFrame, capacity: int, policy: str, *, keys: list[str], order: str = "event_id") -> DataFrame:
    """Which arrivals a queue of ``capacity`` keeps until it is drained: drop_newest keeps the first,
    drop_oldest the last, fail none of a queue that overflows."""
    rows = ranks(arrivals, keys, order)
    rank, n = F.col("__rank"), F.col("__n")
    kept = {"drop_newest": rank <= capacity, "drop_oldest": rank > n - capacity, "fail": n <= capacity}[policy]
    return rows.withColumn("queued", kept).drop("__rank", "__n")


def venue_status(tape: DataFrame, *, now_ns: Column, by: list[str] = ["venue"]) -> DataFrame:  # noqa: B006
    """Newest times and feed lag."""
    newest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("exchange_ts_ns")))
    s = tape.groupBy(*by).agg(F.max("exchange_ts_ns").alias("last_event_ns"), newest("trade").alias("last_trade_ns"), newest("quote").alias("last_quote_ns"), F.count_if(F.col("kind") == "trade").alias("trades"), F.count_if(F.col("kind") == "quote").alias("quotes"))
    return s.withColumn("lag_ms", F.floor((now_ns - F.col("last_event_ns")) / 1_000_000))


def market_quality(status: DataFrame, *, stale_s: int = 8, lag_ms: int = 3000) -> DataFrame:
    """Badges of rows with age_s, lag_ms, has_book, trades and quotes."""
    flags = F.array(
        F.when(F.col("age_s") > stale_s, "stale"), F.when(F.col("lag_ms") > lag_ms, "lag"), F.when(~F.col("has_book"), "no-l2"), F.when((F.col("trades") == 0) & (F.col("quotes") > 0), "quotes-only")
    )
    return status.withColumn("badges", F.array_compact(flags))


def clock_jumps(frames: DataFrame, *, keys: list[str] = ["session"], threshold_ns: int = 1_000_000_000, block: int = 100_000) -> DataFrame:  # noqa: B006
    """Frames whose wall clock ran off since the frame before; sessions are read in blocks of frame numbers."""
    names = frames.columns
    pairs = following(frames, keys, [], names, time="frame_seq", block=block).where("next_frame_seq is not null")
    jump = clock_jump(F.col("receive_ts_ns"), F.col("next_receive_ts_ns"), F.col("monotonic_ns"), F.col("next_monotonic_ns"), threshold_ns)
    return pairs.select(*[F.col(f"next_{c}").alias(c) for c in names], jump.alias("jump_ns")).where("jump_ns is not null")


def histogram(rows: DataFrame, value: str, bounds: list[float], *, keys: list[str]) -> DataFrame:
    """Cumulative counts by upper bound, the last one infinite; counts of several inputs can be added. One
    aggregation; its row a key is then laid out by bound."""
    v = F.col(value).cast("double")
    every = [*map(float, bounds), float("inf")]
    sums = rows.groupBy(*keys).agg(*[F.count_if(v <= b).alias(f"__{k}") for k, b in enumerate(every)])
    cells = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"__{k}").alias("cumulative")) for k, b in enumerate(every)])
    return sums.select(*keys, F.explode(cells).alias("__cell")).select(*keys, "__cell.*")


def coverage(catalog: DataFrame, *, by: str = "symbol") -> DataFrame:
    return catalog.groupBy(by).agg(F.countDistinct("venue").alias("venues"), F.countDistinct(F.when(F.col("live"), F.col("venue"))).alias("live_venues"), F.array_join(F.array_sort(F.collect_set("venue")), ",").alias("names"))


def event_rates(events: DataFrame, minutes: int = 5, *, by: list[str] = ["venue"]) -> DataFrame:  # noqa: B006
    return events.groupBy(*by, bucket("sec", minutes * 60).alias("time")).agg((F.count(F.lit(1)) / (minutes * 60)).alias("per_second"))
