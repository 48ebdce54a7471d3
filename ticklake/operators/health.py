"""Health of venues: counters from system events, readiness, and flags that don't flicker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import running_last

#: Holds in milliseconds before a flag turns on and off (fixed values).
LIVE_HOLD, BADGE_HOLD = (1200, 3500), (4000, 6000)


def counters(events: DataFrame, *, by: list[str] = ["venue"]) -> DataFrame:  # noqa: B006
    """Counts of system events (kind, count, session, instrument, seq) by kind, and ``valid_books``: the
    instruments whose last book event in some session is a valid one."""
    n = F.coalesce("count", F.lit(1))
    of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    out = events.groupBy(*by).agg(
        of("sequence_gap").alias("gaps"), of("checksum_mismatch").alias("checksum_mismatches"), of("book_invalidated").alias("invalidations"), of("resync_started").alias("resyncs"),
        F.sum(F.when(F.col("kind") == "dropped", n).otherwise(0)).alias("drops"), of("parse_failure").alias("parse_failures"),
    )
    books = events.where(F.col("kind").isin("book_valid", "book_invalidated")).groupBy(*by, "session", "instrument").agg(F.max_by("kind", "seq").alias("last"))
    valid = books.where("last = 'book_valid'").groupBy(*by).agg(F.count_distinct("instrument").alias("valid_books"))
    return out.join(valid, by, "left").withColumn("valid_books", F.coalesce("valid_books", F.lit(0)))


def rolled_up(metrics: DataFrame, *, sums: list[str], gauges: list[str]) -> DataFrame:
    """One row over all venues: counters added, gauges at their highest."""
    return metrics.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.max(c).alias(c) for c in gauges])


def drops_by_reason(events: DataFrame) -> DataFrame:
    return events.where("kind = 'dropped'").groupBy(F.col("detail").alias("reason")).agg(F.sum(F.coalesce("count", F.lit(1))).alias("dropped"))


def venue_health(status: DataFrame) -> DataFrame:
    """``bad``: more than two gaps or invalidations, or a lag over four seconds; lag in steps of 50 ms."""
    lag = F.col("lag_ms")
    bad = (F.coalesce("gaps", F.lit(0)) > 2) | (F.coalesce("invalidations", F.lit(0)) > 2) | F.coalesce(lag > 4000, F.lit(False))
    return status.withColumns({"bad": bad, "lag_step_ms": (F.floor(lag / 50 + 0.5) * 50).cast("long")})


def readiness(venues: DataFrame, *, process_live: Column, recording_healthy: Column, least_sessions: int = 1) -> DataFrame:
    """One row from (venue, required, live, sessions): ready if the process runs, required venues are
    live, enough sessions are, and the recording is healthy."""
    required = F.coalesce(F.bool_and(~F.col("required") | F.coalesce("live", F.lit(False))), F.lit(True))
    s = venues.agg(required.alias("required_live"), F.coalesce(F.sum(F.when(F.col("live"), F.col("sessions"))), F.lit(0)).alias("live_sessions"))
    return s.withColumn("ready", process_live & recording_healthy & F.col("required_live") & (F.col("live_sessions") >= least_sessions))


def steadied(samples: DataFrame, *, keys: list[str], flag: str = "raw", time: str = "time_ms", hold: tuple[int, int] = LIVE_HOLD, initial: bool | None = None, tie: str | None = None, block: int = 86_400_000) -> DataFrame:
    """``samples`` with ``shown``: the flag after holds. It turns once samples have disagreed with it for
    the hold of the new value; a sample that agrees cancels that. It starts as the first sample, or as
    ``initial``. Nulls are false; ``tie`` orders samples of one time.

    In a run of equal samples the shown flag can only become the run's value, at the first sample that is
    its hold behind the run's start. So it is the value of the last run that lasted its hold: three last
    values over blocks of a key's line (the flag before, the run's start, the last sure value).
    """
    order = [tie] * (tie is not None)
    last = lambda df, before=False, **values: running_last(df, keys, order, values, time=time, block=block, before=before)
    rows = samples.withColumn("__raw", F.coalesce(F.col(flag), F.lit(False)))
    rows = last(rows, before=True, __prior=F.col("__raw"))
    rows = last(rows, __start=F.when(~F.col("__raw").eqNullSafe(F.col("__prior")), F.col(time)))
    held = F.col(time) - F.col("__start") >= F.when(F.col("__raw"), hold[0]).otherwise(hold[1])
    first = F.col("__prior").isNull() if initial is None else F.lit(False)
    rows = last(rows, __sure=F.when(held | first, F.col("__raw")))
    return rows.withColumn("shown", F.coalesce("__sure", F.lit(bool(initial)))).drop("__raw", "__prior", "__start", "__sure")


def steadied_badges(samples: DataFrame, *, keys: list[str], time: str = "time_ms", hold: tuple[int, int] = BADGE_HOLD) -> DataFrame:
    """(keys, time, badge) rows of badges shown: ``samples`` have the badges of each time as an array. A
    badge is a flag of its own that starts off."""
    every = samples.select(*keys, F.explode("badges").alias("badge")).distinct()
    rows = samples.join(every, keys).withColumn("raw", F.array_contains("badges", F.col("badge")))
    return steadied(rows, keys=[*keys, "badge"], time=time, hold=hold, initial=False).where("shown").select(*keys, time, "badge")
