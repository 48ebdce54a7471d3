"""Alert rules over samples of counters and gauges: rates over sliding windows, and holds before they fire.

Everything is taken in blocks of a series' line, so a series with most of the samples is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import running_last

#: The rules (fixed values): what is measured, over which it must be, how long (s), and how bad it is.
WINDOW = 300
COUNTER_RULES = {
    "reconnect_storm": ("venue_reconnects_total", 0.2, 300, "warning"),
    "events_dropped": ("venue_events_dropped_total", 0.0, 120, "critical"),
    "book_invalidations": ("venue_book_invalidations_total", 0.0, 300, "warning"),
}
GAUGE_RULES = {"not_ready": (120, "warning"), "disk_pressure": (60, "critical")}


def increases(samples: DataFrame, *, keys: list[str], value: str = "value", time: str = "sec", order: list[str] = [], block: int = 86_400) -> DataFrame:  # noqa: B006
    """``samples`` with ``increase`` since the sample before: a counter that falls has started again from 0. A
    series' first sample adds nothing; nulls are no samples."""
    rows = running_last(samples.where(F.col(value).isNotNull()), keys, order, {"__before": F.col(value)}, time=time, block=block, before=True)
    v, before = F.col(value), F.col("__before")
    return rows.withColumn("increase", F.when(before.isNull(), F.lit(0)).when(v < before, v).otherwise(v - before)).drop("__before")


def rates(counted: DataFrame, *, keys: list[str], window: int = WINDOW, step: int = 30, time: str = "sec") -> DataFrame:
    """``per_second`` at each multiple of ``step`` with samples in the ``window`` up to it: the increases of these samples
    by the window's length. Samples are summed by step first; a sum then goes to each window it lies in."""
    if window % step:
        raise ValueError("a window must be whole steps")
    at = (F.ceil(F.col(time) / step) * step).cast("long")
    sums = counted.groupBy(*keys, at.alias("at")).agg(F.sum("increase").alias("increase"))
    every = F.explode(F.sequence(F.col("at"), F.col("at") + window - step, F.lit(step).cast("long")))
    return sums.select(*keys, "increase", every.alias("time")).groupBy(*keys, "time").agg((F.sum("increase") / window).alias("per_second"))


def states(evaluated: DataFrame, condition: Column, hold: int, *, keys: list[str], step: int = 30, time: str = "time", block: int = 86_400) -> DataFrame:
    """``state`` of each evaluation: inactive, pending once the condition holds, firing once it has for ``hold``
    seconds. An evaluation that is missing, like one that doesn't hold, starts it anew. ``since``: when it began to."""
    on = F.coalesce(condition, F.lit(False))
    rows = running_last(evaluated.withColumn("__on", on), keys, [], {"__prior": F.struct("__on", time)}, time=time, block=block, before=True)
    goes_on = F.coalesce(F.col("__prior.__on") & (F.col(time) - F.col(f"__prior.{time}") <= step), F.lit(False))
    rows = running_last(rows, keys, [], {"__since": F.when(F.col("__on") & ~goes_on, F.col(time))}, time=time, block=block)
    since = F.when(F.col("__on"), F.col("__since"))
    state = F.when(~F.col("__on"), "inactive").when(F.col(time) - since >= hold, "firing").otherwise("pending")
    return rows.withColumns({"since": since, "state": state}).drop("__on", "__prior", "__since")


def counter_alerts(samples: DataFrame, *, step: int = 30, window: int = WINDOW) -> DataFrame:
    """``alert``, ``severity``, ``id``, ``time``, ``per_second``, ``since``, ``state`` of the counter rules; ``samples``: id, name
    (of the counter), sec, value. A venue's series are summed where it has several (``series``)."""
    keys = ["id", "name", *[c for c in ("series",) if c in samples.columns]]
    rate = rates(increases(samples, keys=keys), keys=keys, window=window, step=step).groupBy("id", "name", "time").agg(F.sum("per_second").alias("per_second"))
    out = None
    for alert, (name, over, hold, severity) in COUNTER_RULES.items():
        rows = states(rate.where(F.col("name") == name), F.col("per_second") > over, hold, keys=["id"], step=step)
        rows = rows.select(F.lit(alert).alias("alert"), F.lit(severity).alias("severity"), "id", "time", "per_second", "since", "state")
        out = rows if out is None else out.unionByName(rows)
    return out


def gauge_alerts(samples: DataFrame, *, step: int = 30) -> DataFrame:
    """``alert``, ``severity``, ``time``, ``since``, ``state`` of the process's rules; ``samples``: sec, up, ready and disk_pressure (0 or
    1), of which the last of each step counts."""
    at = (F.ceil(F.col("sec") / step) * step).cast("long")
    last = samples.groupBy(at.alias("time")).agg(F.max_by(F.struct("up", "ready", "disk_pressure"), "sec").alias("x")).select("time", "x.*", F.lit("process").alias("id"))
    conditions = {"not_ready": (F.col("up") == 1) & (F.col("ready") == 0), "disk_pressure": F.col("disk_pressure") == 1}
    out = None
    for alert, (hold, severity) in GAUGE_RULES.items():
        rows = states(last, conditions[alert], hold, keys=["id"], step=step)
        rows = rows.select(F.lit(alert).alias("alert"), F.lit(severity).alias("severity"), "time", "since", "state")
        out = rows if out is None else out.unionByName(rows)
    return out
