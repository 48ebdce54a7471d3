"""Downsampling, retention, throttling and averages over ordered points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import chunks, ranks


def stride(points: DataFrame, most: int, *, keys: list[str], time: str = "time") -> DataFrame:
    """At most ``most`` evenly spaced points of each key, the first and last among them. Point r of n
    stays if some i of most - 1 steps rounds (halves up) to it."""
    rows = ranks(points, keys, time, block=30 * 86_400).withColumn("__r", F.col("__rank") - 1).drop("__rank")
    step = (F.col("__n") - 1) / F.lit(most - 1)
    i = F.ceil((F.col("__r") - 0.5) / step)
    hit = F.floor(i * step + 0.5) == F.col("__r")
    return rows.where((F.col("__n") <= most) | (F.col("__r") == F.col("__n") - 1) | (F.col("__r") == 0) | hit).drop("__r", "__n")


def by_age(points: DataFrame, *, keys: list[str], time: str = "time", recent: int = 300, mid: int = 1200, steps: tuple[int, int, int] = (1, 5, 15)) -> DataFrame:
    """The last point of each bucket; buckets widen with age from the key's newest point."""
    tip = points.groupBy(*keys).agg(F.max(time).alias("__tip"))
    rows = points.join(tip, keys)
    t = F.col(time)
    tier = F.when(t >= F.col("__tip") - recent, 0).when(t >= F.col("__tip") - mid, 1).otherwise(2)
    width = F.element_at(F.array(*[F.lit(s) for s in steps]), tier + 1)
    rest = [c for c in points.columns if c not in keys]
    return rows.groupBy(*keys, tier.alias("__tier"), (t - F.pmod(t, width)).alias("__bucket")).agg(F.max_by(F.struct(*rest), t).alias("__row")).select(*keys, "__row.*")


def for_chart(points: DataFrame, window: int, *, keys: list[str], most: int = 900, time: str = "time") -> DataFrame:
    recent = min(180, max(60, window // 5))
    mid = min(window, max(recent * 2, window * 55 // 100))
    steps = (1, max(2, -(-window // most)), max(5, -(-2 * window // most)))
    return stride(by_age(points, keys=keys, time=time, recent=recent, mid=mid, steps=steps), most, keys=keys, time=time)


def retained(points: DataFrame, seconds: int, *, keys: list[str], time: str = "time") -> DataFrame:
    tip = points.groupBy(*keys).agg(F.max(time).alias("__tip"))
    return points.join(tip, keys).where(F.col(time) >= F.col("__tip") - seconds).drop("__tip")


def throttled(points: DataFrame, gap: int, *, keys: list[str], time: str = "time") -> DataFrame:
    """Points at least ``gap`` after the last one kept. Whether a point stays depends on every earlier
    decision, so each key is read in order; the state is one number, whatever the key's size."""
    names = points.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            keep = []
            for k, t in zip(batch[keys].itertuples(index=False, name=None), batch[time]):
                good = k != key or last is None or t - last >= gap
                keep.append(good)
                if good:
                    key, last = k, t
            yield batch[keep]

    return points.select(*names).repartition(*keys).sortWithinPartitions(*keys, time).mapInPandas(run, points.schema)


def alerts(points: DataFrame, threshold: float, cooldown: int, *, keys: list[str], value: str = "bps", time: str = "time") -> DataFrame:
    """Points over the threshold, at least ``cooldown`` after the last alert."""
    return throttled(points.where(F.col(value) > threshold), cooldown, keys=keys, time=time)


def moving_average(points: DataFrame, alpha: float, *, keys: list[str], value: str, time: str = "time", rows: int = 100_000, block: int = 30 * 86_400) -> DataFrame:
    """``ema``: the recursion ema += alpha (x - ema) from the first value on; nulls change nothing.

    A stretch of m values takes any average e before it to (1 - alpha)^m e + b. So a key's line is cut into
    chunks, each is summed up by its m, b and first value, averages before the chunks follow from the few
    sums, and then each chunk runs from its own. Rows of one time have no order of their own.
    """
    cut = chunks(points, keys, time, rows=rows, block=block).drop("__own")
    sums, names, given = [*keys, "__chunk"], cut.columns, points.columns
    key_kinds = ", ".join(f"`{c}` {t}" for c, t in cut.select(*sums).dtypes)

    def runs(batch: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, int, int]]:
        """(key, from, to) of neighbouring rows of one key."""
        new = (batch[by] != batch[by].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], len(batch)]):
            yield tuple(batch[by].iloc[a]), int(a), int(b)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, [0, 0.0, None]
        for batch in batches:
            out = []
            for k, a, b in runs(batch, sums):
                if k != key:
                    if key is not None:
                        out.append((*key, *held))
                    key, held = k, [0, 0.0, None]
                for x in batch[value].iloc[a:b].dropna().astype(float):
                    held = [held[0] + 1, held[1] + alpha * (x - held[1]), x if held[2] is None else held[2]]
            yield pd.DataFrame(out, columns=[*sums, "m", "b", "first"])
        if key is not None:
            yield pd.DataFrame([(*key, *held)], columns=[*sums, "m", "b", "first"])

    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ema = None, None
        for batch in batches:
            out = []
            for *k, _, m, b, first in batch[[*sums, "m", "b", "first"]].itertuples(index=False, name=None):
                if k != key:
                    key, ema = k, None
                out.append(ema)
                if m:
                    ema = (1 - alpha) ** m * (first if ema is None else ema) + b
            yield batch[sums].assign(__ema=pd.Series(out, index=batch.index, dtype=float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ema = None, None
        for batch in batches:
            out = np.full(len(batch), np.nan)
            for k, a, b in runs(batch, sums):
                if k != key:
                    key, ema = k, batch["__ema"].iloc[a]
                    ema = None if ema != ema or ema is None else ema
                for i, x in enumerate(batch[value].iloc[a:b].astype(float).tolist(), a):
                    if x == x:
                        ema = x if ema is None else ema + alpha * (x - ema)
                    out[i] = np.nan if ema is None else ema
            yield batch[given].assign(ema=pd.Series(out, index=batch.index).astype(object).where(~np.isnan(out), None))

    line = cut.select(*sums, "__rank", value).repartition(*sums).sortWithinPartitions(*sums, "__rank")
    totals = line.mapInPandas(summed, f"{key_kinds}, m long, b double, first double")
    starts = totals.repartition(*keys).sortWithinPartitions(*sums).mapInPandas(started, f"{key_kinds}, __ema double")
    both = cut.join(starts, sums).select(*names, "__ema").repartition(*sums).sortWithinPartitions(*sums, "__rank")
    return both.mapInPandas(run, points.withColumn("ema", F.lit(None).cast("double")).schema)


def indicator_pane(points: DataFrame, *, keys: list[str], value: str, window: int, step: int = 1, time: str = "time", most: int = 900) -> DataFrame:
    """A measure held between its points and thinned for a chart of ``window`` seconds."""
    from .windows import step_hold

    return for_chart(step_hold(points, keys, value, time=time, step=step), window, keys=keys, most=most, time=time)


def compacted_depth(history: DataFrame, *, keys: list[str], most: int = 1800, recent_ms: int = 60_000, mid_ms: int = 300_000) -> DataFrame:
    """Depth samples (keys, t, ...) thinned by age to the last of each 250 ms, second or five seconds, the
    newest ``most`` times of each key."""
    from .windows import top

    times = history.select(*keys, "t").distinct().withColumn("sample_t", F.col("t"))
    kept = by_age(times, keys=keys, time="t", recent=recent_ms, mid=mid_ms, steps=(250, 1000, 5000)).select(*keys, F.col("sample_t").alias("t"))
    return history.join(top(kept, keys, most, F.desc("t")), [*keys, "t"], "left_semi")
