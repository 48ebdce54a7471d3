"""Operators over ordered state, cut into blocks, against plain loops over each key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ticklake.operators import bars, health, sampling, windows


@pytest.fixture(scope="module")
def line(spark):
    """Two keys with distinct, uneven times; one holds most rows. Some values and flags are null."""
    rnd = random.Random(9)
    rows, t = [], 0
    for _ in range(900):
        t += rnd.choice([1, 2, 3, 40, 400])
        rows.append(("hot" if rnd.random() < 0.8 else "cold", t, rnd.choice([None, rnd.random() * 10]), rnd.choice([True, True, False, None])))
    return spark.createDataFrame(rows, "k string, time long, x double, raw boolean").repartition(6).cache()


def by_key(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.time)):
        out.setdefault(r.k, []).append(r)
    return out


@pytest.mark.parametrize("rows", [1, 2, 7, 5000])
def test_moving_average_in_chunks(line, rows):
    got = by_key(sampling.moving_average(line, 0.3, keys=["k"], value="x", rows=rows, block=500))
    for k, given in by_key(line).items():
        ema = None
        for r, g in zip(given, got[k], strict=True):
            ema = ema if r.x is None else r.x if ema is None else ema + 0.3 * (r.x - ema)
            assert (g.time, g.x) == (r.time, r.x) and (g.ema is None if ema is None else abs(g.ema - ema) < 1e-9)
    assert sampling.moving_average(line.where("false"), 0.3, keys=["k"], value="x").count() == 0


def test_one_key_is_many_tasks(spark):
    points = spark.range(40_000).select(F.lit("k").alias("k"), F.col("id").alias("time"), (F.col("id") % 7).cast("double").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = sampling.moving_average(points, 0.1, keys=["k"], value="x", rows=1000, block=3000)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) < 15_000


@pytest.mark.parametrize(("block", "initial"), [(100, None), (1500, False), (1500, True), (10**9, None)])
def test_steadied_in_blocks(line, block, initial):
    got = by_key(health.steadied(line, keys=["k"], time="time", hold=(60, 500), initial=initial, block=block))
    for k, given in by_key(line).items():
        shown, since = initial, None
        for r, g in zip(given, got[k], strict=True):
            raw = bool(r.raw)
            if shown is None:
                shown = raw
            if raw == shown:
                since = None
            else:
                since = r.time if since is None else since
                if r.time - since >= (60 if raw else 500):
                    shown, since = raw, None
            assert g.shown == shown, (k, r.time)


def test_steadied_badges(spark):
    rows = [("a", t, ["slow"] if 10 <= t < 60 else ["slow", "gap"] if t >= 60 else []) for t in range(0, 120, 5)]
    got = {(r.time_ms, r.badge) for r in health.steadied_badges(spark.createDataFrame(rows, "k string, time_ms long, badges array<string>"), keys=["k"], hold=(20, 10)).collect()}
    assert got == {(t, "slow") for t in range(30, 120, 5)} | {(t, "gap") for t in range(80, 120, 5)}


@pytest.mark.parametrize(("rows", "chunk"), [(5, 5), (5, 7), (24, 30), (24, 10**6)])
def test_gate_in_chunks(line, rows, chunk):
    given = line.select("k", "time", F.coalesce("x", F.lit(0.0)).alias("notional"))
    got = by_key(bars.high_volume_gate(given, keys=["k"], rows=rows, times=1.5, chunk=chunk))
    for k, bar in by_key(given).items():
        for i, (r, g) in enumerate(zip(bar, got[k], strict=True)):
            prior = [b.notional for b in bar[max(0, i - rows) : i]]
            mean = sum(prior) / len(prior) if prior else None
            assert g.prior_bars == len(prior) and g.limited == (len(prior) < rows)
            assert g.prior_mean == pytest.approx(mean) and g.high_volume == bool(mean and mean > 0 and r.notional >= mean * 1.5)


@pytest.mark.parametrize("block", [50, 1000, 10**9])
def test_held_and_last_values_in_blocks(line, block):
    held = by_key(windows.step_hold(line, ["k"], "x", time="time", step=1, block=block))
    last = by_key(windows.running_last(line, ["k"], [], {"now": F.col("x")}, time="time", block=block))
    prior = by_key(windows.running_last(line, ["k"], [], {"was": F.col("x")}, time="time", block=block, before=True))
    for k, given in by_key(line).items():
        x, at = None, {}
        for r, g, h in zip(given, last[k], prior[k], strict=True):
            assert h.was == x
            x = r.x if r.x is not None else x
            assert g.now == x
            at[r.time] = r.x
        want, value = [], None
        for t in range(given[0].time, given[-1].time + 1):
            value = at.get(t, value) if t in at else value
            want.append((t, value))
        assert [(r.time, r.x) for r in held[k]] == want


def test_chunks_have_even_sizes(line):
    cut = windows.chunks(line, ["k"], "time", rows=50, halo=8, block=700)
    sizes = cut.groupBy("k", "__chunk").agg(F.count_if("__own").alias("own"), F.count_if(~F.col("__own")).alias("halo")).collect()
    last = {k: max(r["__chunk"] for r in sizes if r.k == k) for k in ("hot", "cold")}
    for r in sizes:
        assert r.halo == (8 if r["__chunk"] else 0) and (r.own == 50 or r["__chunk"] >= last[r.k] - 1)
