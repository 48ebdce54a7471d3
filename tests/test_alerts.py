"""Alert rules against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ticklake.operators import alerts


@pytest.fixture(scope="module")
def samples(spark):
    rnd = random.Random(8)
    rows, value = [], {"a": 0, "b": 0}
    for sec in range(0, 6000, 10):
        for name in "ab":
            if rnd.random() < 0.85:
                value[name] = 0 if rnd.random() < 0.02 else value[name] + rnd.choice([0, 0, 0, 1, 8])
                rows.append((name, "venue_reconnects_total", sec, value[name]))
    return spark.createDataFrame(rows, "id string, name string, sec long, value long").repartition(5).cache()


def plain(samples, step, window, over, hold):
    """Evaluation by evaluation: (id, time) to (rate, state)."""
    out = {}
    for name in "ab":
        line = sorted((r.sec, r.value) for r in samples.collect() if r.id == name)
        grown = [(t, 0 if k == 0 else v if v < line[k - 1][1] else v - line[k - 1][1]) for k, (t, v) in enumerate(line)]
        since = None
        for time in range(0, 7000, step):
            met = [x for t, x in grown if time - window < t <= time]
            if not met:
                since = None
                continue
            rate = sum(met) / window
            since = (time if since is None else since) if rate > over else None
            out[name, time] = rate, "inactive" if since is None else "firing" if time - since >= hold else "pending"
    return out


def test_counter_alerts(samples):
    name, over, hold, severity = alerts.COUNTER_RULES["reconnect_storm"]
    got = alerts.counter_alerts(samples).where("alert = 'reconnect_storm'").collect()
    want = plain(samples, 30, 300, over, hold)
    assert {(r.id, r.time): (pytest.approx(r.per_second), r.state) for r in got} == want and {r.severity for r in got} == {severity}
    assert {s for _, s in want.values()} == {"inactive", "pending", "firing"}
    assert alerts.counter_alerts(samples.where("false")).count() == 0


def test_blocks_and_missing_evaluations(samples):
    thin = samples.where("sec < 2000 or sec > 3500")
    want = plain(thin, 60, 120, 0.1, 240)
    for block in (100, 10**6):
        rate = alerts.rates(alerts.increases(thin, keys=["id"], block=block), keys=["id"], window=120, step=60)
        got = alerts.states(rate, F.col("per_second") > 0.1, 240, keys=["id"], step=60, block=block).collect()
        assert {(r.id, r.time): (pytest.approx(r.per_second), r.state) for r in got} == want
    with pytest.raises(ValueError):
        alerts.rates(thin, keys=["id"], window=100, step=60)


def test_several_series_of_a_venue_are_summed(spark):
    rows = [("v", "venue_events_dropped_total", s, t, t // 100) for s in ("x", "y") for t in range(0, 600, 10)]
    got = alerts.counter_alerts(spark.createDataFrame(rows, "id string, name string, series string, sec long, value long")).where("alert = 'events_dropped' and time = 570").collect()
    assert [(r.per_second, r.state, r.severity) for r in got] == [(pytest.approx(6 / 300), "firing", "critical")]


def test_gauge_alerts(spark):
    rows = [(t, 1, 0 if 100 <= t < 400 else 1, 1 if t >= 500 else 0) for t in range(0, 600, 10)]
    got = {(r.alert, r.time): r.state for r in alerts.gauge_alerts(spark.createDataFrame(rows, "sec long, up int, ready int, disk_pressure int")).collect()}
    assert [got["not_ready", t] for t in (90, 120, 210, 240, 390, 420)] == ["inactive", "pending", "pending", "firing", "firing", "inactive"]
    assert [got["disk_pressure", t] for t in (480, 510, 540, 570)] == ["inactive", "pending", "pending", "firing"]
