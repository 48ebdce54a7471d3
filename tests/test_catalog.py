"""Every registered query equals its SQL."""

from __future__ import annotations

import math

import pytest

from ticklake.plans import catalog


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, oracle, rows_of):
    got = rows_of(catalog.queries()[name](spark, sf_dir))
    assert got
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    want = oracle(sql, sf_dir)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not bad, bad[:3]
