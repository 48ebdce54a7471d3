"""Ordered operators that stay parallel inside one key.

A window over one instrument puts all its rows into one task. Here a key's time line is cut into
blocks: sums (or last values) of blocks are taken first, with a map-side combine, a window over the
few block rows gives what each block starts from, and the row window runs inside (key, block). A key
with a third of all rows is then spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], *, time: str = "sec", block: int = DAY) -> DataFrame:
    """``df`` with running sums per key in the order of (``time``, ``order``); the sums of nulls are 0."""
    at = F.floor(F.col(time) / block).cast("long")
    rows = df.withColumns({f"__x_{n}": c for n, c in sums.items()} | {"__block": at})
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "__block").agg(*[F.sum(f"__x_{n}").alias(f"__s_{n}") for n in sums])
    starts = starts.select(*keys, "__block", *[F.sum(f"__s_{n}").over(before).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__block").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({n: F.sum(f"__x_{n}").over(inside) for n in sums})
    out = rows.join(starts, [*keys, "__block"])
    return out.select(*df.columns, *[(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"__b_{n}"), F.lit(0))).alias(n) for n in sums])


def following(df: DataFrame, keys: list[str], order: list[str], values: list[str], *, time: str = "sec", block: int = DAY) -> DataFrame:
    """``df`` with ``next_<value>`` of the row after each one in the order of (``time``, ``order``): that
    of its block, or the first row of the key's next block. Null behind a key's last row."""
    rows = df.withColumn("__block", F.floor(F.col(time) / block).cast("long"))
    held = F.struct(*[F.col(v).alias(v) for v in values])
    firsts = rows.groupBy(*keys, "__block").agg(F.min_by(held, F.struct(time, *order)).alias("__first"))
    after = firsts.select(*keys, "__block", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__block")).alias("__after"))
    rows = rows.withColumn("__next", F.lead(held).over(Window.partitionBy(*keys, "__block").orderBy(time, *order)))
    out = rows.join(after, [*keys, "__block"]).withColumn("__next", F.coalesce("__next", "__after"))
    return out.select(*df.columns, *[F.col(f"__next.{v}").alias(f"next_{v}") for v in values])


def ranks(df: DataFrame, keys: list[str], order: str, *, block: int = 100_000, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with ``__rank`` (from 1) in the order of a number, then of the ties, and the key's row count ``__n``."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return running_sums(df, keys, ties, {"__rank": F.lit(1)}, time=order, block=block).join(totals, keys)


def running_last(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], *, time: str = "sec", block: int = DAY, before: bool = False) -> DataFrame:
    """``df`` with the last value that isn't null of each column, of the rows up to each one (``before``: up to the
    row before it) in the order of (``time``, ``order``). A block begins with the last values before it."""
    rows = df.withColumns({f"__x_{n}": c for n, c in values.items()} | {"__block": F.floor(F.col(time) / block).cast("long")})
    place = F.struct(time, *order)
    ends = rows.groupBy(*keys, "__block").agg(*[F.max_by(f"__x_{n}", F.when(F.col(f"__x_{n}").isNotNull(), place)).alias(f"__e_{n}") for n in values])
    line = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "__block", *[F.last(f"__e_{n}", ignorenulls=True).over(line).alias(f"__b_{n}") for n in values])
    inside = Window.partitionBy(*keys, "__block").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    rows = rows.withColumns({n: F.last(f"__x_{n}", ignorenulls=True).over(inside) for n in values}).join(starts, [*keys, "__block"])
    return rows.select(*df.columns, *[F.coalesce(n, f"__b_{n}").alias(n) for n in values])


def chunks(df: DataFrame, keys: list[str], order: str, *, rows: int, halo: int = 0, block: int = 100_000, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` cut to chunks of so many rows of a key each, in order: ``__rank``, ``__chunk``, and ``__own``, which is
    false for the ``halo`` rows that a chunk has from the end of the one before it."""
    ranked = ranks(df, keys, order, block=block, ties=ties).drop("__n")
    place = F.col("__rank") - 1
    chunk = F.floor(place / rows).cast("long")
    both = F.when(place % rows >= rows - halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)) if halo else F.array(chunk)
    return ranked.withColumn("__chunk", F.explode(both)).withColumn("__own", F.col("__chunk") == chunk)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], *, time: str = "sec", tie: str | None = None, block: int = DAY) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of its key at or before its time (the
    largest ``tie`` of equal times). Null where there is none. No side is broadcast and no pairs are
    made: both sides share one sort a (key, block), and a block starts from the last row before it.
    """
    at = F.floor(F.col(time) / block).cast("long")
    held = F.struct(*[F.col(v).alias(v) for v in values])
    second = F.col(tie) if tie else F.lit(0)
    r = right.select(*keys, F.col(time).alias("__t"), second.alias("__tie"), held.alias("__held"), at.alias("__block"), F.lit(0).alias("__side"))
    ends = r.groupBy(*keys, "__block").agg(F.max_by("__held", F.struct("__t", "__tie")).alias("__end"))
    own = F.struct(*[F.col(c) for c in left.columns])
    rows = left.select(*keys, F.col(time).alias("__t"), F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie"), at.alias("__block"), F.lit(1).alias("__side"), own.alias("__own"))
    need = rows.select(*keys, "__block").distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))
    line = ends.unionByName(need).groupBy(*keys, "__block").agg(F.first("__end", ignorenulls=True).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    line = line.select(*keys, "__block", F.last("__end", ignorenulls=True).over(before).alias("__start"))
    both = r.unionByName(rows, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__block").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__last", F.last("__held", ignorenulls=True).over(inside)).where("__side = 1")
    out = both.join(line, [*keys, "__block"], "left").withColumn("__got", F.coalesce("__last", "__start"))
    return out.select("__own.*", *[F.col(f"__got.{v}").alias(v) for v in values])


def top(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each key. Spark cuts to n rows a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def step_hold(points: DataFrame, keys: list[str], value: str, *, time: str = "sec", step: int = 1, block: int = DAY) -> DataFrame:
    """One row a step from a key's first to its last time, with the value held from the last point:
    each point is repeated up to the next one, so there is no grid to join."""
    rows = following(points.select(*keys, time, value), keys, [], [time], time=time, block=block)
    held = rows.withColumn("__to", F.coalesce(F.col(f"next_{time}") - step, F.col(time))).where(F.col("__to") >= F.col(time))
    return held.select(*keys, F.explode(F.sequence(F.col(time), F.col("__to"), F.lit(step))).alias(time), value)
