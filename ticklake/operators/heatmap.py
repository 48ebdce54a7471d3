"""Depth over time: price windows, walls, resting columns, gap filling, and the heat-map grid.

Depth samples are long: (keys, t in milliseconds, side, price, usd), mids (keys, t, mid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import as_of, following, top

BOOK = ["book_id"]


def intensity(value: Column, most: Column, gain: float = 1.0) -> Column:
    """0 to 1 by the logarithm of the value's share, with a floor of 0.12; 0 for nothing."""
    shaped = F.pow(F.log1p(value) / F.log1p(most), F.lit(1 / max(0.35, gain)))
    return F.when((value > 0) & (most > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.12 + shaped * 0.88))).otherwise(0.0)


def resting_column(sample: DataFrame, mids: DataFrame, *, keys: list[str] = BOOK, most: int = 80, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """A sample's prices inside [low, high] with both sides beside each other and cumulative turnover away
    from the middle; of more than ``most`` prices those nearest the middle (or, without one, the middle of the extremes)."""
    rows = sample if low is None else sample.where(F.col("price") >= low)
    rows = rows if high is None else rows.where(F.col("price") <= high)
    part = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("usd"))), F.lit(0))
    cells = rows.groupBy(*keys, "price").agg(part("bid").alias("bid_usd"), part("ask").alias("ask_usd"))
    ends = cells.groupBy(*keys).agg(((F.min("price") + F.max("price")) / 2).cast("double").alias("__between"))
    cells = cells.join(ends, keys).join(mids.select(*keys, "mid"), keys, "left")
    near = F.abs(F.col("price").cast("double") - F.coalesce("mid", "__between"))
    cells = top(cells, keys, most, near, F.desc("price"))
    run = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = lambda name, order: F.when(F.col(name) > 0, F.sum(name).over(run(order))).otherwise(0)
    return cells.withColumns({"bid_cum_usd": cum("bid_usd", F.desc("price")), "ask_cum_usd": cum("ask_usd", F.asc("price"))}).drop("__between")


def nearest_walls(sample: DataFrame, probes: DataFrame, *, keys: list[str] = BOOK) -> DataFrame:
    """For each probe (keys, probe) the best bid at or under it and the best ask at or over it; where a
    side has none there, its best price. One aggregation over the levels that share a probe's book."""
    p, x = F.col("price").cast("double"), F.col("probe").cast("double")
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    level = F.struct("price", "usd")
    rows = probes.select(*keys, "probe").distinct().join(sample, keys, "left").groupBy(*keys, "probe").agg(
        F.max(F.when(bid & (p <= x + 1e-12), level)).alias("__b"), F.max(F.when(bid, level)).alias("__b_any"),
        F.min(F.when(ask & (p >= x - 1e-12), level)).alias("__a"), F.min(F.when(ask, level)).alias("__a_any"),
    )
    b, a = F.coalesce("__b", "__b_any"), F.coalesce("__a", "__a_any")
    usd = lambda s: F.coalesce(s["usd"], F.lit(0))
    return rows.select(*keys, "probe", b["price"].alias("bid_price"), usd(b).alias("bid_usd"), a["price"].alias("ask_price"), usd(a).alias("ask_usd"))


def price_window(history: DataFrame, mids: DataFrame, tick: float, *, keys: list[str] = BOOK, lookback: int = 14, zoom: float = 1.0, least_ticks: int = 48, pad: float = 0.18, least_bps: float = 0.8, most_bps: float = 8.0) -> DataFrame:
    """The prices to show around the newest sample's middle: half the span of the walls of the last ``lookback``
    samples with padding, at least so many ticks and basis points, at most so many basis points or the padded span.
    A key whose newest sample has no middle has no window."""
    times = history.select(*keys, "t").unionByName(mids.select(*keys, "t")).distinct()
    recent = top(times, keys, lookback, F.desc("t"))
    newest = times.groupBy(*keys).agg(F.max("t").alias("t"))
    focus = mids.join(newest, [*keys, "t"]).select(*keys, F.col("mid").cast("double").alias("mid")).where("mid > 0")
    of = lambda df, price: df.join(recent, [*keys, "t"], "left_semi").select(*keys, F.col(price).cast("double").alias("x"))
    prices = of(history, "price").unionByName(of(mids, "mid"))
    mid = F.col("mid")
    near = F.when(F.abs(F.col("x") - mid) <= mid * (most_bps / 10_000) * 1.5, F.col("x"))
    rows = prices.join(focus, keys).groupBy(*keys, "mid").agg(F.coalesce(F.min(near), mid).alias("wall_low"), F.coalesce(F.max(near), mid).alias("wall_high"))
    book = (F.col("wall_high") - F.col("wall_low")) / 2 * (1 + pad)
    least = F.greatest(book, mid * (least_bps / 10_000), F.lit(tick * 4))
    most = F.greatest(mid * (most_bps / 10_000), book, F.lit(tick * 4))
    half = F.least(F.greatest(least, F.lit(tick * least_ticks)), most) * zoom
    return rows.select(*keys, "mid", "wall_low", "wall_high", (mid - half).alias("price_min"), (mid + half).alias("price_max"))


def densified(history: DataFrame, *, keys: list[str] = BOOK, step_ms: int = 250, most: int = 480) -> DataFrame:
    """Sample times on an even grid: (keys, place, t, sample_t) with the last sample at or before each t,
    from a key's first sample to its last in steps of ``step_ms``, or wider ones beyond ``most`` columns."""
    times = history.select(*keys, F.col("t").cast("double").alias("t")).distinct()
    ends = times.groupBy(*keys).agg(F.min("t").alias("__a"), F.max("t").alias("__b"))
    span = F.greatest(F.lit(float(step_ms)), F.col("__b") - F.col("__a"))
    n = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(span / step_ms) + 1)).cast("long")
    grid = ends.select(*keys, "__a", span.alias("__span"), n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("place"))
    grid = grid.select(*keys, "place", (F.col("__a") + F.col("place") / (F.col("__n") - 1) * F.col("__span")).alias("t"))
    return as_of(grid, times.withColumn("sample_t", F.col("t")), keys, ["sample_t"], time="t", block=step_ms * 4096)


def filled_gaps(history: DataFrame, *, keys: list[str] = BOOK, step_ms: int = 420, longest_ms: int = 10_000, most: int = 12) -> DataFrame:
    """Sample times with copies held every ``step_ms`` in gaps under ``longest_ms``, fewer than ``most``
    a gap: (keys, t, sample_t)."""
    times = history.select(*keys, "t").distinct()
    times = following(times, keys, [], ["t"], time="t", block=step_ms * 4096)
    gap = F.col("next_t") - F.col("t")
    copies = F.when((gap > step_ms) & (gap < longest_ms), F.least(F.floor(gap / step_ms), F.lit(most)) - 1).otherwise(0).cast("long")
    rows = times.withColumn("__n", copies).select(*keys, F.col("t").alias("sample_t"), F.explode(F.sequence(F.lit(0).cast("long"), "__n")).alias("__k"))
    return rows.select(*keys, (F.col("sample_t") + F.col("__k") * step_ms).alias("t"), "sample_t")


def book_from_sample(sample: DataFrame) -> DataFrame:
    """Levels again from turnover by price."""
    return sample.withColumn("quantity", F.try_divide(F.col("usd"), F.col("price")))


def grid(history: DataFrame, window: DataFrame, *, keys: list[str] = BOOK, rows: int = 80) -> DataFrame:
    """(keys, t, row, usd): turnover at the middles of ``rows`` even rows, from the highest price of the
    key's window (price_min, price_max) down.

    Between two levels it is interpolated; outside the book it falls off exponentially from nine tenths
    of the edge. Nothing is under a floor of 4 % of the column's largest level, which falls off around the
    book too. Each span between neighbouring levels fills the rows inside it, so no row meets all levels.
    """
    column = [*keys, "t"]
    levels = history.where("usd > 0").groupBy(*column, F.col("price").cast("double").alias("price")).agg(F.sum("usd").cast("double").alias("usd"))
    levels = levels.join(window.select(*keys, F.col("price_min").cast("double"), F.col("price_max").cast("double")), keys)
    c = F.col
    span = c("price_max") - c("price_min")
    line, whole = Window.partitionBy(*column).orderBy("price"), Window.partitionBy(*column)
    place = lambda price: F.floor((c("price_max") - price) / span * rows - 0.5)  # the lowest row at or over a price
    spans = levels.withColumns({
        "__next": F.lead("price").over(line), "__next_usd": F.lead("usd").over(line), "__low": F.min("price").over(whole), "__high": F.max("price").over(whole), "__most": F.max("usd").over(whole),
    })
    none = F.array().cast("array<bigint>")

    def cut(first, last):
        first, last = F.greatest(first, F.lit(0)).cast("long"), F.least(last, F.lit(rows - 1)).cast("long")
        return F.when(first <= last, F.sequence(first, last)).otherwise(none)

    above = cut(F.coalesce(place(c("__next")) + 1, F.lit(0)), place(c("price")))
    below = F.when(c("price") == c("__low"), cut(place(c("price")) + 1, F.lit(rows - 1))).otherwise(none)
    cells = spans.withColumn("row", F.explode(F.concat(above, below)))
    at = c("price_max") - (c("row") + 0.5) / rows * span
    falloff = F.greatest(span * 0.55, (c("__high") - c("__low")) * 1.2, span / max(8, rows / 4))
    outside = F.when(at == c("price"), c("usd")).otherwise(c("usd") * F.exp(-F.abs(at - c("price")) / falloff) * 0.9)
    between = c("usd") + (c("__next_usd") - c("usd")) * (at - c("price")) / (c("__next") - c("price"))
    value = F.when(c("__next").isNull() | (at < c("price")), outside).otherwise(between)
    floor = c("__most") * 0.04 * F.exp(-F.abs(at - (c("__low") + c("__high")) / 2) / (span * 0.7))
    return cells.select(*column, "row", F.greatest(value, floor).alias("usd"))


def price_bounds(history: DataFrame, mids: DataFrame, *, keys: list[str] = BOOK, pad: float = 0.08) -> DataFrame:
    """(keys, price_min, price_max): all prices and middles, with a margin on both sides; none where they don't span anything."""
    x = history.select(*keys, F.col("price").cast("double").alias("x")).unionByName(mids.select(*keys, F.col("mid").cast("double").alias("x")))
    ends = x.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("hi > lo")
    return ends.select(*keys, (F.col("lo") - (F.col("hi") - F.col("lo")) * pad).alias("price_min"), (F.col("hi") + (F.col("hi") - F.col("lo")) * pad).alias("price_max"))


def sparse_grid(history: DataFrame, window: DataFrame, *, keys: list[str] = BOOK, rows: int = 80) -> DataFrame:
    """(keys, t, row, usd) of the rows that levels fall into, nothing between them: a level inside the window is shared
    evenly by its row and the two beside it, or has its row alone at the window's edges."""
    levels = history.where("usd > 0").join(window.select(*keys, F.col("price_min").cast("double"), F.col("price_max").cast("double")), keys)
    price = F.col("price").cast("double")
    place = F.floor((F.col("price_max") - price) / (F.col("price_max") - F.col("price_min")) * rows)
    row = F.greatest(F.lit(0), F.least(F.lit(rows - 1), place)).cast("long")
    inside = levels.where(price.between(F.col("price_min"), F.col("price_max"))).withColumn("__row", row)
    rows_of = F.when(F.col("__row").between(1, rows - 2), F.sequence(F.col("__row") - 1, F.col("__row") + 1)).otherwise(F.array("__row"))
    cells = inside.withColumn("__rows", rows_of).select(*keys, "t", F.explode("__rows").alias("row"), (F.col("usd").cast("double") / F.size("__rows")).alias("usd"))
    return cells.groupBy(*keys, "t", "row").agg(F.sum("usd").alias("usd"))


def held_grid(history: DataFrame, samples: DataFrame, window: DataFrame, *, keys: list[str] = BOOK, rows: int = 80, sparse: bool = False, block: int = 3_600_000) -> DataFrame:
    """The grid of all ``samples`` (keys, t): a column without levels takes the cells of the last one with any, found by
    blocks of the line of columns. Columns before the first one with levels are empty."""
    cells = (sparse_grid if sparse else grid)(history, window, keys=keys, rows=rows)
    filled = history.where("usd > 0").select(*keys, "t").distinct().withColumn("__from", F.col("t"))
    columns = as_of(samples.select(*keys, "t").distinct(), filled, keys, ["__from"], time="t", block=block).where("__from is not null")
    return columns.join(cells.withColumnRenamed("t", "__from"), [*keys, "__from"]).select(*keys, "t", "row", "usd")


def paths(history: DataFrame, samples: DataFrame, mids: DataFrame, *, keys: list[str] = BOOK) -> DataFrame:
    """(keys, t, mid, best_bid, best_ask) of all samples; null where a sample has none."""
    best = lambda side, f: f(F.when(F.col("side") == side, F.col("price")))
    sides = history.groupBy(*keys, "t").agg(best("bid", F.max).alias("best_bid"), best("ask", F.min).alias("best_ask"))
    return samples.select(*keys, "t").distinct().join(mids.select(*keys, "t", "mid"), [*keys, "t"], "left").join(sides, [*keys, "t"], "left")
