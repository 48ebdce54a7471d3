"""Order-book analytics over resting levels (book_id, side, price, quantity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import imbalance_percent, quantize, spread_bps

BOOK = ["book_id"]


def side(name: str) -> Column:
    return F.col("side") == name


def ranked(levels: DataFrame, depth: int, *, keys: list[str] = BOOK) -> DataFrame:
    """The best ``depth`` levels of each side with ``level`` from 1: bids from the highest, asks from the lowest."""
    best = F.when(side("bid"), -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*keys, "side").orderBy(best)
    return levels.where("quantity > 0").withColumn("level", F.row_number().over(w)).where(F.col("level") <= depth)


def best_prices(levels: DataFrame, *, keys: list[str] = BOOK) -> DataFrame:
    """Best bid and ask, middle and spread, without a sort."""
    q = levels.where("quantity > 0").groupBy(*keys).agg(F.max(F.when(side("bid"), F.col("price"))).alias("bid"), F.min(F.when(side("ask"), F.col("price"))).alias("ask"))
    bid, ask = F.col("bid").cast("double"), F.col("ask").cast("double")
    return q.withColumns({"mid": (bid + ask) / 2, "spread": F.col("ask") - F.col("bid"), "spread_bps": spread_bps(bid, ask)})


def ladder(levels: DataFrame, depth: int, *, keys: list[str] = BOOK) -> DataFrame:
    """Levels with cumulative quantity and turnover from the best price outwards."""
    w = Window.partitionBy(*keys, "side").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usd = F.col("price") * F.col("quantity")
    return ranked(levels, depth, keys=keys).withColumns({"cum_quantity": F.sum("quantity").over(w), "cum_usd": F.sum(usd).over(w)})


def pressure(levels: DataFrame, depth: int, *, keys: list[str] = BOOK) -> DataFrame:
    """Turnover and quantity that rest on each side within ``depth`` levels. Empty books: shares of 50."""
    usd = F.col("price") * F.col("quantity")
    part = lambda name, x: F.coalesce(F.sum(F.when(side(name), x)), F.lit(0))
    s = ranked(levels, depth, keys=keys).groupBy(*keys).agg(
        part("bid", usd).alias("bid_usd"), part("ask", usd).alias("ask_usd"), part("bid", F.col("quantity")).alias("bid_quantity"), part("ask", F.col("quantity")).alias("ask_quantity")
    )
    b, a = F.col("bid_usd").cast("double"), F.col("ask_usd").cast("double")
    bq, aq = F.col("bid_quantity").cast("double"), F.col("ask_quantity").cast("double")
    return s.withColumns({
        "imbalance_percent": imbalance_percent(b, a), "bid_percent": F.coalesce(F.try_divide(b, b + a) * 100, F.lit(50.0)),
        "buy_percent_by_quantity": F.coalesce(F.try_divide(bq, bq + aq) * 100, F.lit(50.0)),
    })


def depth_sample(levels: DataFrame, tick: str, depth: int, *, keys: list[str] = BOOK) -> DataFrame:
    """Turnover by side and price step within ``depth`` levels."""
    rows = ranked(levels, depth, keys=keys)
    return rows.groupBy(*keys, "side", quantize("price", tick).alias("price_step")).agg(F.sum(F.col("price") * F.col("quantity")).alias("usd"))


def price_ladder(levels: DataFrame, tick: str, depth: int, *, keys: list[str] = BOOK, outliers: bool = True) -> DataFrame:
    """One row a price step with both sides side by side and cumulative sums away from the middle.
    Levels further from it (or from the only best price) than a quarter percent and 80 ticks are left
    out before the best ``depth`` of each side are taken."""
    rows = levels.where("quantity > 0")
    if outliers:
        book = Window.partitionBy(*keys)
        bid, ask = (f(F.when(side(name), F.col("price").cast("double"))).over(book) for name, f in (("bid", F.max), ("ask", F.min)))
        mid = F.coalesce((bid + ask) / 2, bid, ask)
        rows = rows.withColumn("__mid", mid)
        far = F.greatest(F.col("__mid") * 0.0025, F.lit(float(tick) * 80))
        rows = rows.where(F.abs(F.col("price").cast("double") - F.col("__mid")) <= far).drop("__mid")
    cells = ranked(rows, depth, keys=keys).groupBy(*keys, quantize("price", tick).alias("price_step")).agg(
        F.coalesce(F.sum(F.when(side("bid"), F.col("quantity"))), F.lit(0)).alias("bid_quantity"), F.coalesce(F.sum(F.when(side("ask"), F.col("quantity"))), F.lit(0)).alias("ask_quantity")
    )
    run = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumns({"cum_bid": F.sum("bid_quantity").over(run(F.desc("price_step"))), "cum_ask": F.sum("ask_quantity").over(run(F.asc("price_step")))})


def inferred_tick(levels: DataFrame, *, keys: list[str] = BOOK, depth: int = 8, fallback: float = 0.01) -> DataFrame:
    """The smallest positive gap between the best levels of a side."""
    w = Window.partitionBy(*keys, "side").orderBy("price")
    gaps = ranked(levels, depth, keys=keys).withColumn("__gap", F.col("price") - F.lag("price").over(w))
    return gaps.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("__gap") > 0, F.col("__gap"))).cast("double"), F.lit(fallback)).alias("tick"))


def resting_at(levels: DataFrame, probes: DataFrame, tick: Column, *, keys: list[str] = BOOK, ticks: int = 8) -> DataFrame:
    """For each probe (keys, price) the level of least distance within ``ticks``; nulls where none.
    Probes meet levels by price cell, their own and the two beside it, never all of a book."""
    width = tick * ticks
    cell = lambda p: F.floor(p / width).cast("long")
    near = probes.select(*keys, F.col("price").alias("probe"), F.explode(F.array(*[cell(F.col("price")) + d for d in (-1, 0, 1)])).alias("__cell"))
    rows = levels.select(*keys, "side", F.col("price").alias("resting_price"), "quantity", cell(F.col("price")).alias("__cell"))
    away = F.abs(F.col("resting_price") - F.col("probe"))
    hit = near.join(rows, [*keys, "__cell"]).where(away <= width)
    found = hit.groupBy(*keys, "probe").agg(F.min_by(F.struct("resting_price", "side", "quantity"), F.struct(away, "resting_price", "side")).alias("__best"))
    out = probes.select(*keys, F.col("price").alias("probe")).distinct().join(found, [*keys, "probe"], "left")
    return out.select(*keys, "probe", "__best.resting_price", "__best.side", "__best.quantity")


def slots(levels: DataFrame, n: int, *, keys: list[str] = BOOK) -> DataFrame:
    """Exactly ``n`` rows a side of each book; missing levels have null prices."""
    books = levels.select(*keys).distinct()
    grid = books.select(*keys, F.explode(F.array(F.lit("bid"), F.lit("ask"))).alias("side")).select(*keys, "side", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("level"))
    return grid.join(ladder(levels, n, keys=keys), [*keys, "side", "level"], "left")


def book_imbalance(levels: DataFrame, depth: int = 10, *, keys: list[str] = BOOK) -> DataFrame:
    """The imbalance of turnover within ``depth`` levels; null for an empty book."""
    p = pressure(levels, depth, keys=keys)
    return p.select(*keys, F.when(F.col("bid_usd") + F.col("ask_usd") > 0, F.col("imbalance_percent")).alias("imbalance_percent"))


def resolved_tick(levels: DataFrame, wanted: DataFrame, *, keys: list[str] = BOOK) -> DataFrame:
    """(keys, tick): the wanted positive tick of a book, else the inferred one."""
    given = wanted.select(*keys, F.when(F.col("tick") > 0, F.col("tick").cast("double")).alias("__given"))
    return inferred_tick(levels, keys=keys).join(given, keys, "left").select(*keys, F.coalesce("__given", "tick").alias("tick"))


def quotes_of(folded: DataFrame) -> DataFrame:
    """A quote for each applied update of a valid book that has both sides."""
    good = folded.where("validity = 'valid' and reason = '' and best_bid is not null and best_ask is not null")
    return good.select("book", "ord", F.col("best_bid").alias("bid_price"), F.col("best_ask").alias("ask_price"))


def level_operation(quantity: Column) -> Column:
    """What a level's new quantity asks for: delete at 0, else upsert."""
    return F.when(quantity == 0, "delete").otherwise("upsert")
