"""Bloom filters of bounded size.

One filter that is sent to every task has sixteen bits a key and ``MOST_BITS`` at most: it is filled in
tasks, merged by segments and collected. Tasks send only the segments that they touched, compressed.
Keys are rows of two 64-bit numbers, one filter position each. ``fits`` tells whether keys are few
enough for it. Where they aren't, ``screened`` cuts keys into ranges of ``RANGE``, each with two filters
of its own that stay in the task to which the range's rows go: sixteen bits a key at any number of keys.

``filter_of`` doesn't need that: a full filter sends every row on to the join behind it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import mix

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
SEGMENT_BITS = 1 << 19
BITS_PER_KEY = 16
RANGE = 1 << 19
NOTED = "segment int, once binary, twice binary"


def fits(keys: int) -> bool:
    """Whether one filter of ``MOST_BITS`` has room for so many keys."""
    return BITS_PER_KEY * keys <= MOST_BITS


def bits_for(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * max(1, keys) - 1).bit_length()))


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Keys of 64-bit hashes."""
    hashes = hashes.view(np.uint64)
    return np.stack([mix(hashes), mix(hashes ^ np.uint64(0x9E3779B97F4A7C15))], axis=1)


def _bits(keys: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    at = keys & np.uint64(n_bits - 1)
    return (at >> np.uint64(3)).astype(np.int64), np.right_shift(128, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8)


def has(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a packed filter holds, and some more."""
    byte, bit = _bits(keys, 8 * len(filled))
    return (filled[byte] & bit).all(axis=1)


def noting(keys_of: Callable[[pa.RecordBatch], np.ndarray], n_bits: int):
    """A mapInArrow function: its task's filters of keys seen once and of keys seen again. A key
    counts as often as ``keys_of`` a batch has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            keys = keys_of(batch)
            if not len(keys):
                continue
            _, at, n = np.unique(keys[:, 0], return_index=True, return_counts=True)
            keys = keys[at]
            byte, bit = _bits(keys, n_bits)
            again = (n > 1) | (once[byte] & bit).all(axis=1)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
        for s in range(n_bits // SEGMENT_BITS):
            part = slice(s * SEGMENT_BITS // 8, (s + 1) * SEGMENT_BITS // 8)
            if once[part].any():
                pack = [pa.array([zlib.compress(x[part].tobytes(), 1)], pa.binary()) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *pack], ["segment", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come in order; a segment's rows are merged one by one. What both have in the first
    filter goes to the second."""
    now, once, twice = None, None, None

    def done():
        pack = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice)]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *pack], ["segment", "once", "twice"])

    for batch in batches:
        for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if s != now:
                if now is not None:
                    yield done()
                now, once, twice = s, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if now is not None:
        yield done()


def gathered(noted: DataFrame, n_bits: int, which: str) -> np.ndarray:
    """The packed filter ``once`` or ``twice`` of all tasks' rows."""
    merged = noted.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, NOTED)
    filled = np.zeros(n_bits // 8, np.uint8)
    for row in merged.select("segment", which).collect():  # n_bits / 8 bytes at most
        filled[row["segment"] * SEGMENT_BITS // 8 :][: SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(row[which]), np.uint8)
    return filled


def filter_of(df: DataFrame, column: str):
    """A broadcast filter of the distinct values of a long column."""
    n_bits = bits_for(df.count())
    noted = df.select(F.col(column).cast("long")).mapInArrow(noting(lambda b: pairs(b.column(0).to_numpy()), n_bits), NOTED)
    return df.sparkSession.sparkContext.broadcast(gathered(noted, n_bits, "once"))


def members(packed, inside: bool = True):
    """A mapInArrow function: the rows whose first column, a long, is (or isn't) in a broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(has(packed.value, pairs(batch.column(0).to_numpy())) == inside))

    return run


def outside(packed, work):
    """A mapInArrow function: ``work`` on the rows whose first column isn't in a filter, with that column
    gone and one of nulls behind the others. One Python worker does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rest() -> Iterator[pa.RecordBatch]:
            for batch in members(packed, False)(batches):
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.nulls(batch.num_rows)], [*batch.schema.names[1:], "none"])

        yield from work(rest())

    return run


def _firsts(hash_of: Callable[[pa.RecordBatch], np.ndarray], ranges: int, times: str | None):
    """Rows with their range and a state: 2 for those whose key an earlier row of the chunk has, which are
    sure to be repeated, 1 for first ones with such rows behind them, 0 for single ones."""

    def marked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        hashes = hash_of(batch).view(np.uint64)
        n = batch.column(times).to_numpy() if times else np.ones(len(hashes), np.int64)
        _, at, who = np.unique(hashes, return_index=True, return_inverse=True)
        state = np.full(len(hashes), 2, np.int8)
        state[at] = np.bincount(who, n) > 1
        place = ((mix(hashes) >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(state)], [*batch.schema.names, "range", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= RANGE:
                yield marked(held)
                held, rows = [], 0
        if held:
            yield marked(held)

    return run


def _screen(hash_of: Callable[[pa.RecordBatch], np.ndarray], n_bits: int):
    """Rows come sorted by range. A row whose key was seen goes out at once, a new one waits for the end of
    its range, so that no more rows wait than the range has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []
        once = twice = np.zeros(0, np.uint8)

        def again() -> Iterator[pa.RecordBatch]:
            for batch in waiting:
                yield batch.filter(pa.array(has(twice, pairs(hash_of(batch)))))

        for batch in batches:
            ranges, state = batch.column("range").to_numpy(), batch.column("state").to_numpy()
            rows = batch.select(batch.schema.names[:-2])
            edges = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)] if len(ranges) else []
            for a, b in zip(edges, edges[1:]):
                if ranges[a] != now:
                    yield from again()
                    now, waiting = ranges[a], []
                    once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
                part = rows.slice(a, b - a)
                hashes, who, n = np.unique(hash_of(part), return_inverse=True, return_counts=True)
                byte, bit = _bits(pairs(hashes), n_bits)
                seen = (n > 1) | (once[byte] & bit).all(axis=1)
                np.bitwise_or.at(twice, byte[seen], bit[seen])
                np.bitwise_or.at(once, byte, bit)
                out = seen[who] | (state[a:b] > 0)
                yield part.filter(pa.array(out))
                if not out.all():
                    waiting.append(part.filter(pa.array(~out)))
        yield from again()

    return run


def screened(rows: DataFrame, hash_of: Callable[[pa.RecordBatch], np.ndarray], keys: int, times: str | None = None) -> DataFrame:
    """``rows`` of repeated keys, and some few more: two Bloom filters a range of keys, ``keys`` in all.

    hash_of gives a batch's keys as 64-bit hashes; times names a column of how often a row's key counts.
    Each task first sets apart the rows whose key it has met already, in chunks: these need no filter, and a
    key that very many rows share sends few of them to its range. Columns named range or state aren't allowed.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    ranges = max(1, -(-keys // RANGE))
    # written, since which row of a key is its first hangs on the order in which rows come
    noted = written(rows.mapInArrow(_firsts(hash_of, ranges, times), f"{kinds}, range int, state byte"), "noted")
    first = noted.where("state < 2").repartition("range").sortWithinPartitions("range")
    return noted.where("state = 2").select(*rows.columns).unionAll(first.mapInArrow(_screen(hash_of, BITS_PER_KEY * RANGE), kinds))
