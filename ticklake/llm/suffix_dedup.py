"""Removal of repeated 400-byte strings with suffix arrays.

A string of ``WINDOW`` bytes is anchored at its 32-byte gram of smallest hash (the rightmost of
equals), so equal strings have equal anchors. Consecutive strings of one anchor are a fragment.

1. Two Bloom filters over all grams, or two for each range of them where one of bounded size has no
   room for all, tell which may occur again. Only fragments of these go on: equal
   ones are counted and one of them is kept, and grams that occur once after all are dropped.
2. Fragments that share a gram meet in one task as bytes. They are cut into blocks of ``BLOCK`` bytes,
   aligned to the gram, and a suffix array over the blocks of many fragments brings suffixes that agree
   in ``CORE`` blocks side by side. A string is such a core with at most ``BLOCK`` bytes around it, so
   strings are equal where neighbours agree in these too. A fragment counted twice agrees with itself.
3. A gram with more than ``MOST`` different fragments isn't held by one task. Its strings are
   told apart by Spark: those whose core occurs again are counted by digest.

Every document is then cut by the decisions on its fragments. Texts are shuffled only where they hold
a fragment to compare or something to cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, written
from .filters import NOTED, bits_for, filter_of, fits, gathered, has, members, noting, outside, pairs, screened
from .shingles import mix, parts_of, texts_of
from .suffix_array import suffix_array

WINDOW, GRAM, BLOCK = 400, 32, 16
CORE = WINDOW // BLOCK - 1
#: Blocks of one suffix array, unless one gram has more; different fragments of a gram in one task.
SYMBOLS, MOST = 1 << 15, 1000
_PART = 1 << 19
_rng = np.random.default_rng(4711)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = _rng.integers(1, 2**62, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 20) - 1)
NAME = ["gram", "f1", "f2"]


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of a part its anchor's place, and every gram's hash."""
    h = _VALUE[data]
    for k in range(5):  # grams of 2, 4, 8, 16 and 32 bytes
        h = h[: -(1 << k)] * _STEP[k] + h[1 << k :]
    h = mix(h)
    key = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    span, width = WINDOW - GRAM + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    return (_PLACE - (key & _PLACE)).astype(np.int64), h.view(np.int64)


def _parts(bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of runs of rows, or of pieces of one long row. Pieces
    overlap by a string less a byte, so that each string is in one of them."""
    for a, b in parts_of(bounds, _PART):
        lo, hi = int(bounds[a]), int(bounds[b])
        if hi - lo <= _PART:
            yield a, b, lo, hi
        else:
            for x in range(lo, hi - WINDOW + 1, _PART - WINDOW):
                yield a, a + 1, x, min(hi, x + _PART - 1)


def _fragments_of(column: pa.Array) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part's bytes, its place in its first row, row, gram, and in the part: first string, last string, anchor) of the fragments of a part."""
    data, bounds = texts_of(column)
    for a, b, lo, hi in _parts(bounds):
        if hi - lo < WINDOW:
            continue
        part = data[lo:hi]
        at, grams = _anchors(part)
        own = np.clip(bounds[a : b + 1] - lo, 0, hi - lo)  # of each row in the part
        row = np.repeat(np.arange(a, b), np.diff(own))[: len(at)]
        good = np.arange(len(at)) + WINDOW <= own[1:][row - a]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new & good)
        if not len(first):
            continue
        ends = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True))
        yield part, lo - int(bounds[a]), row[first], grams[at[first]], first, ends, at[first]


def _digest(view: memoryview, first: list[int], last: list[int]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[i : j + WINDOW]) for i, j in zip(first, last)]), "<i8").reshape(-1, 2)


def _grams(batch: pa.RecordBatch) -> np.ndarray:
    got = [gram for _, _, _, gram, *_ in _fragments_of(batch.column(0))]
    return pairs(np.concatenate(got)) if got else np.zeros((0, 2), np.uint64)


def _named(packed):
    """(r1, r2, text) -> one row for each row and different fragment of it whose gram is in the filter, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, row, gram, first, last, _ in _fragments_of(batch.column(2)):
                hit = np.flatnonzero(has(packed.value, pairs(gram))) if packed else np.arange(len(gram))
                if not len(hit):
                    continue
                f = _digest(memoryview(part), first[hit].tolist(), last[hit].tolist())
                order = np.lexsort((f[:, 1], f[:, 0], row[hit]))
                row, gram, f = row[hit][order], gram[hit][order], f[order]
                new = np.append(True, (row[1:] != row[:-1]) | (f[1:] != f[:-1]).any(axis=1))
                at = np.flatnonzero(new)
                who = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(who), batch.column(1).take(who), *(pa.array(np.ascontiguousarray(x[at])) for x in (gram, f[:, 0], f[:, 1])), pa.array(np.diff(np.append(at, len(new))))],
                    ["r1", "r2", *NAME, "n"],
                )

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted) -> the wanted fragments as bytes, with the anchor's place in them."""
    for batch in batches:
        for r in range(batch.num_rows):
            wanted = {(x["f1"], x["f2"]): x["n"] for x in batch.column(1)[r].as_py()}
            grams = np.array([x["gram"] for x in batch.column(1)[r].as_py()])
            out = []
            for part, _, _, gram, first, last, at in _fragments_of(batch.column(0).slice(r, 1)):
                hit = np.flatnonzero(np.isin(gram, grams))
                f = _digest(memoryview(part), first[hit].tolist(), last[hit].tolist()).tolist()
                for k, (f1, f2) in zip(hit.tolist(), f):
                    n = wanted.pop((f1, f2), 0)  # once, however often the text has it
                    if n:
                        out.append((int(gram[k]), f1, f2, n, int(at[k] - first[k]), part[first[k] : last[k] + WINDOW].tobytes()))
            if out:
                kinds = (*[pa.int64()] * 4, pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [*NAME, "n", "at", "bytes"])


def repeated_windows(fragments: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """For fragments (count, anchor, bytes) which of their strings occur again in this list."""
    count = np.minimum(2, np.array([n for n, _, _ in fragments]))
    sizes = np.array([len(x) for _, _, x in fragments])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(x for _, _, x in fragments), np.uint8)
    shift = np.array([a % BLOCK for _, a, _ in fragments])
    blocks = (sizes - shift) // BLOCK
    owner = np.repeat(np.arange(len(fragments)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    place = begin[owner] + shift[owner] + BLOCK * number
    raw = np.ascontiguousarray(data[place[:, None] + np.arange(BLOCK)]).view(">u8").astype(np.uint64)
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    name = np.empty(len(raw), np.int64)
    name[order] = np.cumsum(np.append(0, (raw[order][1:] != raw[order][:-1]).any(axis=1)))
    # an end mark of its own behind each fragment's blocks, smaller than all blocks, the last one smallest
    marks = len(fragments)
    where = np.arange(len(name)) + owner
    symbols = np.empty(len(name) + marks, np.int64)
    symbols[np.cumsum(blocks) + np.arange(marks)] = np.arange(marks, 0, -1) - 1
    symbols[where] = name + marks
    suffixes = np.array(suffix_array(symbols))
    back = np.full(len(symbols), -1)
    back[where] = np.arange(len(name))
    at = back[suffixes]
    at = at[at >= 0]
    at = at[number[at] + CORE <= blocks[owner[at]]]  # suffixes that hold a core, in order
    out = [np.zeros(size - WINDOW + 1, bool) for size in sizes.tolist()]
    if not len(at):
        return out
    start = where[at]
    same = np.ones(len(at) - 1, bool)
    for k in range(CORE):
        same &= symbols[start[1:] + k] == symbols[start[:-1] + k]
    core = np.cumsum(np.append(0, ~same))
    shared = np.bincount(core, count[owner[at]])[core] > 1
    at, core = at[shared], core[shared]
    if not len(at):
        return out
    own, offset = owner[at], place[at] - begin[owner[at]]
    padded = np.concatenate([np.zeros(BLOCK, np.uint8), data, np.zeros(BLOCK, np.uint8)])
    left = padded[(place[at] + 1)[:, None] + np.arange(BLOCK - 1)]
    right = padded[(place[at] + BLOCK + CORE * BLOCK)[:, None] + np.arange(BLOCK)]
    edges = np.hstack([left, right])
    for taken in range(BLOCK):  # bytes left of the core
        good = np.flatnonzero((offset >= taken) & (offset - taken + WINDOW <= sizes[own]))
        if not len(good):
            continue
        edge = np.ascontiguousarray(edges[good, BLOCK - 1 - taken : 2 * BLOCK - 1 - taken]).view(np.uint64)
        order = np.lexsort((edge[:, 1], edge[:, 0], core[good]))
        new = np.append(True, (core[good][order][1:] != core[good][order][:-1]) | (edge[order][1:] != edge[order][:-1]).any(axis=1))
        group = np.cumsum(new) - 1
        again = order[np.bincount(group, count[own[good[order]]])[group] > 1]
        for k, o in zip(own[good[again]].tolist(), (offset[good[again]] - taken).tolist()):
            out[k][o] = True
    return out


def _runs(marked: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return [{"a": a, "b": b - 1} for a, b in edge.reshape(-1, 2).tolist()]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments come sorted by gram; the runs of repeated strings of each go out."""
    held: list[dict] = []

    def out(part: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = [(x["gram"], x["f1"], x["f2"], _runs(m)) for x, m in zip(part, repeated_windows([(x["n"], x["at"], x["bytes"]) for x in part])) if m.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (*[pa.int64()] * 3, _RUNS))], [*NAME, "runs"])

    size = 0
    for batch in batches:
        for x in batch.to_pylist():
            if size >= SYMBOLS * BLOCK and x["gram"] != held[-1]["gram"]:
                yield from out(held)
                held, size = [], 0
            held.append(x)
            size += len(x["bytes"])
    if held:
        yield from out(held)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments -> their cells: the strings that share a core, as the bytes that hold them all."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        rows, cores, first, held = [], [], [], []
        for r, (at, content) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            for c in range(at % BLOCK, len(content) - CORE * BLOCK + 1, BLOCK):
                a, b = max(0, c - BLOCK + 1), min(len(content), c + WINDOW)
                if b - a >= WINDOW:
                    rows.append(r)
                    cores.append(digest(content[c : c + CORE * BLOCK]))
                    first.append(a)
                    held.append(content[a:b])
        if rows:
            who = pa.array(rows)
            core = np.frombuffer(b"".join(cores), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(who) for k in range(4)), *(pa.array(np.ascontiguousarray(core[:, k])) for k in (0, 1)), pa.array(first, pa.int32()), pa.array(held, pa.binary())],
                [*NAME, "n", "c1", "c2", "first", "bytes"],
            )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = batch.column(5).to_pylist()
        n = np.array([len(x) - WINDOW + 1 for x in cells], np.int64)
        if not n.sum():
            continue
        who = pa.array(np.repeat(np.arange(len(cells)), n))
        f = np.concatenate([_digest(memoryview(x), (k := list(range(m))), k) for x, m in zip(cells, n.tolist())])
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = batch.column(4).to_numpy()[np.repeat(np.arange(len(cells)), n)] + place
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(who) for k in range(4)), pa.array(first.astype(np.int32)), *(pa.array(np.ascontiguousarray(f[:, k])) for k in (0, 1))], [*NAME, "n", "first", "w1", "w2"])


def _decided(docs: DataFrame, pending: DataFrame) -> DataFrame:
    """(gram, f1, f2, runs): which strings of the pending fragments occur again, counted from the fragment's first one."""

    def contents(part: DataFrame) -> DataFrame:
        wanted = written(part.groupBy("r1").agg(F.collect_list(F.struct(*NAME, "n")).alias("wanted")), "wanted")
        texts = docs.select("r1", "text").mapInArrow(members(filter_of(wanted, "r1")), "r1 long, text string").dropDuplicates(["r1"])
        return texts.join(wanted, "r1").select("text", "wanted").mapInArrow(_contents, "gram long, f1 long, f2 long, n long, at int, bytes binary")

    few = contents(pending.where(F.col("kinds") <= MOST)).repartition("gram").sortWithinPartitions("gram")
    out = few.mapInArrow(_arrays, "gram long, f1 long, f2 long, runs array<struct<a:int,b:int>>")
    many = pending.where(F.col("kinds") > MOST)
    if not many.head(1):
        return out
    cells = written(contents(many).mapInArrow(_cells, "gram long, f1 long, f2 long, n long, c1 long, c2 long, first int, bytes binary"), "cells")
    shared = written(cells.groupBy("c1", "c2").agg(F.sum("n").alias("all")).where("all > 1").select("c1", "c2"), "cores")
    met = cells.join(shared, ["c1", "c2"]).select(*NAME, "n", "first", "bytes")
    strings = written(met.mapInArrow(_strings, "gram long, f1 long, f2 long, n long, first int, w1 long, w2 long"), "strings")
    again = written(strings.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").select("w1", "w2"), "again")
    found = strings.join(again, ["w1", "w2"]).groupBy(*NAME).agg(F.collect_set("first").alias("at"))
    return out.unionAll(found.select(*NAME, F.transform("at", lambda x: F.struct(x.alias("a"), x.alias("b"))).alias("runs")))


def _cut(keep_bytes: bool):
    """(key, text, marks): marks are decisions on fragments of the text, null for none."""

    def spans(text: pa.Array, marks: list[dict]) -> np.ndarray:
        known = {(x["f1"], x["f2"]): [(y["a"], y["b"]) for y in x["runs"]] for x in marks}
        grams = np.array([x["gram"] for x in marks])
        out = []
        for part, base, _, gram, first, last, _ in _fragments_of(text):
            hit = np.flatnonzero(np.isin(gram, grams))
            for k, f in zip(hit.tolist(), _digest(memoryview(part), first[hit].tolist(), last[hit].tolist()).tolist()):
                out += [(base + first[k] + a, base + first[k] + b + WINDOW) for a, b in known.get(tuple(f), ())]
        out = np.array(sorted(out), np.int64).reshape(-1, 2)
        if not len(out):
            return out
        reach = np.maximum.accumulate(out[:, 1])
        new = np.append(True, out[1:, 0] > reach[:-1])
        return np.stack([out[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(out) - 1)]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, removed, count, sha, kept = [], [], [], [], []
            texts = batch.column(1).cast(pa.binary())
            for r in range(batch.num_rows):
                text, marks = texts[r].as_py() or b"", batch.column(2)[r].as_py()
                gone = spans(texts.slice(r, 1), marks).tolist() if marks else []
                rest = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)]))
                n.append(len(text))
                removed.append(len(text) - len(rest))
                count.append(len(gone))
                sha.append(hashlib.sha256(rest).hexdigest())
                if keep_bytes:
                    kept.append(rest)
            more = [pa.array(kept, pa.binary())] * keep_bytes
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string()), *more], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_bytes"] * keep_bytes])

    return run


def remove_repeated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row for each row of ``docs``: key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``kept_sha256`` of the bytes that stay, and on request these (``kept_bytes``; a cut can split
    a character).

    A byte goes if a string of 400 bytes that covers it starts anywhere else too, in this text or
    another; overlaps count, and texts are judged as they came. Null texts are empty; shorter texts
    stay whole. Repeated rows repeat each other's strings; null keys are allowed; other columns, of
    whatever name, don't matter. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[key]
    # two hashes name a row; rows equal in key and text share them and all decisions
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).select(
        F.xxhash64("key", "text").alias("r1"), F.xxhash64(F.lit(1), "text", "key").alias("r2"), "key", "text")
    long = source.where(F.octet_length("text") >= WINDOW)
    strings = long.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    n_grams = strings * 2 // (WINDOW - GRAM + 2)
    head = "r1 long, r2 long, gram long, f1 long, f2 long, n long"
    packed = None
    if fits(n_grams):
        n_bits = bits_for(n_grams)
        packed = docs.sparkSession.sparkContext.broadcast(gathered(long.select("text").mapInArrow(noting(_grams, n_bits), NOTED), n_bits, "twice"))
    fragments = long.select("r1", "r2", "text").mapInArrow(_named(packed), head)
    if not packed:
        fragments = screened(fragments, lambda batch: batch.column("gram").to_numpy(), n_grams, times="n")
    distinct = written(fragments.groupBy(*NAME).agg(F.sum("n").alias("n"), F.min("r1").alias("r1")), "distinct")
    grams = written(distinct.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1").select("gram", "kinds"), "grams")
    pending = written(distinct.join(grams, "gram"), "pending")
    decided = written(_decided(long, pending), "decided")

    met = long.select("r1", "r2", "text").mapInArrow(_named(filter_of(decided, "gram")), head).join(decided, NAME)
    marks = written(met.groupBy("r1", "r2").agg(F.collect_set(F.struct(*NAME, "runs")).alias("marks")), "marks")
    hit = filter_of(marks, "r1")
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_bytes
    row = f"r1 long, r2 long, key {kind}, text string"
    cut = source.mapInArrow(members(hit), row).join(marks, ["r1", "r2"], "left").select("key", "text", "marks")
    whole = source.select("r1", "key", "text").mapInArrow(outside(hit, _cut(keep_bytes)), schema)
    return cut.mapInArrow(_cut(keep_bytes), schema).unionAll(whole).withColumnRenamed("key", key)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"))
