"""Benchmark decontamination: which documents contain which test items.

Contained means that at least ``threshold`` of an item's distinct 5-word shingles are in the
document. Items are partitioned by size. In each partition an item's MinHash signature is its
shingles of smallest hash (an exact prefix, no estimate), so many that a document with the threshold's share of the item must hold
one of them (an item of n shingles, of which need must be found, has n - need + 1). Signatures
of short items are short, whatever the document's length, and every document is probed whole. A
document that meets a signature is then checked against the item's exact shingles, as words.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import shingle_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Bytes of item texts that one block of the index holds; more items are searched in further blocks.
BLOCK_BYTES = 32 << 20


def exact_shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


class _Partition:
    """Signatures of items of like size."""

    def __init__(self, entries: list[tuple[int, int]], least: int) -> None:
        found = sorted(entries)
        self.least = least
        self.hashes = np.array([h for h, _ in found], np.uint64)
        self.items = np.array([i for _, i in found], np.int64)

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "seen"):
            self.seen = np.zeros(1 << 20, bool)
            self.seen[self.hashes >> np.uint64(44)] = True
        at = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        first, last = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        n = last - first
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.items[np.repeat(first, n) + step]


def _need(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def _index(items: list[tuple[int, str]], threshold: float) -> list[_Partition]:
    sizes: dict[int, list[tuple[int, int]]] = defaultdict(list)
    least: dict[int, int] = {}
    item = 0
    for _, hashes, counts in shingle_hashes(pa.array([t for _, t in items], pa.string())):
        at = 0
        for k in counts.tolist():
            own, at = np.unique(hashes[at : at + k]), at + k
            if n := len(own):
                part = n.bit_length()
                sizes[part] += [(int(h), item) for h in own[: n - _need(n, threshold) + 1]]
                least[part] = min(least.get(part, n), _need(n, threshold))
            item += 1
    return [_Partition(sizes[p], least[p]) for p in sizes]


def _search(sent, threshold: float, flags: bool = False):
    """``sent``: the broadcast items (key, text) and their index. The pairs found, or with ``flags`` each
    row and whether it has any. Only items that are met are turned into words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, parts = sent.value
        exact = functools.lru_cache(2000)(lambda i: exact_shingles(items[i][1]))
        for batch in batches:
            out: list[tuple] = []
            for first, hashes, counts in shingle_hashes(batch.column(1)):
                row = np.repeat(np.arange(len(counts)), counts)
                met = set()
                for part in parts:
                    at, item = part.probe(hashes)
                    good = counts[row[at]] >= part.least
                    met.update(zip(row[at][good].tolist(), item[good].tolist()))
                own, last = set(), -1
                for r, i in sorted(met):
                    if r != last:
                        own, last = exact_shingles(batch.column(1)[first + r].as_py()), r
                    common = len(exact(i) & own)
                    if common >= _need(len(exact(i)), threshold):
                        out.append((first + r, items[i][0], len(exact(i)), common))
            if flags:
                hit = np.zeros(batch.num_rows, bool)
                hit[[x[0] for x in out]] = True
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit)], ["row", "contained"])
                continue
            rows = pa.array([x[0] for x in out], pa.int64())
            cols = [pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *cols], ["key", "item_id", "item_shingles", "common_shingles"])

    return run


def _blocks(items: DataFrame, block_bytes: int, threshold: float) -> Iterator[Broadcast]:
    """Blocks of items with their index, one at a time on the driver."""
    spark = items.sparkSession
    total = items.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // block_bytes))
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        rows = [(r["item_id"], r["text"] or "") for r in part.select(F.col("item_id").cast("long"), "text").collect()]
        yield spark.sparkContext.broadcast((rows, _index(rows, threshold)))


def without_items(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item, by the rules of ``contained_items``, where they lie."""
    out = docs
    for sent in _blocks(items, block_bytes, threshold):
        packed = out.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
        marked = packed.mapInArrow(_search(sent, threshold, True), f"row {packed.schema['row'].dataType.simpleString()}, contained boolean")
        out = marked.where("not contained").select("row.*")
    return out


def contained_items(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item it contains: key, ``item_id`` (long), ``item_shingles``,
    ``common_shingles``, ``containment``.

    Items without words are in no document; an item or document of fewer than five words has one
    shingle of all of them. Null and empty documents contain nothing. Rows repeated in either input
    give a row each. Items go to the tasks in blocks of bounded bytes (``block_bytes``), each of
    which is searched for in all documents; nothing is shuffled.
    """
    kind = dict(docs.dtypes)[key]
    found = None
    for sent in _blocks(items, block_bytes, threshold):
        got = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
            _search(sent, threshold), f"key {kind}, item_id long, item_shingles long, common_shingles long"
        )
        found = got if found is None else found.unionAll(got)
    return found.select(F.col("key").alias(key), "item_id", "item_shingles", "common_shingles", (F.col("common_shingles") / F.col("item_shingles")).alias("containment"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with w as (
  select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
  union all
  select 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') from benchmark
), u as (
  select kind, id, unnest(range(len(ws))) as i, unnest(ws) as w from w where len(ws) >= 5
), s as (
  select distinct kind, id, concat_ws(' ', w, lead(w, 1) over t, lead(w, 2) over t, lead(w, 3) over t, lead(w, 4) over t) as sh from u window t as (partition by kind, id order by i) qualify lead(w, 4) over t is not null
  union
  select kind, id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4
), n as (select id, count(*) as item_shingles from s where kind = 'i' group by id)
select d.id as doc_id, i.id as item_id, n.item_shingles, count(*) as common_shingles, count(*) / n.item_shingles as containment
from s d join s i on d.sh = i.sh and d.kind = 'd' and i.kind = 'i' join n on n.id = i.id
group by d.id, i.id, n.item_shingles having count(*) >= ceil(0.8 * n.item_shingles - 1e-9)
"""
