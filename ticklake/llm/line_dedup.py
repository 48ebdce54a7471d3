"""Line deduplication with two Bloom filters.

Every task notes the line keys of its documents in a filter of keys seen once and a filter of keys
seen in a second document; the merged second filter goes to every task. Only the lines that it
suspects are shuffled, as 128-bit digests, to confirm them exactly and to choose the smallest
document. Where one filter of bounded size has no room for all lines, digests go to ranges of keys
with two filters each, and only those that these suspect are confirmed.

The confirmed lines that most documents hold, ``HOT`` at most, go to every task with their first
document. A document that loses other lines too is shuffled to the list of these; no other text moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, pieces, table, written
from .filters import NOTED, bits_for, filter_of, fits, gathered, has, members, noting, outside, screened

SPACES = SPACE_BYTES.decode()
UPPER = {i: i + 32 for i in range(65, 91)}
LEAST = 10
HOT = 1 << 17


def line_key(line: str) -> str:
    line = line.strip(SPACES)
    return line.lower() if line.isascii() else line.translate(UPPER)


def _digests(text: str | None, least: int) -> list[bytes | None]:
    """For each line its key's digest, None where the key is short."""
    digest = xxhash.xxh3_128_digest
    if text and text.isascii():  # as bytes at once
        return [digest(k) if len(k := x.strip(SPACE_BYTES)) >= least else None for x in text.lower().encode().split(b"\n")]
    return [digest(k.encode()) if len(k := line_key(x)) >= least else None for x in (text or "").split("\n")]


def _keys(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of each text as rows of two numbers, and how many each text has."""
    own = [{d for d in _digests(t, least) if d} for t in texts.to_pylist()]
    return np.frombuffer(b"".join([b"".join(x) for x in own]), "<u8").reshape(-1, 2), np.array([len(x) for x in own], np.int64)


def _suspects(packed, least: int):
    """(r1, r2, key, text) -> a row for each different line, or each that a filter suspects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4000):
            keys, n = _keys(batch.column(3), least)
            hit = has(packed.value, keys) if packed else np.ones(len(keys), bool)
            who = pa.array(np.repeat(np.arange(len(n)), n)[hit])
            lines = [pa.array(np.ascontiguousarray(keys[hit, k]).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(who) for k in range(3)), *lines], ["r1", "r2", "key", "l1", "l2"])

    return run


def _find(l1: np.ndarray, l2: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in lists sorted by both numbers, -1 for none."""
    at = np.searchsorted(l1, keys[:, 0])
    out = np.full(len(keys), -1)
    open_ = np.arange(len(keys))
    while len(open_):  # more than once only where lines share their first number
        here = at[open_]
        inside = here < len(l1)
        open_, here = open_[inside], here[inside]
        same = l1[here] == keys[open_, 0]
        open_, here = open_[same], here[same]
        hit = l2[here] == keys[open_, 1]
        out[open_[hit]] = here[hit]
        open_ = open_[~hit]
        at[open_] += 1
    return out


def _rewrite(least: int, told):
    """(row, key, text, others): ``told`` gives the keys of many documents, sorted, with their first
    document, others the further lines to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        l1, l2, first = told.value
        for batch in pieces(batches):
            n, dropped, kept = [], [], []
            texts = batch.column(2).to_pylist()
            own = [_digests(t, least) for t in texts]
            long = [[k for k, d in enumerate(x) if d] for x in own]
            found = _find(l1, l2, np.frombuffer(b"".join(x[k] for x, y in zip(own, long) for k in y), "<u8").reshape(-1, 2)).tolist()
            at = 0
            for key, text, digests, places, others in zip(batch.column(1).to_pylist(), texts, own, long, batch.column(3).to_pylist()):
                gone = {k for k, f in zip(places, found[at : at + len(places)]) if f >= 0 and (key is None or first[f] != key)}
                at += len(places)
                if others:
                    more = {np.array([x["l1"], x["l2"]], "<i8").tobytes() for x in others}
                    gone.update(k for k in places if digests[k] in more)
                lines = (text or "").split("\n") if gone else None
                n.append(len(digests))
                dropped.append(len(gone))
                # a text that loses nothing stays as it is (null too); one that loses all lines is empty
                kept.append("\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_dropped", "kept_text"])

    return run


def repeated_filter(docs: DataFrame, *, text: str, least: int, n_bits: int) -> np.ndarray:
    """The second filter, packed, of all lines of ``docs``."""
    return gathered(docs.select(F.col(text).cast("string")).mapInArrow(noting(lambda b: _keys(b.column(0), least)[0], n_bits), NOTED), n_bits, "twice")


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, bits: int | None = None, hot: int = HOT) -> DataFrame:
    """Every row of ``docs`` with its columns and ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lowered. Keys of
    at least ``least`` characters that two documents hold lose all their lines but in the document
    with the smallest key column. Rows with the same key column are one document; a null one counts
    as larger than all others. Null and empty texts have one empty line and stay as they are. Input
    columns named like the added ones are replaced. bits: of each filter, a power of two; by default
    it follows from the number of lines, which also decides whether one filter of all lines is sent to
    tasks or lines are sent to filters of ranges. hot: lines that all tasks are told of at most.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    kind = dict(docs.dtypes)[key]
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    if bits is None:
        breaks = F.octet_length("text").cast("long") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
        n_lines = plain.agg(F.coalesce(F.sum(breaks + 1), F.lit(0)).alias("n")).first()["n"]
        bits = bits_for(n_lines) if fits(n_lines) else None
    packed = spark.sparkContext.broadcast(repeated_filter(plain, text="text", least=least, n_bits=bits)) if bits else None
    r1, r2 = F.xxhash64("key", "text"), F.xxhash64(F.lit(1), "text", "key")
    suspects = plain.select(r1.alias("r1"), r2.alias("r2"), "key", "text").mapInArrow(_suspects(packed, least), f"r1 long, r2 long, key {kind}, l1 long, l2 long")
    suspects = written(suspects if bits else screened(suspects, lambda batch: batch.column("l1").to_numpy(), n_lines), "lines")
    held = suspects.groupBy("l1", "l2").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max(F.col("key").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"))
    kept = written(held.where((F.col("first") != F.col("last")) | (F.col("first").isNotNull() & F.col("nulls"))).select("l1", "l2", "first", "n"), "kept")
    # lines by how many hold them, in steps of a sixteenth of a power of two
    step = F.floor(16 * F.log2("n")).cast("int")
    sizes = sorted(((r["step"], r["lines"]) for r in kept.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("lines")).collect()), reverse=True)
    least_step, n_told = 1 << 20, 0
    for k, n in sizes:
        if n_told + n > hot:
            break
        least_step, n_told = k, n_told + n
    top = kept.where(step >= least_step).select("l1", "l2", "first").toArrow()
    l1, l2 = (top.column(c).to_numpy().view(np.uint64) for c in ("l1", "l2"))
    order = np.lexsort((l2, l1))
    told = spark.sparkContext.broadcast((l1[order], l2[order], top.column("first").take(pa.array(order)).to_pylist()))

    row = docs.select(F.struct(*own).alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    row_type = row.schema["row"].dataType.simpleString()
    schema = f"row {row_type}, n_lines long, n_dropped long, kept_text string"
    none = F.lit(None).cast("array<struct<l1:bigint,l2:bigint>>").alias("others")
    columns = ["row.*", "n_lines", "n_dropped", "kept_text"]
    if n_told == sum(n for _, n in sizes):
        return row.select("row", "key", "text", none).mapInArrow(_rewrite(least, told), schema).select(*columns)
    lost = suspects.join(kept.where(step < least_step), ["l1", "l2"]).where(F.col("key").isNull() | (F.col("key") != F.col("first")))
    others = written(lost.groupBy("r1", "r2").agg(F.collect_set(F.struct("l1", "l2")).alias("others")), "others")
    hit = filter_of(others, "r1")
    named = row.select(r1.alias("r1"), r2.alias("r2"), "row", "key", "text")
    kinds = f"r1 long, r2 long, row {row_type}, key {kind}, text string"
    joined = named.mapInArrow(members(hit), kinds).join(others, ["r1", "r2"], "left").select("row", "key", "text", "others")
    rest = named.select("r1", "row", "key", "text").mapInArrow(outside(hit, _rewrite(least, told)), schema)
    return joined.mapInArrow(_rewrite(least, told), schema).unionAll(rest).select(*columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with s as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), l as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from s
), k as (
  select doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), g as (
  select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), m as (
  select k.*, g.first is not null and k.doc_id <> g.first as gone from k left join g using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
