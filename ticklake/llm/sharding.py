"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets by a seeded hash; the number of buckets follows from
the measured bytes of all columns, so that a bucket fits in one task's memory. Copies of a record
within an input partition are numbered and scatter by number too, so that a record repeated without
end fills no bucket. Pass two puts each bucket into one task, orders it canonically, shuffles it
(Fisher-Yates, seeded by bucket) and emits it. Buckets one after the other are a uniform random order
of all records, and cutting that order into equal runs gives the shards (law ``rows``: shard sizes are
at most one apart).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .shingles import mix

#: Bytes of a bucket: these at least, a 4096th of all up to the largest, so that buckets don't become too many.
BUCKET_BYTES, LARGEST = 24 << 20, 192 << 20
_SCATTER, _AT = "__bucket", "__index"


def _fisher_yates(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        order = whole.column("__order").to_numpy()
        # the order that records arrive in differs from run to run; start from a fixed one
        start = np.argsort(order, kind="stable")
        swaps = np.random.default_rng([seed, int(whole.column(_SCATTER)[0].as_py())])
        swaps.shuffle(start)
        step = max(1, len(start) * (4 << 20) // max(1, whole.nbytes))
        for a in range(0, len(start), step):
            part = whole.take(pa.array(start[a : a + step])).drop_columns(["__order"])
            part = part.append_column(_AT, pa.array(np.arange(a, a + part.num_rows, dtype=np.int64)))
            yield from part.combine_chunks().to_batches()

    return run


def _scattered(seed: int, n_buckets: int):
    """Adds each row's bucket. The first column hashes the row; equal rows of a partition get different
    buckets, the same ones in whatever order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            number = np.empty(len(hashes), np.uint64)
            for k, h in enumerate(hashes.tolist()):
                number[k] = met[h] = met.get(h, -1) + 1
            bucket = mix(hashes + mix(number + np.uint64(seed << 32))) % np.uint64(n_buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int32))], [*batch.schema.names, _SCATTER])

    return run


def shuffle_shards(df: DataFrame, n_shards: int, *, text: str = "text", key: str = "doc_id", seed: int = 17, bucket_bytes: int | None = None) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 .. n_shards - 1) and ``slot`` (gapless from 0).

    Bucket of a row: hash of seed, key and text, so equal texts with other keys scatter too, and of its
    number among rows of one key and text in its input partition. Null keys and texts hash as such. Rows
    equal in key and text are interchangeable and keep all their copies; rows that differ only in
    further columns are put in order by a hash of these. An empty table gives an empty result. Input
    columns named like the added ones are replaced. A task remembers eight bytes and a count a row.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") if k in ("string", "binary") else F.lit(8) for c, k in df.dtypes if c in own), F.lit(1))
    total = df.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    n = total["n"]
    n_buckets = max(1, -(-total["b"] // (bucket_bytes or min(LARGEST, max(BUCKET_BYTES, total["b"] >> 12)))))
    identity = F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("__hash")

    order = F.xxhash64(F.lit(seed + 1), *[F.col(c) for c, k in df.dtypes if c in own and not k.startswith("map")])
    rows = df.select(identity, *own, order.alias("__order"))
    scattered = rows.mapInArrow(_scattered(seed, n_buckets), T.StructType([*rows.schema, T.StructField(_SCATTER, T.IntegerType())]))
    # of whole rows: with fewer columns Spark could deal an earlier shuffle's rows to other partitions
    sizes = scattered.groupBy(_SCATTER).count()  # one row a bucket
    before = Window.orderBy(_SCATTER).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_SCATTER, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    dealt = scattered.drop("__hash").repartitionById(n_buckets, F.col(_SCATTER))
    schema = T.StructType([f for f in dealt.schema if f.name != "__order"] + [T.StructField(_AT, T.LongType())])
    at = F.col("__offset") + F.col(_AT)
    shard = F.expr(f"((`__offset` + `{_AT}` + 1) * {n_shards} - 1) div {max(1, n)}")
    first = F.expr(f"(shard * {n}) div {n_shards}")
    return (
        dealt.mapInArrow(_fisher_yates(seed), schema).join(F.broadcast(offsets), _SCATTER)  # no second shuffle of whole rows
        .withColumn("shard", shard.cast("int")).withColumn("slot", at - first).select(*own, "shard", "slot")
    )


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> None:
    """The second pass's output as one folder of Parquet files a shard, in slot order."""
    out = shuffle_shards(df, n_shards, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
