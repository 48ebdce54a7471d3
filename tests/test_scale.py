"""Steps whose cost must not outgrow the input."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from ticklake.llm.sharding import shuffle_shards
from ticklake.plans import captures
from ticklake.sources import events, records, tables, wire
from ticklake.sources.tables import tape


def plan_of(df) -> str:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_shards_move_rows_once(spark):
    """Offsets of buckets go to the rows, however large these are."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = shuffle_shards(docs, 4, bucket_bytes=4000)
        assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
        sizes = {r.shard: r.n for r in out.groupBy("shard").agg(F.count_distinct("slot").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes == dict.fromkeys(range(4), 75)


def test_small_parts_share_tasks(spark, tmp_path):
    body = b'{"a":"' + b"x" * 4000 + b'"}'
    (tmp_path / "a.rec").write_bytes((len(body).to_bytes(4, "little") + body) * 1000)
    got = records.read_length_prefixed(spark, str(tmp_path), part_bytes=32 << 10)
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert got.select(F.count_distinct("index"), F.min(F.length("value"))).first()[:] == (1000, len(body))


def test_layout_grows_with_the_tape(spark, sf_dir, tmp_path):
    assert captures._layout(spark, sf_dir) == (captures.FILE_BYTES, captures.PART_BYTES)
    spark.range(12 * captures.EVENTS).toDF("event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert captures._layout(spark, str(tmp_path)) == (12 * captures.FILE_BYTES, 12 * captures.PART_BYTES)


def test_values_are_scaled_as_their_lexemes(spark):
    rows = [(lo, hi, scale) for lo in (0, 7, -1, 10012, 999_999_999, 10**9, 10**17 + 3, 10**18 + 5, None) for hi in (0, -1, None) for scale in (0, 2, 9, 11)]
    df = spark.createDataFrame(rows, "lo long, hi long, scale int").select(F.struct(F.struct(F.col("lo").cast("decimal(20,0)").alias("coefficient_lo"), F.col("hi").alias("coefficient_hi"), "scale").alias("value")).alias("f"))
    plain = events.parse_decimal(events.fixed_text(F.col("f")))
    fits = df.select("f", plain.alias("p")).where("p is null or abs(p) < 1000000000")
    bad = fits.where(~events.fixed_value(F.col("f")).eqNullSafe(F.col("p").cast("decimal(18,9)")))
    assert fits.count() > 40 and bad.count() == 0
    none = F.lit(None).cast(df.schema["f"].dataType)
    assert df.select(events.fixed_value(F.when(F.col("f").isNull(), F.col("f")).otherwise(none)).alias("x")).where("x is not null").isEmpty()


def test_absent_fields_are_not_needed(spark, sf_dir):
    bare = captures.envelopes(tape(spark, sf_dir))
    assert wire.to_protobuf(bare, ("frame_seq",)).exceptAll(wire.to_protobuf(wire.conforming(bare), ("frame_seq",))).isEmpty()
    raw = wire.to_protobuf(bare)
    whole, some = (events.tape_rows(wire.from_protobuf(raw, **o)) for o in ({}, {"kinds": ("trade", "quote")}))
    assert some.exceptAll(whole).isEmpty() and some.count() == whole.count() > 0
    assert set(r.kind for r in wire.from_protobuf(raw, kinds=("quote",)).select("kind").distinct().collect()) == {"quote", None}


def test_levels_are_summed_in_tasks_of_bounded_rows(spark, sf_dir, monkeypatch, oracle, rows_of):
    """As many tasks as the rows ask for, and no task holds the sums of a whole split."""
    monkeypatch.setattr(tables, "LEVEL_ROWS", 100, raising=False)
    levels = tables.book_levels(spark, sf_dir)
    assert plan_of(levels).count("Exchange") == 1 and "partial_sum" not in plan_of(levels).split("Exchange")[1]
    n = tables.read_table(spark, sf_dir, "lineitem").count()
    assert levels.rdd.getNumPartitions() == max(8, -(-n // 100)) > 8
    assert rows_of(levels) == [tuple(r) for r in oracle(f"with {tables.SQL['book']} select * from book", sf_dir)]
