"""Exact token counts from one histogram of encoded lengths.

Documents are encoded where they lie; only (length, documents) pairs are shuffled. Suffix sums over
the distinct lengths then answer, for every context limit, how many documents and tokens lie at or
above it and how many tokens are left when documents are cut at it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

_encoders: dict = {}


def _encoder(path: str, pattern: str):
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encoded_lengths(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """One row ``n_tokens`` (long) for each row of ``df``. Null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_tokens"])

    return df.select(F.col(text).cast("string")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: ``n_docs`` of this length, ``docs_from`` and
    ``tokens_from`` (documents of this length or more, and their tokens), ``truncated_total`` (tokens
    left when every document is cut at this length) and ``quantile`` (share of documents of this
    length or less). The window runs over distinct lengths, never over documents; no row, no result.
    """
    hist = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    suffix = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.col("n_docs") * F.col("n_tokens")
    everything = Window.partitionBy()
    sums = hist.select(
        "n_tokens", "n_docs", F.sum("n_docs").over(suffix).alias("docs_from"), F.sum(tokens).over(suffix).alias("tokens_from"),
        F.sum("n_docs").over(everything).alias("all_docs"), F.sum(tokens).over(everything).alias("all_tokens"),
    )
    return sums.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def limit_report(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for stated limits, none of which needs to occur as a length."""
    spark = histogram.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context_limit long"))
    n, docs = F.col("n_tokens"), F.col("n_docs")
    over = n > F.col("context_limit")
    return histogram.join(wanted).groupBy("context_limit").agg(
        F.sum(docs * F.least(n, "context_limit")).alias("truncated_total"), F.sum(F.when(over, docs).otherwise(0)).alias("docs_cut"),
        F.sum(F.when(over, docs * (n - F.col("context_limit"))).otherwise(0)).alias("tokens_cut"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return length_histogram(encoded_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
