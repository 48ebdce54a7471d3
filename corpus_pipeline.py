"""A training corpus from raw documents: toxic documents go, repeated lines go, one document of each
near-duplicate group stays, documents that hold benchmark items go, and the rest is encoded.

Stages keep all columns of their input, whatever their names. Null and empty texts pass every stage (a
null text scores as an empty one, has one empty line, no shingle and no item, and encodes to the begin
and end ids); rows without an id pass too. Repeated rows stay or go together, except that near_dup keeps
all rows of the document it keeps. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import drop_path, drop_written, scratch_root, scratch_scope, table, written
from ticklake.llm.decontamination import without_items
from ticklake.llm.filters import filter_of, members
from ticklake.llm.line_dedup import dedup_lines
from ticklake.llm.near_dup import near_duplicates
from ticklake.llm.piece_encoding import encode_texts
from ticklake.llm.toxicity import fit, score, training_rows

#: SQL can express neither the trained stage nor the encoding one.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """All columns but the text as one, beside id and text: no operator's column meets one of theirs."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "doc_id", "text")


def _unpacked(rows: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    new = {"text": F.col("text"), **new}
    return rows.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in like.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones outside the held-out fold, lets pass; all of
    them where there are no labels of both classes."""
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return _unpacked(score(_packed(docs), model).where("predicted = 0"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller document holds; all documents stay."""
    out = dedup_lines(_packed(docs))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("doc")["n_chars"])
    return _unpacked(out, docs, text=F.col("kept_text"), n_chars=n_chars)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of pairs that share 80 % of their shingles. Rows without an id stay.

    The list of the others can outgrow a broadcast, so a Bloom filter of it parts the rows: those outside stay
    where they are, and only those inside are shuffled, to be told from the list itself."""
    others = near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    others = written(others.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("other")), "others")
    packed = filter_of(others, "h")
    rows = docs.select(F.xxhash64("doc_id").alias("h"), F.struct(*docs.columns).alias("doc"))
    stay, asked = (rows.mapInArrow(members(packed, inside), rows.schema) for inside in (False, True))
    asked = asked.join(others, (asked["h"] == others["h"]) & (asked["doc.doc_id"] == others["other"]), "left_anti")
    return stay.unionAll(asked).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: under four fifths of each one's shingles."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document: its ids, how many there are, and hashes of them and of the decoded text."""
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


def _staged(stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage before this one has been written by now: its scratch tables can go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_written(spark, "pipeline")
        with scratch_scope("pipeline"):
            return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _staged(f)) for f in (toxicity, line_dedup, near_dup, decontamination, encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                drop_path(spark, before)
            before = path
    return docs
