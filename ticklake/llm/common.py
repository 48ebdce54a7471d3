"""What the training-data operators share: the shared scratch folder and text rules."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space and word rule of the near-duplicate, quality and benchmark operators (fixed values).
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Bytes of an Arrow batch where the session says nothing else. An executor and its Python workers hold
#: batches of each running task twice, so the usual 64 MB take much of a small executor.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_written: dict[str, list[str]] = defaultdict(list)
_scope = [""]


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set(BATCH, spark.conf.get(BATCH, str(BATCH_BYTES)))  # what the session has set stays


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``. Only where it is unset and driver
    and executors are one process, as in tests, a temporary folder is made and set."""
    _bound_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ticklake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and a
    lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/ticklake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[_scope[-1]].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(name: str) -> Iterator[None]:
    """What is written inside belongs to ``name``."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def drop_written(spark: SparkSession, scope: str) -> None:
    """Delete a scope's tables. Call it when no DataFrame over them is needed any more."""
    for name in _written.pop(scope, []):
        drop_path(spark, name)


def drop_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows at most, where they are turned into Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
