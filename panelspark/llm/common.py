"""Tables, written intermediate results and Arrow batches, as every operator here uses them."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Text that is held as Python objects at a time, in bytes.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a session without one (tests) gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Whether shuffle files go as soon as the query that wrote them has ended; else they stay until the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, readable after an executor is lost.

    Nothing reads the shuffles behind it again, so they go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``store`` has written, when all that is made of them is stored too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept_by_worker(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the last thing that was asked for.

    Functions sent by value get new globals with each task, so a cache that shall
    outlive the task lives in a module of its own.  Workers outlive a job as well, so what
    an earlier step or run has kept goes before another step makes its own.
    """
    holder = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__
    kept = holder.setdefault("kept", {})
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``limit`` bytes of ``column``; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema for a plain ``name type, ...`` list."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(),
             "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32()), "array<short>": pa.list_(pa.int16()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


#: Ids up to this number (8 MB) are sent to all executors; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone`` (one column, doc_id); rows without an id stay."""
    gone = store(gone.filter("doc_id IS NOT NULL").distinct().withColumnRenamed("doc_id", "_gone"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
