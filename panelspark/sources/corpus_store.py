"""The stored corpus: one row for each slice of the panel, dealt into folders by table family.

A row says what the slice's page held: its header in page order, the digest and the number of its
rows, when it was read and stored, and whether it may be kept for good.  Writing replaces the rows of
the slices that are written and carries the others of the same folders over, so that a family lies in
one file (or a few large ones) whatever the number of its slices; and as the number of folders is fixed,
many small families share a file instead of having one each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.panels import FOLDER, SLICE, folder_of
from ..session import stored_at

CORPUS_SCHEMA = (
    "vertical string, view string, region string, snapshot string, schema_tag string, fetched_at timestamp, "
    "written_at timestamp, bytes bigint, readable boolean, moved boolean, keep boolean, fingerprint string, n_rows int, "
    "columns array<string>"
)
COLUMNS = [part.strip().split(" ")[0] for part in CORPUS_SCHEMA.split(",")]
ENTRY = SLICE


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Stored entries with their folder."""
    schema = f"{CORPUS_SCHEMA}, {FOLDER} int"
    if not stored_at(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Stored entries; ``file_mtime`` is when an entry was stored, which an audit compares with its own clock."""
    return _scan(spark, path).drop(FOLDER).withColumn("file_mtime", F.col("written_at"))


def _write(rows: DataFrame, path: str) -> None:
    # Dynamic overwrite stages its files, so the folders that are replaced may be read by the same job.
    (
        rows.select(*COLUMNS, FOLDER).hint("rebalance", FOLDER)
        .write.partitionBy(FOLDER).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    )


def write_entries(entries: DataFrame, path: str) -> None:
    """Replace exactly the slices that are being written; only their folders are read and rewritten."""
    fresh = entries.select(*COLUMNS, folder_of(F.col("vertical")).alias(FOLDER))
    stored = _scan(entries.sparkSession, path)
    others = stored.join(fresh.select(FOLDER).distinct(), FOLDER, "left_semi")
    key = [F.coalesce(c, F.lit("")).alias(c) for c in ENTRY]
    others = others.withColumn("_key", F.struct(*key)).join(
        fresh.select(F.struct(*key).alias("_key")).distinct(), "_key", "left_anti")
    _write(others.unionByName(fresh, allowMissingColumns=True), path)


def remove_entries(spark: SparkSession, path: str, gone: Column) -> None:
    """Take the entries that meet ``gone`` out of the store; folders without one are not touched.

    A folder that loses its last entry goes itself, since an overwrite without rows replaces nothing.
    """
    found = _scan(spark, path).withColumn("file_mtime", F.col("written_at")).withColumn("_gone", F.coalesce(gone, F.lit(False))).withColumn(
        "_place", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))
    touched = found.groupBy(FOLDER).agg(
        F.bool_or("_gone").alias("touched"), F.bool_and("_gone").alias("empty"), F.collect_set("_place").alias("places")
    ).filter("touched")
    # FOLDERS rows at most.
    folders = touched.collect()
    rest = [row[FOLDER] for row in folders if not row["empty"]]
    if rest:
        _write(found.filter(F.col(FOLDER).isin(*rest) & ~F.col("_gone")), path)
    for place in {place for row in folders if row["empty"] for place in row["places"]}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(place))
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored_count(spark: SparkSession, path: str, written: DataFrame, schema_tag: str) -> DataFrame:
    """Read-back: how many of the written entries are found under the current schema."""
    found = scan_corpus(spark, path).filter(F.col("schema_tag") == schema_tag).filter("readable").select(*ENTRY)
    return written.select(*ENTRY).join(found, ENTRY, "left_semi").agg(F.count(F.lit(1)).alias("stored"))


def alive(corpus: DataFrame) -> DataFrame:
    """Entries whose slice holds rows."""
    return corpus.filter("readable AND n_rows > 0")


def backed_rows(panel: DataFrame, corpus: DataFrame) -> DataFrame:
    """Panel rows whose corpus entry still holds rows; the entries prune the panel's partitions at run time.

    A page that came back empty replaces its entry but has no rows to replace the
    stored slice with; reading through the entry leaves such a slice out.
    """
    return panel.join(alive(corpus).select(*ENTRY), ENTRY, "left_semi")
