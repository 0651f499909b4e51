"""The panel data model: slices, header order, selection, storage."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import snapshots as snap
from ..functions.text import join_key, split_place
from ..session import stored_at, written
from ..vocab import CURRENT, REGIONS, VERTICALS, VIEWS
from .numbering import number_rows

SLICE = ["vertical", "view", "region", "snapshot"]
#: Stores deal the table families over so many folders, so that files grow with the rows and not with the families.
FOLDER, FOLDERS = "folder", 64
PANEL_COLUMNS = [*SLICE, "rank", "row_no", "place", "city", "subdivision", "country", "metrics", "place_key"]


def as_panel(
    df: DataFrame,
    *,
    label: Column,
    snapshot: Column,
    metrics: Mapping[str, Column],
    rank: Column | None = None,
    row_no: Column | None = None,
    vertical: str = "cost-of-living",
    view: str = "city",
    region: str = "",
) -> DataFrame:
    """Any table with a label and metrics, in the panel schema.

    ``rank`` counts every row of the source table, ``row_no`` only the kept ones;
    they are the same unless a page had unreadable rows.
    """
    entries = [item for name, c in metrics.items() for item in (F.lit(name), c.cast("double"))]
    rank = F.lit(None).cast("int") if rank is None else rank
    parts = split_place(label)
    base = df.select(
        F.lit(vertical).alias("vertical"), F.lit(view).alias("view"), F.lit(region).alias("region"),
        snapshot.alias("snapshot"), rank.cast("int").alias("rank"),
        (rank if row_no is None else row_no).cast("int").alias("row_no"),
        parts.alias("_parts"), F.create_map(*entries).alias("metrics"),
    )
    return base.select(
        *SLICE, "rank", "row_no", "_parts.*", "metrics", join_key(F.col("_parts.place")).alias("place_key")
    )


def with_ranks(panel: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number the rows of every slice; on tables that come without a page order."""
    numbered = number_rows(panel.drop("rank", "row_no"), SLICE, order, "rank")
    return numbered.withColumn("row_no", F.col("rank")).select(*PANEL_COLUMNS)


def select_view(
    panel: DataFrame, vertical: str | None = None, *, by: str = "city", region: str | None = None,
    known: Sequence[str] = tuple(VERTICALS),
) -> DataFrame:
    """All snapshots of one family, view and region; every condition is on a partition column."""
    if by not in VIEWS:
        raise ValueError(f"unknown view '{by}', one of: {', '.join(VIEWS)}")
    conditions = []
    if vertical is not None:
        if vertical not in known:
            raise ValueError(f"unknown index '{vertical}', one of: {', '.join(sorted(known))}")
        conditions.append(F.col("vertical") == vertical)
    view = "country" if by == "country" else "region" if region else "city"
    conditions.append(F.col("view") == view)
    if view == "region":
        conditions.append(F.col("region") == REGIONS.get(region.lower(), region))
    out = panel
    for condition in conditions:
        out = out.filter(condition)
    return out


def select_slice(
    panel: DataFrame,
    vertical: str | None = None,
    *,
    by: str = "city",
    snapshot: str | None = None,
    region: str | None = None,
    known: Sequence[str] = tuple(VERTICALS),
) -> DataFrame:
    """One slice of a stored panel; all conditions are on partition columns."""
    chosen = select_view(panel, vertical, by=by, region=region, known=known)
    return chosen.filter(F.col("snapshot") == (snapshot or CURRENT))


def slice_identity(vertical: Column, view: Column, region: Column, snapshot: Column) -> Column:
    """The one name of a slice: ``current`` and a missing snapshot are the same slice."""
    return F.concat_ws(
        "/", vertical, view, F.when(view == "region", F.coalesce(region, F.lit(""))).otherwise(F.lit("")),
        F.coalesce(snapshot, F.lit(CURRENT)),
    )


def with_table_size(panel: DataFrame, sizes: DataFrame) -> DataFrame:
    """Attach ``of``: how many rows the slice has.  ``sizes`` is already side-checked."""
    return panel.join(sizes, SLICE)


def table_sizes(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*SLICE).agg(F.count(F.lit(1)).cast("int").alias("of"))


def long_panel(panel: DataFrame) -> DataFrame:
    """One row per (slice, place, metric): lets a query read one metric's column."""
    return panel.select(
        *SLICE, "rank", "row_no", "place", "city", "country", "place_key",
        F.explode("metrics").alias("metric", "value"),
    )


def header_columns(long: DataFrame, position: Column) -> DataFrame:
    """``(slice, columns)``: each slice's header in its own order.

    A header has as many entries as the table has columns, so the list is short
    whatever the number of rows.
    """
    first = long.groupBy(*SLICE, "metric").agg(F.min(position).alias("_pos"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "metric")))
    return first.groupBy(*SLICE).agg(F.transform(ordered, lambda e: e["metric"]).alias("columns"))


def published_snapshots(panel: DataFrame) -> DataFrame:
    """Distinct published ids with their period order (``current`` is not an id)."""
    ids = panel.select("vertical", "snapshot").filter(snap.is_snapshot_id(F.col("snapshot"))).distinct()
    key = snap.sort_key(F.col("snapshot"))
    return ids.select("vertical", "snapshot", key["year"].alias("year"), key["half"].alias("half"))


def folder_of(vertical: Column) -> Column:
    """The folder of a table family in a store."""
    return (F.crc32(F.encode(F.coalesce(vertical, F.lit("")), "UTF-8")) % FOLDERS).cast("int")


def write_panel(panel: DataFrame, path: str) -> None:
    """Store a panel; rewriting a slice replaces only that slice.

    A folder holds one snapshot of a view and region, and of the families those that the same
    checksum deals into it; their other slices are carried over when one is rewritten.  The
    rebalance hint groups rows by folder and splits one that is too big for one file, so
    neither tiny files nor one huge writer comes out of it.
    """
    spark, place = panel.sparkSession, ["view", "region", "snapshot", FOLDER]
    rows = panel.select(*PANEL_COLUMNS, folder_of(F.col("vertical")).alias(FOLDER))
    if stored_at(spark, path):
        rows = written(rows)
        # An empty part and a missing one share a folder.
        keys = lambda columns: [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in columns]
        named = [f"_{c}" for c in SLICE]
        slices = rows.select(FOLDER, *keys(SLICE)).distinct()
        stored = _scan_panel(spark, path).select("*", *keys(SLICE))
        met = [FOLDER, *named[1:]]
        others = stored.join(slices.select(*met).distinct(), met, "left_semi").join(slices.drop(FOLDER), named, "left_anti")
        rows = others.select(*rows.columns).unionByName(rows)
    # Dynamic overwrite stages its files, so the folders that are replaced may be read by the same job.
    (
        rows.hint("rebalance", *place)
        .write.partitionBy(*place)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def _scan_panel(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "vertical string, view string, region string, snapshot string, rank int, row_no int, place string, "
        f"city string, subdivision string, country string, metrics map<string,double>, place_key string, {FOLDER} int"
    )
    return spark.read.schema(schema).parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return _scan_panel(spark, path).drop(FOLDER).withColumn("region", F.coalesce("region", F.lit("")))


def write_keyed_panel(panel: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store a panel in buckets by key, one file for each bucket and snapshot.

    Aggregations and joins by key over any of its snapshots then need no exchange.  The table
    is registered under a name made from its path.
    """
    buckets = buckets or max(1, int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (
        panel.select(*PANEL_COLUMNS).repartition(buckets, "place_key")
        .write.partitionBy("snapshot").bucketBy(buckets, "place_key").sortBy("place_key")
        .option("path", path).saveAsTable(_table_of(path))
    )


def _table_of(path: str) -> str:
    return "panel_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def read_keyed_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel of :func:`write_keyed_panel` of this session."""
    return spark.table(_table_of(path))


def write_long_panel(panel: DataFrame, path: str) -> None:
    """Store one row per (place, metric), partitioned down to the metric.

    A map is read whole whatever key is asked for; here a query over one metric
    opens only that metric's files.
    """
    (
        long_panel(panel).hint("rebalance", *SLICE, "metric")
        .write.partitionBy(*SLICE, "metric")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_metrics(spark: SparkSession, path: str, metrics: Sequence[str]) -> DataFrame:
    """A stored long panel as a panel of the named metrics (one metric: no shuffle)."""
    schema = (
        "vertical string, view string, region string, snapshot string, metric string, rank int, row_no int, "
        "place string, city string, country string, place_key string, value double"
    )
    rows = spark.read.schema(schema).parquet(path).withColumn("region", F.coalesce("region", F.lit("")))
    rows = rows.filter(F.col("metric").isin(*metrics))
    entity = [*SLICE, "rank", "row_no", "place", "city", "country", "place_key"]
    if len(metrics) == 1:
        return rows.select(*entity, F.create_map("metric", "value").alias("metrics"))
    entries = F.collect_list(F.struct("metric", "value"))  # at most one per named metric
    return rows.groupBy(*entity).agg(F.map_from_entries(entries).alias("metrics"))
