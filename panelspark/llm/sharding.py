"""Shards of equal row counts that all show the mixture of the sources.

Rows are shuffled within their source by a seeded hash, get the fractional rank
(rank + 1/2) / rows of the source, and are cut into runs along that rank, so every
shard takes an even share of every source.

No source is sorted in one task: the hash, and later the fractional rank, deals rows
into buckets of about BUCKET_ROWS, and counts of buckets place each bucket behind the
ones before it.

Nulls, empties and odd input: a null source is a source of its own; a null text counts no
bytes and has the checksum of an empty one; rows without a doc_id and repeated rows are
rows like any other; an empty table gives an empty table; fewer rows than shards leave
shards empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.common import store

#: Rows that one bucket holds on average.
BUCKET_ROWS = 20_000


def _offsets(rows: DataFrame, bucket: str, within: list[str]) -> DataFrame:
    """(within..., bucket, before): rows of the buckets before, within ``within``."""
    counts = rows.groupBy(*within, bucket).agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*within).orderBy(bucket))
    return counts.withColumn("_before", running - F.col("_n")).drop("_n")


def interleave(docs: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, source, shard, slot): every row of ``docs`` in one of ``shards`` shards."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.concat(F.lit("s"), "source").alias("_named"), (F.length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), shuffled.alias("_order"),
    ).withColumn("_stratum", F.coalesce("_named", F.lit("n"))).drop("_named")
    base = store(base, "shard-rows")
    total = base.count()
    buckets = total // bucket_rows + 1
    unit = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    base = base.withColumn("_bucket", F.floor(unit * buckets))

    order = ["_order", "doc_id", "text_crc32", "size"]
    here = F.row_number().over(Window.partitionBy("_stratum", "_bucket").orderBy(*order))
    sizes = base.groupBy("_stratum").agg(F.count("*").alias("_rows"))
    placed = _offsets(base, "_bucket", ["_stratum"]).join(sizes, "_stratum")
    ranked = base.withColumn("_here", here).join(placed, ["_stratum", "_bucket"])
    share = (F.col("_before") + F.col("_here") - 0.5) / F.col("_rows")
    ranked = store(ranked.select("doc_id", "source", "size", "text_crc32", "_stratum", "_order",
                                 share.alias("_share")).withColumn("_run", F.floor(F.col("_share") * buckets)),
                   "shard-ranks")

    along = ["_share", "_stratum", *order]
    runs = ranked.groupBy("_run").agg(F.count("*").alias("_n"))
    # One row for each run of about bucket_rows rows.
    before = runs.select("_run", (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).alias("_before"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_run").orderBy(*along)) - 1
    placed = ranked.join(before, "_run").withColumn("_at", at)
    return placed.withColumn("shard", F.expr(f"_at * {shards} div {max(1, total)}").cast("int")).select(
        "doc_id", "size", "text_crc32", "source", "shard",
        (F.col("_at") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).alias("slot"))
