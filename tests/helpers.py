"""Small hand-made panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.text import join_key, split_place

SCHEMA = "vertical string, view string, region string, snapshot string, rank int, label string, metrics map<string,double>"


def panel(spark, tables: dict[str, list[tuple]], vertical: str = "crime"):
    """``{snapshot: [(label, {metric: value}), ...]}`` in page order."""
    rows = [
        (vertical, "city", "", snapshot, i, label, metrics)
        for snapshot, entries in tables.items() for i, (label, metrics) in enumerate(entries, 1)
    ]
    parts = spark.createDataFrame(rows, SCHEMA).withColumn("p", split_place(F.col("label")))
    return parts.select(
        "vertical", "view", "region", "snapshot", "rank", F.col("rank").alias("row_no"), "p.*", "metrics",
        join_key(F.col("p.place")).alias("place_key"),
    )


def sides(spark, before: list[tuple], after: list[tuple]):
    both = panel(spark, {"2019": before, "current": after})
    return both.filter("snapshot = '2019'"), both.filter("snapshot = 'current'")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def column(df, name):
    return [r[name] for r in df.collect()]
