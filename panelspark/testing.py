"""Helpers shared by tests, the side-by-side check and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def local_session(cores: str | None = None, memory: str = "8g") -> SparkSession:
    cpus = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("panelspark")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Small tables still spread over the local cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in a fixed order, numbers in one notation."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value: object) -> str:
        if value is None:
            return "~"
        if isinstance(value, bool):
            return str(value)
        if isinstance(value, (int, float)):
            return repr(float(value) + 0.0)
        return str(value)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)
