"""CSV and JSON out: declared columns always written, unknowns stay unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import control_ratio


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Declared columns only, in order; NULL is an empty field, and so is nothing else.

    A column the table lacks is written empty rather than dropped.  A table without rows
    is refused: its file would be a header that looks like an answer.
    """
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}: the table has no rows")
    have = set(df.columns)
    chosen = [F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*chosen).write.option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """NULL fields are written, never dropped."""
    df.write.option("ignoreNullFields", "false").json(path)


def comparison_rows(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flat rows of a price comparison; an empty list of missing parts is NULL."""
    have = set(records.columns)
    local = F.col("control_local") if "control_local" in have else F.lit(None).cast("double")
    values = [F.try_element_at(F.col("values"), F.lit(k)).alias(k) for k in keys]
    missing = F.nullif(F.concat_ws(";", "missing"), F.lit(""))
    return records.select(
        F.col("entity").alias("slug"), F.nullif(F.col("country"), F.lit("")).alias("country"), *values,
        "budget", "savings", "rent_to_income_pct", local.alias("control_local"),
        F.round(control_ratio(F.col("budget"), local), 3).alias("ratio"), missing.alias("missing"),
    )


def flat_columns(keys: Sequence[str]) -> list[str]:
    """The declared columns of a flat comparison."""
    return [
        "slug", "country", *keys, "budget", "savings", "rent_to_income_pct", "control_local", "ratio", "missing",
    ]
