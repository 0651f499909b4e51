"""Baskets, best marks, and the independent control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as num
from ..session import one_row, written
from ..vocab import (
    ANOMALY_HIGH, ANOMALY_LOW, ANOMALY_MIN_SAMPLE, BASKET, HIGHER_IS_BETTER,
)
from .medians import exact_medians


def with_budget(records: DataFrame, basket: Sequence[tuple[str, int]] = BASKET) -> DataFrame:
    """Adds total, parts, missing, savings and rent share to price records."""
    values = F.col("values")
    total = F.round(num.monthly_budget(values, basket), 2)
    return records.withColumns({
        "parts": num.basket_parts(values, basket),
        "missing": num.basket_missing(values, basket),
        "budget": total,
        "savings": num.savings(values, total),
        "rent_to_income_pct": num.rent_share(values),
    })


def budget_order() -> list[Column]:
    """Cheapest first, unknown budgets last."""
    return [F.col("budget").asc_nulls_last(), F.col("entity")]


def best_of(long: DataFrame) -> DataFrame:
    """``(metric, best)`` over known values; NULL below two of them.

    One row per metric, so the result has the size of the metric vocabulary.
    """
    higher = F.col("metric").isin(*HIGHER_IS_BETTER)
    return long.groupBy("metric").agg(
        F.count("value").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")
    ).select(
        "metric",
        F.when(F.col("_n") >= 2, F.when(higher, F.col("_high")).otherwise(F.col("_low"))).alias("best"),
    )


def mark_best(long: DataFrame) -> DataFrame:
    """Adds ``is_best`` to ``(entity, metric, value)`` rows, which are worked out once."""
    long = written(long)
    return long.join(best_of(long), "metric").withColumn(
        "is_best", F.coalesce(F.col("value") == F.col("best"), F.lit(False))
    )


def long_figures(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(entity, metric, value)``: the chosen item keys and the three derived rows."""
    entries = [
        F.struct(F.lit(k).alias("metric"), F.try_element_at(F.col("values"), F.lit(k)).alias("value")) for k in keys
    ]
    derived = {"budget": "budget", "rent_to_income": "rent_to_income_pct", "monthly_savings": "savings"}
    entries += [F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in derived.items()]
    return records.select("entity", F.inline(F.array(*entries)))


def with_control(records: DataFrame, control: DataFrame) -> DataFrame:
    """Left join of the independent figure; zero or missing stays NULL beside ours."""
    local = control.select("entity", F.nullif("local", F.lit(0.0)).alias("control_local"))
    return records.join(local, "entity", "left").withColumn(
        "ratio_exact", num.control_ratio(F.col("budget"), F.col("control_local"))
    ).withColumn("ratio", F.round("ratio_exact", 3))


def ratio_anomalies(ratios: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Entities whose ratio strays from the group median.

    Fewer than three known ratios, or a median of zero, give no verdict at all.
    The ratios are fixed first: the median and the test both read them.
    """
    known = written(ratios.select(*groups, "entity", "ratio_exact").filter("ratio_exact IS NOT NULL"))
    medians = exact_medians(known, groups, "ratio_exact", "median_ratio")
    usable = medians.filter((F.col("n") >= ANOMALY_MIN_SAMPLE) & (F.col("median_ratio") != 0)).drop("n")
    joined = known.join(usable, list(groups)) if groups else known.crossJoin(one_row(usable))
    deviation = F.try_divide(F.col("ratio_exact"), F.col("median_ratio"))
    return joined.withColumn("_dev", deviation).filter(
        ~F.col("_dev").between(ANOMALY_LOW, ANOMALY_HIGH)
    ).select(*groups, "entity", "ratio_exact", "median_ratio", F.round("_dev", 3).alias("deviation"))
