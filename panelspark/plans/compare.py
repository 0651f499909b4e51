"""What does each entity cost, itemised, side by side?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import budgets, items as item_ops
from ..vocab import BASKET, DEFAULT_ITEM_KEYS, ITEM_KEYS


def display_keys(full: bool = False) -> list[str]:
    return list(ITEM_KEYS if full else DEFAULT_ITEM_KEYS)


def compare(
    items: DataFrame,
    *,
    pages: DataFrame | None = None,
    errors: DataFrame | None = None,
    control: DataFrame | None = None,
    units: str = "metric",
    basket: Sequence[tuple[str, int]] = BASKET,
) -> DataFrame:
    """One record per entity with budget, savings and rent share.

    Entities that could not be read stay as rows with an error and no figures; with ``pages``
    (``sources.pages.price_page_facts``) so do good pages without a price, without an error.
    """
    records = item_ops.price_records(items, pages=pages, units=units)
    if errors is not None:
        records = records.unionByName(errors, allowMissingColumns=True)
    out = budgets.with_budget(records, basket)
    return out if control is None else budgets.with_control(out, control)


def side_by_side(records: DataFrame, entities: Sequence[str], *, full: bool = False) -> DataFrame:
    """Metrics as rows, the named entities as columns, the cheapest first and unknown budgets last."""
    chosen = records.filter(F.col("entity").isin(*entities))
    # As many rows as entities were named; the order of columns has to be known before the plan is.
    known = [row["entity"] for row in chosen.groupBy("entity").agg(F.min("budget").alias("budget")).orderBy(
        *budgets.budget_order()).collect()]
    names = [*known, *(name for name in dict.fromkeys(entities) if name not in known)]
    long = budgets.long_figures(chosen, display_keys(full))
    return long.groupBy("metric").pivot("entity", names).agg(F.max("value"))


def run_status(records: DataFrame) -> DataFrame:
    """One row: 1 when every entity failed (or there was none), else 0."""
    ok = F.count_if(F.col("error").isNull()) if "error" in records.columns else F.count(F.lit(1))
    return records.agg(F.when(ok > 0, 0).otherwise(1).alias("status"))
