"""How do all entities rank in one snapshot?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.headers import sort_column
from ..operators.places import find_place
from ..vocab import HIGHER_IS_BETTER


@dataclass(frozen=True)
class Ranking:
    rows: DataFrame
    columns: list[str]
    shown: list[str]
    sorted_by: str | None
    note: str | None

    def flat(self) -> DataFrame:
        """CSV shape: rank, place and every metric as its own column."""
        metrics = [F.try_element_at("metrics", F.lit(c)).alias(c) for c in self.columns]
        return self.rows.select("rank", "place", "city", "country", *metrics)

    def display(self) -> DataFrame:
        metrics = [F.try_element_at("metrics", F.lit(c)).alias(c) for c in self.shown]
        return self.rows.select("rank", "place", *metrics)


def rank_order(column: str) -> list[Column]:
    """Unknown last, the good end first, ties in page order."""
    value = F.try_element_at("metrics", F.lit(column))
    figure = value.desc_nulls_last() if column in HIGHER_IS_BETTER else value.asc_nulls_last()
    return [figure, F.col("row_no")]


def rank(
    table: DataFrame,
    columns: Sequence[str],
    *,
    match: str | None = None,
    sort: str | None = None,
    top: int | None = None,
    full: bool = False,
) -> Ranking:
    """Rank one slice.  An unknown sort column is noted, and page order is kept."""
    rows = find_place(table, match, raw_fallback=True) if match else table
    by = sort_column(columns, sort) if sort else None
    note = f"no column matched '{sort}'; available: {list(columns)}" if sort and by is None else None
    rows = rows.orderBy(*(rank_order(by) if by else [F.col("row_no")]))
    if top:
        rows = rows.limit(top)
    shown = list(columns) if full else list(columns[:3])
    return Ranking(rows, list(columns), shown, by, note)
