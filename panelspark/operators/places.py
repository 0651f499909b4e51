"""Finding a place: every hit of the best tier, and no silent choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import norm_label
from ..session import one_row


def match_tier(needle: str, *, raw_fallback: bool = False) -> Column:
    """1 whole label, 2 city, 3 part of the label, 4 part of the raw label; NULL otherwise."""
    want = norm_label(F.lit(needle))
    tier = (
        F.when(F.col("place_key") == want, 1)
        .when(norm_label(F.col("city")) == want, 2)
        .when(F.contains(F.col("place_key"), want), 3)
    )
    tier = F.when(want != "", tier)
    if raw_fallback:
        raw = F.when(F.contains(F.lower("place"), F.lit(needle.lower())), 4)
        tier = F.coalesce(tier, raw)
    return tier


def find_place(
    table: DataFrame, needle: str, *, slices: Sequence[str] = (), raw_fallback: bool = False
) -> DataFrame:
    """All rows of the winning tier, per slice when ``slices`` are named."""
    hits = table.withColumn("tier", match_tier(needle, raw_fallback=raw_fallback)).filter("tier IS NOT NULL")
    if not slices:
        best = one_row(hits.agg(F.min("tier").alias("_best")))
        return hits.join(best, F.col("tier") == F.col("_best")).drop("_best")
    best = hits.groupBy(*slices).agg(F.min("tier").alias("tier"))
    return hits.join(best, [*slices, "tier"], "left_semi")


def resolve_place(
    table: DataFrame, needle: str, *, slices: Sequence[str] = (), raw_fallback: bool = False
) -> DataFrame:
    """``(slices..., candidates, place)``: a place only when exactly one row matched.

    Counted per tier and then cut to the best tier, so a needle that matches most
    of a huge table still shuffles a handful of rows.
    """
    hits = table.withColumn("tier", match_tier(needle, raw_fallback=raw_fallback)).filter("tier IS NOT NULL")
    per_tier = hits.groupBy(*slices, "tier").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("p"))
    best = F.min_by(F.struct("n", "p"), "tier")
    return (
        per_tier.groupBy(*slices).agg(best.alias("b")) if slices else per_tier.agg(best.alias("b"))
    ).select(
        *slices,
        F.coalesce(F.col("b.n"), F.lit(0)).alias("candidates"),
        F.when(F.col("b.n") == 1, F.col("b.p")).alias("place"),
    )
