"""Finding entities by bounds, looking one up, upcoming events, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import slug_guess
from ..session import one_row
from ..vocab import DISCOVER_MAX_LIMIT


def search(
    entities: DataFrame,
    *,
    max_cost_usd: float | None = None,
    region: str | None = None,
    country: str | None = None,
    min_internet_mbps: float | None = None,
    min_safety: float | None = None,
    min_temperature_c: float | None = None,
    max_temperature_c: float | None = None,
) -> DataFrame:
    """Bounds that are set become filters; an unset bound is left out, zero is a bound."""
    bounds = [
        (max_cost_usd, lambda v: F.col("cost_usd") <= v),
        (region, lambda v: F.col("region") == v),
        (country, lambda v: F.col("country") == v),
        (min_internet_mbps, lambda v: F.col("internet_mbps") >= v),
        (min_safety, lambda v: F.col("safety") >= v),
        (min_temperature_c, lambda v: F.col("temperature_c") >= v),
        (max_temperature_c, lambda v: F.col("temperature_c") <= v),
    ]
    out = entities
    for value, condition in bounds:
        if value is not None:
            out = out.filter(condition(value))
    return out


def cut_with_counts(matching: DataFrame, order: list[Column], limit: int = 20) -> DataFrame:
    """The first ``limit`` rows, each beside ``total_matching`` and ``returned``.

    A limit above the cap is refused, never lowered silently.
    """
    if limit > DISCOVER_MAX_LIMIT:
        raise ValueError(f"limit={limit} exceeds {DISCOVER_MAX_LIMIT}; use rank for a whole sweep")
    total = matching.agg(F.count(F.lit(1)).alias("total_matching"))
    counted = total.withColumn("returned", F.least("total_matching", F.lit(max(0, limit)).cast("bigint")))
    return matching.orderBy(*order).limit(max(0, limit)).crossJoin(one_row(counted))


def with_slug_guess(entities: DataFrame) -> DataFrame:
    return entities.withColumn("slug_guess", slug_guess(F.col("name"), F.col("slug"), F.col("country")))


def verify(entities: DataFrame, budgets: DataFrame) -> DataFrame:
    """Left join of discovered entities to price records through the guessed slug.

    ``budgets`` holds one row per entity, so no key is hot on that side; a failed
    lookup keeps the row and says why.
    """
    figures = budgets.select(
        F.col("entity").alias("slug_guess"), F.col("budget").alias("verified_budget"),
        F.col("missing").alias("verified_missing"), F.lit(True).alias("_hit"),
    )
    error = F.when(F.col("_hit").isNull(), F.concat(F.lit("no price page for '"), F.col("slug_guess"), F.lit("'")))
    return with_slug_guess(entities).join(figures, "slug_guess", "left").withColumn(
        "verify_error", error
    ).drop("_hit")


def field_rows(entities: DataFrame, slug: str, key: str = "slug") -> DataFrame:
    """``(field, value)`` rows of one entity, fields sorted, private ones dropped."""
    shown = sorted(c for c in entities.columns if not c.startswith("_"))
    pairs = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in shown]
    return entities.filter(F.col(key) == slug).select(F.inline(F.array(*pairs))).orderBy("field")


def upcoming(
    meetups: DataFrame, now: Column, *, city: str | None = None, country: str | None = None,
    days_ahead: int | None = None, limit: int | None = 20,
) -> DataFrame:
    """Events from ``now`` on, soonest first, each beside ``total_matching`` and ``returned``; ``limit=None`` gives all."""
    out = meetups.filter(F.col("ts") >= now)
    if days_ahead is not None:
        out = out.filter(F.col("ts") < now + F.expr(f"INTERVAL {int(days_ahead)} DAYS"))
    if city is not None:
        out = out.filter(F.col("city") == city)
    if country is not None:
        out = out.filter(F.col("country") == country)
    total = out.agg(F.count(F.lit(1)).alias("total_matching"))
    shown = F.col("total_matching") if limit is None else F.least("total_matching", F.lit(max(0, limit)).cast("bigint"))
    first = out.orderBy("ts", "event_id")
    return (first if limit is None else first.limit(max(0, limit))).crossJoin(one_row(total.withColumn("returned", shown)))


def link_slugs(pages: DataFrame, prefix: str = "/cost-of-living/in/", charset: str = r"A-Za-z0-9\-'") -> DataFrame:
    """Distinct slugs behind links that start with ``prefix``, sorted; always a subset."""
    import re

    pattern = f"{re.escape(prefix)}([{charset}]+)"
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("slug"))
    return found.select(F.rtrim("slug", F.lit("'\"")).alias("slug")).distinct().orderBy("slug")
