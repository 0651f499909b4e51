"""Digests: canonical metrics text, table fingerprints, schema tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from ..vocab import IMPERIAL_TO_METRIC, ITEM_SPELLINGS


def metrics_text(metrics: Column) -> Column:
    """A map as canonical text; Spark maps cannot be compared directly."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metrics))))


def panel_fingerprint(row_no: Column, place: Column, metrics: Column) -> Column:
    """Aggregate digest of a table: row count and every (position, place, metrics).

    The position is hashed into each row, so page order counts although the
    combination itself is order-free and therefore pre-aggregates on the map side.  A table
    whose rows have no position is refused: its digest would not see their order.
    """
    text = metrics_text(metrics)
    added = F.sum(F.xxhash64(row_no, place, text).cast("decimal(38,0)"))
    mixed = F.bit_xor(F.xxhash64(F.lit("b"), text, place, row_no))
    n = F.count(F.lit(1))
    digest = F.substring(F.sha2(F.concat_ws("|", n, added, mixed), 256), 1, 32)
    placeless = F.raise_error(F.lit("a digest needs the position of every row")).cast("string")
    return F.when(F.count(row_no) < n, placeless).when(n > 0, digest).otherwise(F.lit(""))


def schema_tag(
    spellings: Sequence[tuple[str, str]] = ITEM_SPELLINGS,
    factors: Mapping[str, float] = IMPERIAL_TO_METRIC,
) -> Column:
    """Tag of everything that decides what a parsed entry holds."""
    parts = sorted(f"{label}->{key}" for label, key in spellings)
    parts += sorted(f"{key}*{factor!r}" for key, factor in factors.items())
    return F.substring(F.sha2(F.lit("|".join(parts)), 256), 1, 12)
