"""Whole-table digests: same table, repeated tables, tables that changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import snapshots as snap
from ..functions.digests import metrics_text, panel_fingerprint
from ..vocab import CURRENT, REPEAT_ALARM


def panel_fingerprints(panel: DataFrame, slices: Sequence[str] = ("snapshot",)) -> DataFrame:
    """``(slices..., n_rows, fingerprint)``; one shuffle of one row per task and slice."""
    return panel.groupBy(*slices).agg(
        F.count(F.lit(1)).cast("int").alias("n_rows"),
        panel_fingerprint(F.col("row_no"), F.col("place"), F.col("metrics")).alias("fingerprint"),
    )


def same_print(a: Column, b: Column) -> Column:
    """Equal and not empty: two tables without rows are not the same table."""
    return F.coalesce((a == b) & (a != ""), F.lit(False))


def distinct_tables(prints: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many different tables stand behind a group's entries, and the repeat alarm."""
    counted = prints.filter("fingerprint IS NOT NULL").groupBy(*by, "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("fingerprint") != ""
    top = F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0))
    return counted.groupBy(*by).agg(
        F.sum("n").alias("of"),
        F.count_if(real).alias("distinct_tables"),
        top.alias("max_repeat"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("unfingerprintable"),
        (top >= REPEAT_ALARM).alias("repeated"),
    )


def repeated_anywhere(*readings: DataFrame) -> DataFrame:
    """Groups under the repeat alarm in any reading (what a run holds, what is stored).

    Neither reading contains the other, so the alarm is their distinct union.
    """
    flagged = [r.filter("repeated").select("vertical") for r in readings]
    out = flagged[0]
    for more in flagged[1:]:
        out = out.unionByName(more)
    return out.distinct()


def repeated_series(series: DataFrame) -> Column:
    """Aggregate: at least three found points and a single (metrics, table size)."""
    point = F.when(F.col("found"), F.struct(metrics_text(F.col("metrics")), F.col("of")))
    return (F.count_if("found") >= REPEAT_ALARM) & (F.count_distinct(point) == 1)


def moved_snapshots(observations: DataFrame, by: Sequence[str]) -> DataFrame:
    """``moved`` is set for good once one id was seen with two different tables."""
    sticky = (
        F.bool_or(F.coalesce(F.col("moved"), F.lit(False))) if "moved" in observations.columns else F.lit(False)
    )
    return observations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_distinct("fingerprint").alias("distinct_tables"),
        ((F.min("fingerprint") != F.max("fingerprint")) | sticky).alias("moved"),
    )


def probe_of(published: Sequence[str], frm: str, to: str) -> str | None:
    """The oldest published id that is neither side; only such a table can tell the causes apart."""
    others = [name for name in published if name not in (frm, to, CURRENT)]
    return min(others, key=snap.sort_key_of, default=None)


def drift_cause(prints: DataFrame, frm: str, to: str, published: Sequence[str] | None = None) -> DataFrame:
    """One row: are both sides one table, and does a third id tell why?

    The probe is the oldest published id that is neither side; without ``published`` all
    ids of ``prints`` count as published.
    """
    one = lambda s: F.max(F.when(F.col("snapshot") == s, F.col("fingerprint")))
    third = ~F.col("snapshot").isin(frm, to, CURRENT)
    if published is not None:
        # No row but those of the three slices is read; an id that is not published is never probed.
        target = probe_of(published, frm, to)
        prints = prints.filter(F.col("snapshot").isin(*{frm, to, *([target] if target else [])}))
        third = F.col("snapshot") == target if target else F.lit(False)
    probe = F.min_by(
        F.struct("snapshot", "n_rows", "fingerprint"),
        F.when(third, snap.sort_key(F.col("snapshot"))),
    )
    row = prints.agg(
        one(frm).alias("a"), one(to).alias("b"), probe.alias("p"), F.count_if(third).alias("n_third")
    )
    identical = same_print(F.col("a"), F.col("b"))
    have = F.col("n_third") > 0
    drift = (
        F.when(~identical, F.lit(None))
        .when(~have, "identical_tables_cause_unknown")
        .when(same_print(F.col("p.fingerprint"), F.col("b")), "snapshot_parameter_ignored")
        .otherwise("same_published_table")
    )
    probed = identical & have
    return row.select(
        identical.alias("identical_tables"),
        drift.alias("drift"),
        F.when(probed, F.col("p.snapshot")).alias("probe_snapshot"),
        F.when(probed, F.col("p.n_rows")).alias("probe_rows"),
    )
