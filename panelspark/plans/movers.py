"""Which entities moved most between two snapshots, and can the movement be believed?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import diffing
from ..operators.fingerprints import drift_cause, panel_fingerprints, probe_of
from ..operators.headers import resolve_column, resolve_snapshots
from ..operators.panels import select_view
from ..session import one_row
from ..vocab import BASIS, CURRENT, VERTICALS


@dataclass(frozen=True)
class Comparison:
    """One comparison; each part is planned when it is first asked for."""

    both: DataFrame
    column: str
    shared: list[str]
    cause: DataFrame | None = None
    basis: str = BASIS
    snapshots: tuple[str, str] | None = None

    def sides(self, entries: DataFrame, now: Column) -> DataFrame:
        """``(side, snapshot, rows, age_s, archival)``: which id is which, and how old what was read is.

        ``entries`` are the corpus rows of the family, view and region that was asked about.
        """
        asked = F.broadcast(entries.sparkSession.createDataFrame(
            list(zip(("from", "to"), self.snapshots, strict=True)), "side string, snapshot string"))
        return asked.join(entries, "snapshot", "left").select(
            "side", "snapshot", F.col("n_rows").alias("rows"),
            F.floor(F.unix_micros(now) / 1_000_000 - F.unix_micros("fetched_at") / 1_000_000).cast("bigint").alias("age_s"),
            F.coalesce("keep", F.lit(False)).alias("archival"))

    @cached_property
    def pairs(self) -> DataFrame:
        controls = [c for c in self.shared if c != self.column]
        return diffing.pair_by_key(self.both, self.column, controls)

    @cached_property
    def rows(self) -> DataFrame:
        """The union of both tables with statuses, also the rows the join refused."""
        return diffing.diff_rows(self.both, self.column)

    @cached_property
    def summary(self) -> DataFrame:
        row = diffing.summary(self.pairs)
        return row if self.cause is None else row.crossJoin(one_row(self.cause))

    @cached_property
    def excluded(self) -> DataFrame:
        return diffing.excluded_keys(self.pairs)

    def movers(self, order: str = "abs", direction: str = "both", top: int | None = None) -> DataFrame:
        """Comparable rows only, so nothing is joined for the refused ones."""
        sized = diffing.with_sizes(diffing.compared(self.pairs, self.both), self.both)
        return diffing.order_movers(sized, order, direction, top)

    def counts(self) -> DataFrame:
        return diffing.status_counts(self.summary)

    def verdict(self) -> DataFrame:
        return diffing.verdict(self.summary)


def diff(
    both: DataFrame, from_columns: Sequence[str], to_columns: Sequence[str], column: str | None = None
) -> Comparison:
    """Compare two tables (``diffing.sides``); the column is settled before any row is read."""
    chosen = resolve_column(from_columns, to_columns, column)
    shared = [c for c in to_columns if c in set(from_columns)]
    return Comparison(both, chosen, shared)


def compare_snapshots(
    panel: DataFrame,
    published: Sequence[str],
    headers: dict[str, Sequence[str]],
    *,
    frm: str | None,
    to: str | None = CURRENT,
    column: str | None = None,
    prints: DataFrame | None = None,
    vertical: str | None = None,
    by: str = "city",
    region: str | None = None,
    known: Sequence[str] = tuple(VERTICALS),
) -> Comparison:
    """The whole question: ids checked, tables compared, drift told apart.

    Both sides are the slices of one family, view and region.  ``prints(snapshot, n_rows,
    fingerprint)`` are digests kept at ingest, of that view; without them at most three slices
    are digested: both sides and the oldest other published one.
    """
    ids = resolve_snapshots(published, frm, to)
    frm, to = ids["from"], ids["to"]
    view = select_view(panel, vertical, by=by, region=region, known=known)
    result = diff(diffing.sides_of(view, frm, to), headers.get(frm, ()), headers.get(to, ()), column)
    if prints is None:
        target = probe_of(published, frm, to)
        prints = panel_fingerprints(view.filter(F.col("snapshot").isin(*{frm, to, *([target] if target else [])})))
    return replace(result, cause=drift_cause(prints, frm, to, published), snapshots=(frm, to))
