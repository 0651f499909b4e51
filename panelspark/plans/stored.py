"""Questions to a stored panel: family, view, region and snapshot come from the caller, the rest from the store.

The corpus entries are the panel's dimension: which snapshots a view has, their headers in page
order, their digests.  A question reads the few entries of its own view first; the panel scan then
has a filter on every part of a slice, and the entries prune it further at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.snapshots import is_snapshot_id, sort_key, sort_key_of
from ..operators.fingerprints import panel_fingerprints
from ..operators.panels import SLICE, read_panel, select_view, write_panel
from ..sources.corpus_store import alive, backed_rows, scan_corpus, write_entries
from ..vocab import CURRENT, VERTICALS
from .movers import Comparison, compare_snapshots
from .rank import Ranking, rank
from .trend import Trend, trend


def store_panel(panel: DataFrame, headers: DataFrame, panel_path: str, corpus_path: str, *, schema_tag: str, now: Column) -> None:
    """Store whole slices that did not come from pages; ``headers(slice, columns)`` has each one's labels in order."""
    write_panel(panel, panel_path)
    stored = read_panel(panel.sparkSession, panel_path)
    prints = panel_fingerprints(stored.join(headers.select(*SLICE), SLICE, "left_semi"), SLICE)
    write_entries(headers.join(prints, SLICE).select(
        *SLICE, F.lit(schema_tag).alias("schema_tag"), now.alias("fetched_at"), F.current_timestamp().alias("written_at"),
        F.lit(None).cast("bigint").alias("bytes"), F.lit(True).alias("readable"), F.lit(False).alias("moved"),
        F.lit(False).alias("keep"), "fingerprint", "n_rows", "columns"), corpus_path)


@dataclass(frozen=True)
class StoredPanel:
    spark: SparkSession
    panel_path: str
    corpus_path: str
    known: Sequence[str] = tuple(VERTICALS)

    def _view(self, rows: DataFrame, vertical: str, by: str, region: str | None) -> DataFrame:
        return select_view(rows, vertical, by=by, region=region, known=self.known)

    def entries(self, vertical: str, by: str = "city", region: str | None = None) -> DataFrame:
        """The corpus rows of one view that hold rows."""
        return self._view(alive(scan_corpus(self.spark, self.corpus_path)), vertical, by, region)

    def published(self, vertical: str, by: str = "city", region: str | None = None) -> list[str]:
        """The view's snapshot ids, oldest first; as many as were ever published."""
        ids = self.entries(vertical, by, region).filter(is_snapshot_id(F.col("snapshot"))).select("snapshot")
        return sorted((row["snapshot"] for row in ids.collect()), key=sort_key_of)

    def headers(self, vertical: str, snapshots: Sequence[str], by: str = "city", region: str | None = None) -> dict[str, list[str]]:
        """The labels of the named snapshots, in page order."""
        named = self.entries(vertical, by, region).filter(F.col("snapshot").isin(*snapshots))
        return {row["snapshot"]: row["columns"] for row in named.select("snapshot", "columns").collect()}

    def rows(self, vertical: str, by: str = "city", region: str | None = None) -> DataFrame:
        """All rows of one view that its entries still stand for."""
        panel = self._view(read_panel(self.spark, self.panel_path), vertical, by, region)
        return backed_rows(panel, self.entries(vertical, by, region))

    def rank(self, vertical: str, snapshot: str = CURRENT, by: str = "city", region: str | None = None, **options) -> Ranking:
        columns = self.headers(vertical, [snapshot], by, region).get(snapshot, [])
        return rank(self.rows(vertical, by, region).filter(F.col("snapshot") == snapshot), columns, **options)

    def movers(
        self, vertical: str, frm: str | None, to: str | None = CURRENT, column: str | None = None,
        by: str = "city", region: str | None = None,
    ) -> Comparison:
        """The comparison of two stored snapshots; drift is told by stored digests, so no third slice is read."""
        published = self.published(vertical, by, region)
        asked = [s for s in (frm, to or CURRENT) if s]
        return compare_snapshots(
            self.rows(vertical, by, region), published, self.headers(vertical, asked, by, region), frm=frm, to=to,
            column=column, prints=self.entries(vertical, by, region).select("snapshot", "n_rows", "fingerprint"),
            vertical=vertical, by=by, region=region, known=self.known)

    def trend(
        self, vertical: str, place: str, column: str | None = None, by: str = "city", region: str | None = None,
        limit: int | None = None,
    ) -> Trend:
        """One entity over the view's snapshots, the newest first; a named column prunes the snapshots without it."""
        published = self.published(vertical, by, region)[::-1]
        headers = self.entries(vertical, by, region).select("snapshot", "columns")
        return trend(self.rows(vertical, by, region), place, published, column=column, headers=headers, limit=limit,
                     vertical=vertical, by=by, region=region, known=self.known)

    def series_of(self, vertical: str, column: str, by: str = "city", region: str | None = None) -> DataFrame:
        """``(snapshot, place, rank, value)`` of every snapshot whose header has ``column``; the others are not opened."""
        have = self.entries(vertical, by, region).filter(F.array_contains("columns", column)).select(*SLICE)
        rows = self._view(read_panel(self.spark, self.panel_path), vertical, by, region).join(F.broadcast(have), SLICE, "left_semi")
        return rows.select("snapshot", "place", "rank", F.try_element_at("metrics", F.lit(column)).alias("value"))


def stored_headers(spark: SparkSession, corpus_path: str) -> DataFrame:
    """``(slice, pos, column)`` of every stored slice, in page order, and the age order of its snapshot."""
    entries = scan_corpus(spark, corpus_path)
    key = sort_key(F.col("snapshot"))
    return entries.select(*SLICE, key["year"].alias("year"), F.posexplode("columns").alias("pos", "column"))
