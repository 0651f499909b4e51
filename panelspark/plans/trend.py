"""One entity across many snapshots, anchored to one whole label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.fingerprints import repeated_series
from ..operators.panels import select_view
from ..operators.places import find_place, match_tier
from ..session import one_row
from ..vocab import VERTICALS


@dataclass(frozen=True)
class Trend:
    series: DataFrame
    summary: DataFrame
    ambiguous: DataFrame


def trend(
    panel: DataFrame,
    place: str,
    published: Sequence[str],
    *,
    column: str | None = None,
    headers: DataFrame | None = None,
    unreadable: dict[str, str] | None = None,
    limit: int | None = None,
    vertical: str | None = None,
    by: str = "city",
    region: str | None = None,
    known: Sequence[str] = tuple(VERTICALS),
) -> Trend:
    """Follow ``place`` over all published snapshots, or the first ``limit``, in page order.

    The snapshots are those of one family, view and region.

    The label is resolved once, in the first snapshot where exactly one row
    matches; from there on only that label counts.  Snapshots without it stay in
    the series as not found.  ``headers(snapshot, columns)`` supplies the default
    column: the first one of the last readable snapshot.
    """
    wanted = list(published)[:limit]
    if not wanted:
        raise ValueError("no snapshot list; this table may be current-only")
    errors = unreadable or {}
    spark = panel.sparkSession
    # As many rows as snapshots were asked for.
    asked = F.broadcast(spark.createDataFrame(
        [(i, s, errors.get(s)) for i, s in enumerate(wanted)], "pos int, snapshot string, error string"
    ))
    readable = [s for s in wanted if s not in errors]
    view = select_view(panel, vertical, by=by, region=region, known=known)
    rows = view.filter(F.col("snapshot").isin(*readable) if readable else F.lit(False))

    tier = match_tier(place)
    per_tier = rows.withColumn("tier", tier).groupBy("snapshot", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("p")
    )
    found = per_tier.groupBy("snapshot").agg(
        F.sum("n").cast("int").alias("of"),
        F.min_by(F.struct("n", "p"), "tier").alias("best"),
    )
    resolved = asked.join(found, "snapshot", "left").select(
        "pos", "snapshot", "error", F.coalesce("of", F.lit(0)).alias("of"),
        F.coalesce("best.n", F.lit(0)).alias("candidates"),
        F.when(F.col("best.n") == 1, F.col("best.p")).alias("only"),
    )
    anchor = one_row(resolved.agg(
        F.min_by("only", F.when(F.col("only").isNotNull(), F.col("pos"))).alias("anchor"),
        F.min(F.when(F.col("only").isNotNull(), F.col("pos"))).alias("anchor_pos"),
    ))
    hits = rows.join(anchor, F.col("place") == F.col("anchor")).groupBy("snapshot").agg(
        F.min_by(F.struct("rank", "metrics"), "row_no").alias("hit")
    )
    joined = resolved.join(hits, "snapshot", "left").crossJoin(anchor)
    here = F.coalesce(F.col("hit").isNotNull() & (F.col("pos") >= F.col("anchor_pos")), F.lit(False))
    before = F.coalesce(F.col("pos") < F.col("anchor_pos"), F.lit(True))
    series = joined.select(
        "pos", "snapshot", here.alias("found"),
        F.when(here, F.col("anchor")).alias("place"),
        F.when(here, F.col("hit.rank")).alias("rank"),
        F.when(here, F.col("of")).alias("of"),
        F.when(here, F.col("hit.metrics")).alias("metrics"),
        F.when(here | F.col("error").isNotNull(), F.lit(None))
        .when(before & (F.col("candidates") > 1), F.concat(F.lit("ambiguous: "), "candidates", F.lit(" places match")))
        .otherwise("not ranked in this snapshot").alias("note"),
        "error",
    )
    summary = series.agg(
        F.count_if("found").alias("found_in"), F.count(F.lit(1)).alias("requested"),
        F.lit(len(published)).alias("published"),
        repeated_series(series).alias("identical_across_snapshots"),
    ).crossJoin(anchor.select("anchor"))
    if column is not None:
        summary = summary.withColumn("column", F.lit(column))
    elif headers is not None:
        last = headers.join(asked, "snapshot").filter(F.size("columns") > 0)
        default = last.agg(F.get(F.max_by("columns", "pos"), F.lit(0)).alias("column"))
        summary = summary.crossJoin(one_row(default))
    else:
        summary = summary.withColumn("column", F.lit(None).cast("string"))

    # Candidates of the last snapshot that stayed ambiguous before the anchor, as rows.
    last_open = one_row(
        resolved.crossJoin(anchor)
        .filter((F.col("candidates") > 1) & F.coalesce(F.col("pos") < F.col("anchor_pos"), F.lit(True)))
        .agg(F.max_by("snapshot", "pos").alias("snapshot"))
    )
    ambiguous = find_place(rows.join(last_open, "snapshot", "left_semi"), place).select("snapshot", "place", "rank")
    return Trend(series, summary, ambiguous)
