"""Whether requests can be answered, as columns: many requests are judged against the stored ids and headers at once.

``operators.headers`` refuses one request on the driver; here each request keeps its row
and gets the same word as its reason, or the column it resolves to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.snapshots import is_snapshot_id
from ..functions.text import flat
from ..vocab import CURRENT, VERTICALS

VIEW = ["vertical", "view", "region"]


def _answering(columns: Column, wanted: Column) -> Column:
    """Labels that equal the request, else labels that contain it; none of no header."""
    equal = F.filter(columns, lambda c: flat(c) == wanted)
    within = F.filter(columns, lambda c: F.contains(flat(c), wanted))
    return F.coalesce(F.when(F.size(equal) > 0, equal).otherwise(within), F.array().cast("array<string>"))


def judged(requests: DataFrame, entries: DataFrame, known: Sequence[str] = tuple(VERTICALS)) -> DataFrame:
    """``requests(request_no, vertical, view, region, frm, tos, column)`` with ``reason`` and ``resolved``.

    Exactly one of the two is set.  The checks run in the order in which a single request is
    refused: family, base, publication, ids, equal sides, column.  ``entries`` are corpus rows;
    a request meets the at most two of its own slices, and how many ids its view has.
    """
    heads = entries.select(*VIEW, "snapshot", "columns")
    published = heads.filter(is_snapshot_id(F.col("snapshot"))).groupBy(*VIEW).agg(F.count(F.lit(1)).alias("n_published"))
    asked = requests.withColumns({
        "_frm": F.coalesce(F.trim("frm"), F.lit("")), "_tos": F.coalesce(F.trim("tos"), F.lit(CURRENT)),
        "_wanted": flat(F.col("column")),
    })
    joined = asked.join(published, VIEW, "left")
    for side in ("_frm", "_tos"):
        joined = joined.join(
            heads.select(*VIEW, F.col("snapshot").alias(side), F.col("columns").alias(f"{side}_columns")), [*VIEW, side], "left")
    old, new = F.col("_frm_columns"), F.col("_tos_columns")
    both = F.array_intersect(new, old)
    olds, news = _answering(old, F.col("_wanted")), _answering(new, F.col("_wanted"))
    missing = lambda side: F.col(f"{side}_columns").isNull() & (F.col(side) != CURRENT)
    column = (
        F.when((F.size(olds) == 1) & (olds == news), F.lit(None))
        .when(F.greatest(F.size(olds), F.size(news)) > 1, "ambiguous_column")
        .when((F.size(olds) == 0) & (F.size(news) == 0), "unknown_column")
        .when(F.size(news) == 0, "column_only_in_from").when(F.size(olds) == 0, "column_only_in_to")
        .otherwise("different_columns")
    )
    shared = F.when(F.coalesce(F.size(both), F.lit(0)) <= 0, "no_shared_column")
    reason = (
        F.when(~F.col("vertical").isin(*known), "unknown_vertical").when(F.col("_frm") == "", "no_base")
        .when(F.coalesce("n_published", F.lit(0)) == 0, "no_snapshots").when(missing("_frm") | missing("_tos"), "unknown_snapshot")
        .when(F.col("_frm") == F.col("_tos"), "same_slice").when(F.col("_wanted") == "", shared).otherwise(column)
    )
    found = F.when(F.col("_wanted") == "", F.get(both, F.lit(0))).otherwise(F.get(olds, F.lit(0)))
    return joined.withColumn("reason", reason).withColumn("resolved", F.when(F.col("reason").isNull(), found)).select(
        *requests.columns, "reason", "resolved")
