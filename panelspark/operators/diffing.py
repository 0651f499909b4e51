"""Two snapshots of one panel, joined on keys that occur once per side.

The join is an aggregation of numbers alone: both sides are unioned and grouped by key, so a label
that is repeated a billion times collapses on the map side to two counts instead
of meeting in one join task.  The labels of the rows that were compared come by a join on the
key, and only where rows are shown; counts and statistics never read them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import abs_change, finite, pct_change, share
from ..session import one_row, written
from ..vocab import (
    DISTINCT_DELTA_FLOOR, DISTINCT_DELTA_MIN_SAMPLE, FROZEN_COLUMN_MIN_SAMPLE, MIN_OVERLAP,
    REBASE_DIRECTION_SHARE, REBASE_MIN_SAMPLE, SAMPLE_ROWS, STATUSES,
)
from .medians import exact_medians_of

ROW_COLUMNS = [
    "place", "city", "country", "key", "status", "reason", "value_from", "value_to",
    "delta", "pct", "rank_from", "of_from", "rank_to", "of_to",
]
CSV_COLUMNS = [c for c in ROW_COLUMNS if c != "key"]

ORDERS = ("abs", "pct")
DIRECTIONS = ("both", "rising", "falling")


def sides(from_table: DataFrame, to_table: DataFrame) -> DataFrame:
    """Both tables in one, with their ``side``."""
    columns = ["place", "city", "country", "rank", "metrics", "place_key"]
    return from_table.select(F.lit("from").alias("side"), *columns).unionByName(
        to_table.select(F.lit("to").alias("side"), *columns))


def sides_of(view: DataFrame, frm: str, to: str) -> DataFrame:
    """The same from one view: a single scan of two slices, which keeps the bucketing of a table stored by key."""
    side = F.when(F.col("snapshot") == frm, "from").otherwise("to")
    return view.filter(F.col("snapshot").isin(frm, to)).withColumn("side", side)


def pair_by_key(both: DataFrame, column: str, controls: Sequence[str] = ()) -> DataFrame:
    """``(key, n_from, n_to, value_from, value_to, rank_from, rank_to, c0_from, ...)``: one row per key of either side.

    A side's figures mean something only where its count is 1.  All of them have a fixed width, so the
    aggregation hashes and never sorts.
    """
    metric = lambda name: F.try_element_at("metrics", F.lit(name))
    names = {"value": metric(column), "rank": F.col("rank"), **{f"c{i}": metric(c) for i, c in enumerate(controls)}}
    is_from = F.col("side") == "from"
    return both.select(F.col("place_key").alias("key"), "side", *[c.alias(name) for name, c in names.items()]).groupBy("key").agg(
        F.count_if(is_from).alias("n_from"), F.count_if(~is_from).alias("n_to"),
        *[F.max(F.when(here, F.col(name))).alias(f"{name}_{side}")
          for name in names for side, here in (("from", is_from), ("to", ~is_from))],
    )


def _keyed() -> Column:
    return F.col("key") != ""


def compared(pairs: DataFrame, both: DataFrame) -> DataFrame:
    """Rows of keys that are unique on at least one side, with status, figures and the label of the later side."""
    here_from, here_to = F.col("n_from") == 1, F.col("n_to") == 1
    figures = pairs.filter(_keyed() & (here_from | here_to)).withColumns({
        "_d": abs_change(F.col("value_from"), F.col("value_to")),
        "_p": pct_change(F.col("value_from"), F.col("value_to")),
        "joined": here_from & here_to,
    })
    status = (
        F.when(~here_from, "new").when(~here_to, "delisted")
        .otherwise(F.coalesce(F.col("_d.reason"), F.lit("moved")))
    )
    moved = F.col("joined") & F.col("_d.reason").isNull()
    rows = figures.select(
        "key", (~here_to).alias("_from_old"), status.alias("status"),
        F.when(moved & F.col("_p.pct").isNull(), F.col("_p.reason")).alias("reason"),
        F.when(here_from, F.col("value_from")).alias("value_from"),
        F.when(here_to, F.col("value_to")).alias("value_to"),
        F.when(F.col("joined"), F.col("_d.delta")).alias("delta"),
        F.when(F.col("joined"), F.col("_p.pct")).alias("pct"),
        F.when(here_from, F.col("rank_from")).alias("rank_from"),
        F.when(here_to, F.col("rank_to")).alias("rank_to"),
    )
    # The side is no join key: the figures lie by key already and stay where they are.
    r, labels = rows.alias("r"), both.select(F.col("place_key").alias("key"), "side", "place", "city", "country").alias("l")
    joined = r.join(labels, F.expr("r.key = l.key AND if(l.side = 'from', r._from_old, NOT r._from_old)"))
    return joined.select("l.place", "l.city", "l.country", *[f"r.{c}" for c in rows.columns if c != "_from_old"])


def excluded_keys(pairs: DataFrame) -> DataFrame:
    """``(side, key, reason, n)`` for every excluded key; needs no row-level join."""
    per_side = pairs.select(
        "key", F.inline(F.array(
            F.struct(F.lit("from").alias("side"), F.col("n_from").alias("n")),
            F.struct(F.lit("to").alias("side"), F.col("n_to").alias("n")),
        )),
    )
    reason = F.when(_keyed(), "duplicate_key").otherwise("unkeyable_label")
    return per_side.filter((_keyed() & (F.col("n") > 1)) | (~_keyed() & (F.col("n") > 0))).select(
        "side", "key", reason.alias("reason"), "n"
    )


def excluded_rows(both: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows the join refuses: every copy of a repeated key, and labels without a key."""
    rows = both.select("side", "place", "city", "country", F.col("place_key").alias("key"))
    # Adaptive execution broadcasts a short list of keys, and otherwise splits the rows of a hot one.
    refused = rows.join(excluded_keys(pairs).select("side", "key"), ["side", "key"], "left_semi")
    return refused.select(
        "place", "city", "country", "key",
        F.when(_keyed(), "duplicate_key").otherwise("unkeyable_label").alias("status"),
        F.concat(F.lit("excluded_from_"), "side", F.lit("_snapshot")).alias("reason"),
    )


def with_sizes(rows: DataFrame, both: DataFrame) -> DataFrame:
    """Put both table sizes beside every row, in the fixed row schema."""
    is_from = F.col("side") == "from"
    sizes = both.agg(F.count_if(is_from).cast("int").alias("of_from"), F.count_if(~is_from).cast("int").alias("of_to"))
    return rows.crossJoin(one_row(sizes)).select(*ROW_COLUMNS)


def diff_rows(both: DataFrame, column: str) -> DataFrame:
    """Every row of the union, with one fixed row schema."""
    pairs = pair_by_key(both, column)
    rows = compared(pairs, both).unionByName(excluded_rows(both, pairs), allowMissingColumns=True)
    return with_sizes(rows, both)


# ---------------------------------------------------------------- one-row summary


def _control_flags(pairs: DataFrame) -> tuple[Column, Column]:
    """Per joined key: was any control cell comparable, and did any move."""
    joined = _keyed() & (F.col("n_from") == 1) & (F.col("n_to") == 1)
    controls = [c.removesuffix("_from") for c in pairs.columns if re.fullmatch("c[0-9]+_from", c)]
    deltas = [F.when(joined, finite(F.col(f"{c}_to") - F.col(f"{c}_from"))) for c in controls]
    nothing = F.lit(False)
    return (
        functools.reduce(Column.__or__, [d.isNotNull() for d in deltas], nothing),
        functools.reduce(Column.__or__, [F.coalesce(d != 0, nothing) for d in deltas], nothing),
    )


def control_evidence(comparable: Column, moved: Column) -> Column:
    """TRUE some control moved, FALSE none of the readable ones did, NULL none readable."""
    return F.when(F.bool_or(moved), True).when(F.bool_or(comparable), False)


def summary(pairs: DataFrame) -> DataFrame:
    """One row: status counts, statistics, overlap, control evidence and the two medians.

    The figures of every key are fixed once, as a narrow table of numbers, so that
    the counts, the distinct deltas and the medians do not each join the two
    snapshots again.  All of them combine on the map side.
    """
    comparable, moved_control = _control_flags(pairs)
    here_from, here_to = F.col("n_from") == 1, F.col("n_to") == 1
    joined = _keyed() & here_from & here_to
    change = abs_change(F.col("value_from"), F.col("value_to"))
    base = written(pairs.select(
        _keyed().alias("keyed"), "n_from", "n_to", joined.alias("joined"),
        F.when(joined, change["delta"]).alias("delta"),
        F.when(joined, pct_change(F.col("value_from"), F.col("value_to"))["pct"]).alias("pct"),
        F.when(~_keyed(), "unkeyable_label")
        .when(joined, F.coalesce(change["reason"], F.lit("moved")))
        .when(here_to, "new").when(here_from, "delisted").alias("status"),
        comparable.alias("comparable"), moved_control.alias("moved_control"),
    ))

    def rows_of(status: str) -> Column:
        if status == "unkeyable_label":
            return F.sum(F.when(~F.col("keyed"), F.col("n_from") + F.col("n_to")).otherwise(0))
        if status == "duplicate_key":
            repeats = lambda n: F.when(F.col(n) > 1, F.col(n)).otherwise(0)
            return F.sum(F.when(F.col("keyed"), repeats("n_from") + repeats("n_to")).otherwise(0))
        return F.count_if(F.col("status") == status)

    delta = F.col("delta")
    totals = base.agg(
        F.coalesce(F.sum("n_from"), F.lit(0)).alias("of_from"),
        F.coalesce(F.sum("n_to"), F.lit(0)).alias("of_to"),
        F.count_if("joined").alias("joined"),
        *[F.coalesce(rows_of(s), F.lit(0)).cast("bigint").alias(f"n_{s}") for s in STATUSES],
        F.count_if(delta > 0).alias("rising"),
        F.count_if(delta < 0).alias("falling"),
        F.count_if(delta == 0).alias("unchanged"),
        F.count_distinct(F.round(delta, 6)).alias("distinct_delta_values"),
        control_evidence(F.col("comparable"), F.col("moved_control")).alias("control_moved"),
    )
    medians = exact_medians_of(base, {"median_delta": F.col("delta"), "median_pct": F.col("pct")})
    n = F.col("n_moved")
    direction = F.greatest("rising", "falling")
    turned = F.col("rising") + F.col("falling")
    smaller = F.least("of_from", "of_to")
    return (
        totals.crossJoin(one_row(medians))
        .withColumns({
            "with_metric_in_both": n,
            "zero_delta_share": share(F.col("unchanged"), n),
            "same_direction_share": share(direction, turned),
            "overlap_pct_of_smaller": share(F.col("joined"), smaller) * 100.0,
            "below_floor": (smaller > 0) & (F.col("joined") < MIN_OVERLAP * smaller),
        })
        .withColumns({
            "partial_drift": drift_flags(),
            "rebase_suspected": (turned >= REBASE_MIN_SAMPLE)
            & F.coalesce(F.col("same_direction_share") >= REBASE_DIRECTION_SHARE, F.lit(False)),
        })
    )


def drift_flags() -> Column:
    """Names of the drift signatures a whole-table digest cannot see."""
    n = F.col("with_metric_in_both")
    frozen = (
        (n >= FROZEN_COLUMN_MIN_SAMPLE)
        & F.coalesce(F.col("zero_delta_share") == 1.0, F.lit(False))
        & F.coalesce(F.col("control_moved"), F.lit(False))
    )
    few = (n >= DISTINCT_DELTA_MIN_SAMPLE) & (F.col("distinct_delta_values") <= DISTINCT_DELTA_FLOOR)
    return F.array_compact(F.array(
        F.when(frozen, F.lit("diffed_column_did_not_move_while_another_did")),
        F.when(few, F.lit("too_few_distinct_deltas")),
    ))


def status_counts(summary_row: DataFrame) -> DataFrame:
    """``(status, n)`` over the whole vocabulary: a status nobody has counts 0."""
    entries = [F.struct(F.lit(s).alias("status"), F.col(f"n_{s}").alias("n")) for s in STATUSES]
    return summary_row.select(F.inline(F.array(*entries)))


def verdict(summary_row: DataFrame) -> DataFrame:
    """Adds ``reasons``, ``warnings`` and ``exit`` to a summary that carries ``drift``.

    It grades the run, never the entities.
    """
    drift = F.col("drift")
    checks = F.array_compact(F.array(
        drift,
        F.when(F.col("below_floor"), F.lit("join_below_floor")),
        F.when(F.col("with_metric_in_both") == 0, F.lit("nothing_was_compared")),
    ))
    reasons = F.concat(checks, F.col("partial_drift"))
    code = (
        F.when(F.coalesce(drift == "same_published_table", F.lit(False)), 2)
        .when(F.size(reasons) > 0, 1).otherwise(0)
    )
    warnings = F.array_compact(F.array(F.when(F.col("rebase_suspected"), F.lit("rebase_suspected"))))
    return summary_row.withColumns({"reasons": reasons, "warnings": warnings, "exit": code})


# ------------------------------------------------------------------- presentation


def movers_in(rows: DataFrame, direction: str = "both") -> DataFrame:
    """Comparable rows; ``both`` keeps the ones that did not change."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction '{direction}', one of: {', '.join(DIRECTIONS)}")
    moved = rows.filter(F.col("status") == "moved")
    if direction == "rising":
        return moved.filter("delta > 0")
    return moved.filter("delta < 0") if direction == "falling" else moved


def order_movers(
    rows: DataFrame, order: str = "abs", direction: str = "both", top: int | None = None
) -> DataFrame:
    """Largest movement first, unknown figures last, ties by place; ``top=None`` keeps all."""
    if order not in ORDERS:
        raise ValueError(f"unknown order '{order}', one of: {', '.join(ORDERS)}")
    figure = F.col("pct" if order == "pct" else "delta")
    out = movers_in(rows, direction).orderBy(F.abs(figure).desc_nulls_last(), "place", "key")
    return out if top is None else out.limit(max(0, top))


def truncation_counts(summary_row: DataFrame, direction: str = "both", top: int | None = None) -> DataFrame:
    """joined -> matched_direction -> shown, so that a cut is always visible."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction '{direction}', one of: {', '.join(DIRECTIONS)}")
    matched = F.col({"both": "n_moved", "rising": "rising", "falling": "falling"}[direction])
    shown = matched if top is None else F.least(matched, F.lit(max(0, top)))
    return summary_row.select(
        "joined", matched.alias("matched_direction"), shown.cast("bigint").alias("shown"),
        (shown < matched).alias("truncated"),
    )


def one_sided_samples(rows: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first few new and delisted rows, in their own table's order."""
    new = rows.filter("status = 'new'").orderBy("rank_to", "key").limit(n)
    gone = rows.filter("status = 'delisted'").orderBy("rank_from", "key").limit(n)
    return new.unionByName(gone)
