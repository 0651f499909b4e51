"""Exact medians by distributed selection: no column is gathered or ordered as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import one_row, written

#: Different values of a group that are ordered in one place.
FEW_VALUES = 50_000

#: A round reads this many even quantiles of what is left of each group, with a finer sketch than they are apart.
_CELLS = 256
_ACCURACY = 10_000


def _with(rows: DataFrame, other: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``other`` has one row per group, or one row at all; Spark plans the join by its size."""
    return rows.join(other, list(groups)) if groups else rows.crossJoin(one_row(other))


def _inside() -> Column:
    return F.col("_v").between(F.col("_lo"), F.col("_hi"))


def _narrowed(known: DataFrame, brackets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The brackets closed in on the middle: one aggregate that combines on the map side.

    Both middle ranks stay inside: the new edges lie a whole cell beyond them, and the
    sketch errs by a fraction of a cell.
    """
    inside = F.when(_inside(), F.col("_v"))
    seen = _with(known, brackets, groups).groupBy(*groups, "n").agg(
        F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count(inside).alias("_n"),
        F.percentile_approx(inside, [i / _CELLS for i in range(_CELLS + 1)], _ACCURACY).alias("_grid"),
    )
    cell = lambda rank: (rank - F.col("_below")) / F.col("_n") * _CELLS
    low = F.greatest(F.floor(cell(F.floor((F.col("n") + 1) / 2))) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil(cell(F.floor(F.col("n") / 2) + 1)) + 1, F.lit(_CELLS)).cast("int")
    return seen.select(*groups, "n", F.get("_grid", low).alias("_lo"), F.get("_grid", high).alias("_hi"))


def exact_medians(df: DataFrame, groups: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """``(groups..., n, out)``: the exact median of ``value`` in every group.

    Every group starts with the bracket from its least to its largest value.  While a bracket
    holds more than FEW_VALUES different values, a round closes it in by quantiles of what it
    holds, some hundredfold; then its values are counted, and the middle is read off the counts.
    """
    known = df.select(*groups, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    brackets = known.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    brackets = written(brackets)
    most = brackets.agg(F.max("n")).first()[0] or 0  # values at most, without counting them
    while most > FEW_VALUES:
        brackets = written(_narrowed(known, brackets, groups))
        held = _with(known, brackets, groups).filter(_inside()).groupBy(*groups).agg(F.approx_count_distinct("_v").alias("d"))
        before, most = most, held.agg(F.max("d")).first()[0]
        if most >= before:
            break
    return _middle(known, brackets, groups, out)


def exact_medians_of(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row with the exact median of each named expression over all rows."""
    entries = [F.struct(F.lit(name).alias("which"), c.cast("double").alias("_v")) for name, c in columns.items()]
    known = df.select(F.inline(F.array(*entries)))
    picked = exact_medians(known, ["which"], "_v")
    return picked.agg(*[
        F.max(F.when(F.col("which") == name, F.col("median"))).alias(name) for name in columns
    ])


def _middle(known: DataFrame, brackets: DataFrame, groups: Sequence[str], out: str) -> DataFrame:
    """The values at both middle ranks, from the counts of the values inside the brackets."""
    zone = F.when(F.col("_v") < F.col("_lo"), -1).when(_inside(), 0).otherwise(1)
    counts = _with(known, brackets, groups).withColumn("_zone", zone).filter("_zone <= 0").groupBy(
        *groups, "n", F.when(F.col("_zone") == 0, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    listed = counts.groupBy(*groups, "n").agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_below"),
        F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_v", "_c")))).alias("_values"))
    start = F.struct(F.col("_below").alias("upto"), *[F.lit(None).cast("double").alias(name) for name in ("low", "high")])
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1

    def step(acc: Column, entry: Column) -> Column:
        upto = acc["upto"] + entry["_c"]
        take = lambda rank, name: F.when((acc["upto"] < rank) & (rank <= upto), entry["_v"]).otherwise(acc[name])
        return F.struct(upto.alias("upto"), take(low, "low").alias("low"), take(high, "high").alias("high"))

    found = listed.select(*groups, "n", F.aggregate("_values", start, step).alias("m"))
    middle = (F.col("m.low") + F.col("m.high")) / 2
    missed = F.raise_error(F.lit("a bracket missed the median")).cast("double")
    return found.select(*groups, "n", F.when(middle.isNull(), missed).otherwise(middle).alias(out))
