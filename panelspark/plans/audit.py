"""What does the corpus hold, and what would completing it take?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..operators import corpus as ops
from ..operators.headers import Refused
from ..session import scratch_path
from ..vocab import ENTRY_STATES, VERTICALS

DEFAULT_MAX_AGE = 21_600
DEFAULT_LIST_MAX_AGE = 86_400


@dataclass(frozen=True)
class Audit:
    targets: DataFrame
    by_family: DataFrame
    repeats: DataFrame
    totals: DataFrame
    outstanding: DataFrame


def audit(
    lists: DataFrame,
    corpus: DataFrame,
    *,
    now: Column,
    schema_tag: str,
    verticals: Sequence[str] | None = None,
    known: Sequence[str] = tuple(VERTICALS),
    max_age: int = DEFAULT_MAX_AGE,
    list_max_age: int = DEFAULT_LIST_MAX_AGE,
) -> Audit:
    """Plan over stored state only: reads tables, fetches nothing."""
    wanted = ops.families(lists.sparkSession, verticals, known)
    denominators = ops.snapshot_lists(lists, wanted, now=now, list_max_age=list_max_age, schema_tag=schema_tag)
    targets = ops.audit_targets(denominators, corpus, now=now, max_age=max_age, schema_tag=schema_tag)
    by_family = ops.audit_by_family(denominators, targets)
    repeats = ops.audit_repeats(targets)
    return Audit(targets, by_family, repeats, ops.audit_totals(by_family, repeats), ops.outstanding(targets))


def stated(
    lists: DataFrame, corpus: DataFrame, *, now: Column, schema_tag: str, verticals: Sequence[str] | None = None,
    known: Sequence[str] = tuple(VERTICALS), max_age: int = DEFAULT_MAX_AGE, list_max_age: int = DEFAULT_LIST_MAX_AGE,
) -> Audit:
    """The audit as a report that is handed out: its targets are stored, and all its sums are checked first.

    While the targets are written their states are counted; a report whose totals differ from these
    counts, or from the parts they are made of, is refused.
    """
    spark = lists.sparkSession
    wanted = ops.families(spark, verticals, known)
    denominators = ops.snapshot_lists(lists, wanted, now=now, list_max_age=list_max_age, schema_tag=schema_tag)
    targets = ops.audit_targets(denominators, corpus, now=now, max_age=max_age, schema_tag=schema_tag)
    seen = Observation("targets")
    path = scratch_path(spark, "targets")
    targets.observe(seen, *[F.count_if(F.col("state") == state).alias(state) for state in ENTRY_STATES]).write.parquet(path)
    targets = spark.read.schema(targets.schema).parquet(path)
    by_family = ops.audit_by_family(denominators, targets)
    repeats = ops.audit_repeats(targets)
    totals = ops.audit_totals(by_family, repeats)
    ops.require_conservation(by_family, totals)
    counted = totals.select(*ENTRY_STATES).first()  # one row
    lost = {state: (counted[state], seen.get[state]) for state in ENTRY_STATES if counted[state] != seen.get[state]}
    if lost:
        raise Refused("does_not_add_up", f"states stated and written differ: {lost}")
    return Audit(targets, by_family, repeats, totals, ops.outstanding(targets))
