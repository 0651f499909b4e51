"""Snapshot ids: grammar, order, and when one may be treated as final."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..vocab import EARLIEST_SNAPSHOT_YEAR, PUBLICATION_CYCLE_DAYS

#: Fixed value: a year, or a year's middle.
SNAPSHOT_PATTERN = r"^[0-9]{4}(-mid)?\z"


def is_snapshot_id(c: Column) -> Column:
    return F.coalesce(c.rlike(SNAPSHOT_PATTERN), F.lit(False))


def _year(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def sort_key(c: Column) -> Column:
    """``struct(year, half)``: ids order by the period they name, invalid ones first."""
    ok = is_snapshot_id(c)
    return F.struct(
        F.when(ok, _year(c)).otherwise(-1).alias("year"),
        F.when(ok & F.endswith(c, F.lit("-mid")), 1).otherwise(0).alias("half"),
    )


def sort_key_of(snapshot: str) -> tuple[int, int]:
    """Driver-side twin of :func:`sort_key` for validated argument lists."""
    import re

    if not re.fullmatch(r"[0-9]{4}(-mid)?", snapshot or ""):
        return (-1, 0)
    return (int(snapshot[:4]), int(snapshot.endswith("-mid")))


def is_archival(c: Column, now: Column, moved: Column | None = None) -> Column:
    """True once the named year plus one publication cycle has passed.

    ``current``, malformed ids, years before the first publication and ids seen
    to change are never final.
    """
    year = F.when(is_snapshot_id(c), _year(c))
    # Counted in days since 1970 so that the rule is in UTC whatever the session's zone is.
    final_day = F.unix_date(F.make_date(year + 1, F.lit(1), F.lit(1))) + PUBLICATION_CYCLE_DAYS
    final = (year >= EARLIEST_SNAPSHOT_YEAR) & (F.unix_seconds(now) >= final_day.cast("bigint") * 86_400)
    if moved is not None:
        final = final & ~F.coalesce(moved, F.lit(False))
    return F.coalesce(final, F.lit(False))
