"""Which column is meant: driver-side rules over short header lists, and their Column form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..functions.snapshots import sort_key_of
from ..functions.text import flat
from ..vocab import CURRENT


class Refused(ValueError):
    """The request cannot be answered as put; ``reason`` is a stable word."""

    def __init__(self, reason: str, message: str) -> None:
        super().__init__(message)
        self.reason = reason


def sort_column(columns: Sequence[str], requested: str) -> str | None:
    """First header that contains the request, ignoring case; None when none does."""
    return next((c for c in columns if requested.lower() in c.lower()), None)


def sort_column_expr(columns: Column, requested: str) -> Column:
    """:func:`sort_column` for a header stored in an array column."""
    return F.get(F.filter(columns, lambda c: F.contains(F.lower(c), F.lit(requested.lower()))), F.lit(0))


def matches_expr(columns: Column, requested: str) -> Column:
    """Headers that match a request: equal ones, else ones that contain it."""
    want = folded(requested)
    if not want:
        return F.array().cast("array<string>")
    equal = F.filter(columns, lambda c: flat(c) == want)
    within = F.filter(columns, lambda c: F.contains(flat(c), F.lit(want)))
    return F.when(F.size(equal) > 0, equal).otherwise(within)


def shared_columns(to_columns: Column, from_columns: Column) -> Column:
    """Labels both headers carry, in the order of the first argument."""
    return F.array_intersect(to_columns, from_columns)


def header_index_expr(columns: Column, *names: str) -> Column:
    """0-based header position per name: equal first, then containing; NULL when absent."""
    low = F.transform(columns, lambda c: F.lower(c))
    found = []
    for name in names:
        want = name.lower()
        equal = F.array_position(low, want)
        within = F.array_position(F.transform(low, lambda c: F.contains(c, F.lit(want))), True)
        found.append(F.coalesce(F.nullif(equal, F.lit(0)), F.nullif(within, F.lit(0))))
    return (F.coalesce(*found) - 1).cast("int")


def folded(text: str | None) -> str:
    """Case and white space do not count in a request."""
    return " ".join((text or "").lower().split())


def answering(columns: Sequence[str], requested: str) -> list[str]:
    """Headers that answer a request, by how well: all equal ones, or without any all that contain it."""
    grades: dict[bool, list[str]] = {True: [], False: []}
    for column in columns:
        if folded(requested) in folded(column):
            grades[folded(requested) == folded(column)].append(column)
    return grades[True] or grades[False]


def resolve_column(from_columns: Sequence[str], to_columns: Sequence[str], requested: str | None = None) -> str:
    """The one column two snapshots agree on, or a refusal that names both headers."""
    shared = [c for c in to_columns if c in set(from_columns)]
    headers = f"from: {list(from_columns)}; to: {list(to_columns)}; in both: {shared}"
    if not folded(requested):
        if shared:
            return shared[0]
        raise Refused("no_shared_column", f"the two snapshots share no column. {headers}")
    old, new = answering(from_columns, requested), answering(to_columns, requested)
    if old == new and len(old) == 1:
        return old[0]
    several = max(len(old), len(new)) > 1
    reason = "ambiguous_column" if several else {
        (False, False): "unknown_column", (True, False): "column_only_in_from",
        (False, True): "column_only_in_to", (True, True): "different_columns",
    }[bool(old), bool(new)]
    raise Refused(reason, f"column '{requested}': {reason} (from {old}, to {new}). {headers}")


def resolve_snapshots(published: Sequence[str], frm: str | None, to: str | None = CURRENT) -> dict:
    """Check both ids against the published ones before any table is read."""
    pair = {side: CURRENT if given is None else str(given).strip() for side, given in (("from", frm), ("to", to))}
    known = [CURRENT, *published]
    strangers = [f"{side} '{name}'" for side, name in pair.items() if name not in known]
    refusals = (
        ("no_base", not pair["from"], f"a comparison needs a base snapshot out of {known}"),
        ("no_snapshots", not published, "nothing is published, so there are no two tables to compare"),
        ("unknown_snapshot", bool(strangers), f"not published: {'; '.join(strangers)}. Published: {known}"),
        ("same_slice", pair["from"] == pair["to"], f"both sides are '{pair['to']}'"),
    )
    for reason, applies, message in refusals:
        if applies:
            raise Refused(reason, message)
    by_age = sorted(published, key=sort_key_of)
    return {**pair, "published": list(published), "oldest": by_age[0], "newest": by_age[-1]}


def scope(requested: Sequence[str] | None, known: Sequence[str]) -> list[str]:
    """Requested families without repeats, in order; all of them, sorted, by default."""
    if requested is None:
        return sorted(known)
    unknown = sorted(set(requested) - set(known))
    if unknown:
        raise Refused("unknown_vertical", f"unknown index {', '.join(unknown)}, one of: {', '.join(sorted(known))}")
    return list(dict.fromkeys(requested))
