"""Number expressions.  Every unknown stays NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..vocab import BASKET, HIGHER_IS_BETTER
from .text import ascii_digits, squash

_INF = float("inf")


def _plain_double(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def to_number(c: Column) -> Column:
    """Strict cell: the whole text is a number, or NULL."""
    text = ascii_digits(squash(c))
    return F.when(text.rlike(r"^-?[0-9,]+\.?[0-9]*\z"), _plain_double(text))


def parse_value(c: Column) -> Column:
    """Loose price: the first run of digits; signs and currency glyphs are ignored."""
    return _plain_double(F.regexp_extract(ascii_digits(c), r"[0-9,]+\.?[0-9]*", 0))


def finite(c: Column) -> Column:
    return F.when(~(F.isnan(c) | (F.abs(c) == _INF)), c)


def _absence(a: Column, b: Column) -> Column:
    return (
        F.when(a.isNull() & b.isNull(), "metric_absent_in_both")
        .when(a.isNull(), "metric_absent_in_from")
        .when(b.isNull(), "metric_absent_in_to")
    )


def abs_change(a: Column, b: Column) -> Column:
    """``struct(delta, reason)``: exactly one of the two is set."""
    delta = finite(b - a)
    reason = F.coalesce(_absence(a, b), F.when(delta.isNull(), F.lit("not_finite")))
    return F.struct(delta.alias("delta"), reason.alias("reason"))


def pct_change(a: Column, b: Column) -> Column:
    """``struct(pct, reason)``; a base that is not positive has no percentage."""
    pct = finite(F.when(a > 0, F.try_divide(b - a, a) * 100.0))
    reason = F.coalesce(
        _absence(a, b),
        F.when(a <= 0, F.lit("base_not_positive")),
        F.when(pct.isNull(), F.lit("not_finite")),
    )
    return F.struct(pct.alias("pct"), reason.alias("reason"))


def share(hits: Column, total: Column) -> Column:
    """A share over nothing is unknown, not zero."""
    return F.try_divide(hits.cast("double"), F.nullif(total.cast("double"), F.lit(0.0)))


def is_better(metric: Column, a: Column, b: Column) -> Column:
    return F.when(metric.isin(*HIGHER_IS_BETTER), a > b).otherwise(a < b)


def basket_parts(values: Column, basket: Sequence[tuple[str, int]] = BASKET) -> Column:
    """Map of the known basket parts, each times its multiplier."""
    entries = F.array(*[
        F.struct(F.lit(k).alias("key"), (F.try_element_at(values, F.lit(k)) * float(m)).alias("value"))
        for k, m in basket
    ])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def basket_missing(values: Column, basket: Sequence[tuple[str, int]] = BASKET) -> Column:
    """Basket keys without a value, in basket order."""
    keys = F.array(*[F.when(F.try_element_at(values, F.lit(k)).isNull(), F.lit(k)) for k, _ in basket])
    return F.array_compact(keys)


def monthly_budget(values: Column, basket: Sequence[tuple[str, int]] = BASKET) -> Column:
    """Strict weighted sum: one missing part makes the whole sum NULL."""
    total = F.lit(0.0)
    for key, multiplier in basket:
        total = total + F.try_element_at(values, F.lit(key)) * float(multiplier)
    return total


def savings(values: Column, budget: Column) -> Column:
    return F.round(F.try_element_at(values, F.lit("net_salary")) - budget, 2)


def rent_share(values: Column) -> Column:
    rent = F.try_element_at(values, F.lit("rent_1br_outside"))
    salary = F.try_element_at(values, F.lit("net_salary"))
    return F.round(F.try_divide(rent, F.nullif(salary, F.lit(0.0))) * 100, 1)


def control_ratio(total: Column, local: Column) -> Column:
    """Ours over theirs; NULL unless both are present and not zero."""
    return F.try_divide(F.nullif(total, F.lit(0.0)), F.nullif(local, F.lit(0.0)))
