import random

import pytest
from helpers import column, one
from pyspark.sql import functions as F

from panelspark.operators import budgets, discovery, items
from panelspark.plans.compare import compare, display_keys, run_status, side_by_side
from panelspark.sources import sinks
from panelspark.vocab import ITEM_KEYS, ITEM_SPELLINGS

SCHEMA = "entity string, country string, pos int, label string, value_text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def greedy(labels, spellings):
    """Page order, declared spelling order, a key is taken once."""
    taken = {}
    for pos, label in enumerate(labels):
        for spelling, key in spellings:
            if key not in taken and spelling in label:
                taken[key] = pos
                break
    return taken


def test_every_row_takes_its_first_free_key(spark):
    rng = random.Random(5)
    words = ["ab", "bc", "c", "d", "zz"]
    spellings = [("ab", "k1"), ("bc", "k2"), ("c", "k1"), ("d", "k3"), ("b", "k4")]
    pages = {f"e{i}": ["".join(rng.choice(words) for _ in range(3)) for _ in range(rng.randint(1, 40))] for i in range(60)}
    rows = [(e, "x", i, label, "$1") for e, labels in pages.items() for i, label in enumerate(labels)]
    got = {}
    for r in items.keyed_items(table(spark, rows).repartition(5), spellings).collect():
        got.setdefault(r.entity, {})[r.key] = r.pos
    want = {e: t for e, labels in pages.items() if (t := greedy(labels, spellings))}
    assert got == want


def test_one_entity_with_very_many_rows(spark):
    rows = spark.range(50_000).select(
        F.lit("hot").alias("entity"), F.lit("x").alias("country"), F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") == 40_000, "Cinema Ticket").otherwise("Cappuccino").alias("label"), F.lit("$2").alias("value_text"),
    )
    assert sorted((r.key, r.pos) for r in items.keyed_items(rows).collect()) == [("cappuccino", 0), ("cinema", 40_000)]


def _page(spark, imperial):
    spelled = {}
    for spelling, key in ITEM_SPELLINGS:
        wanted = ("Square Feet" in spelling or "1 mile" in spelling) if imperial else True
        if key not in spelled or wanted and not imperial and "Square Feet" not in spelling and "mile" not in spelling:
            spelled[key] = spelling
    rows = [("Here", "X", i, f"{label}, note", "$10.00") for i, label in enumerate(spelled.values())]
    return table(spark, rows)


def test_both_unit_systems_give_the_same_keys(spark):
    for imperial, system in ((True, "imperial"), (False, "metric")):
        record = one(items.price_records(_page(spark, imperial)))
        assert set(record["values"]) == set(ITEM_KEYS) and record.measurement_system == system
        scaled = {"buy_sqm_center": 107.639, "buy_sqm_outside": 107.639, "taxi_km": 6.2137}
        for key, value in record["values"].items():
            assert value == (scaled.get(key, 10.0) if imperial else 10.0)
        assert set(record.converted) == (set(scaled) if imperial else set())
    as_served = one(items.price_records(_page(spark, True), units="source"))
    assert as_served["values"]["taxi_km"] == 10.0 and as_served.converted == {}
    with pytest.raises(ValueError):
        items.price_records(_page(spark, True), units="stone")


def test_two_kinds_of_absence(spark):
    rows = [("A", "X", 0, "Cinema Ticket", "?"), ("A", "X", 1, "Cappuccino", "$3"), ("A", "X", 2, "Taxi 1km", "$1")]
    records = items.price_records(table(spark, rows))
    report = one(items.missing_report(records, ["cinema", "cappuccino", "taxi_km"]))
    assert (report.unmatched, report.blank) == (["taxi_km"], ["cinema"])
    failed = records.withColumn("error", F.lit("unreadable"))
    assert tuple(one(items.missing_report(failed))[1:]) == ([], [])
    assert len(one(items.missing_report(records)).unmatched) == 19


FULL = {
    "1 Bedroom Apartment Outside of City Centre": "300", "Basic Utilities for 85 m2": "40", "Broadband Internet": "10",
    "Mobile Phone Plan": "5", "Monthly Public Transport Pass": "15", "Meal at an Inexpensive Restaurant": "3",
    "Average Monthly Net Salary": "700",
}


def _entity(name, **changes):
    page = {**FULL, **{k.replace("_", " "): v for k, v in changes.items()}}
    return [(name, "X", i, label, f"${v}" if v != "?" else v) for i, (label, v) in enumerate(page.items())]


def test_compare(spark):
    rows = _entity("Full") + _entity("Short", Broadband_Internet="?") + _entity("Poor", Average_Monthly_Net_Salary="0")
    control = spark.createDataFrame([("Full", 500.0), ("Short", 400.0), ("Poor", 0.0)], "entity string, local double")
    errors = spark.createDataFrame([("Lost", "unknown_entity", "no page", "check")], "entity string, kind string, error string, remedy string")
    records = compare(table(spark, rows), errors=errors, control=control)
    got = {r.entity: r for r in records.collect()}
    full = got["Full"]
    assert (full.budget, full.savings, full.rent_to_income_pct, full.ratio, full.missing) == (460.0, 240.0, 42.9, 0.92, [])
    assert (got["Short"].budget, got["Short"].missing, got["Short"].ratio) == (None, ["internet"], None)
    assert (got["Poor"].rent_to_income_pct, got["Poor"].ratio, got["Poor"].savings) == (None, None, -460.0)
    assert got["Lost"].budget is None and got["Lost"].kind == "unknown_entity" and len(got["Lost"].missing) == 6
    assert one(run_status(records)).status == 0 and one(run_status(records.filter("entity = 'Lost'"))).status == 1
    assert column(records.orderBy(*budgets.budget_order()), "entity")[:2] == ["Full", "Poor"]
    flat = {r.slug: r for r in sinks.comparison_rows(records, display_keys()).collect()}
    assert flat["Full"].missing is None and flat["Short"].missing == "internet" and flat["Full"].cheap_meal == 3.0
    wide = {r.metric: r for r in side_by_side(records, ["Full", "Short"]).collect()}
    assert (wide["budget"].Full, wide["budget"].Short, wide["mobile"].Short) == (460.0, None, 5.0)
    assert len(display_keys(full=True)) == 21


def test_best_needs_two_values_and_knows_the_direction(spark):
    rows = [("A", "budget", 5.0), ("B", "budget", 4.0), ("A", "net_salary", 5.0), ("B", "net_salary", 4.0),
            ("A", "mobile", 5.0), ("B", "mobile", None), ("A", "monthly_savings", -1.0), ("B", "monthly_savings", -2.0)]
    long = spark.createDataFrame(rows, "entity string, metric string, value double")
    best = {r.metric: r.best for r in budgets.best_of(long).collect()}
    assert best == {"budget": 4.0, "net_salary": 5.0, "mobile": None, "monthly_savings": -1.0}
    marked = {(r.entity, r.metric) for r in budgets.mark_best(long).filter("is_best").collect()}
    assert marked == {("B", "budget"), ("A", "net_salary"), ("A", "monthly_savings")}


@pytest.mark.parametrize("ratios,flagged", [
    ([0.8, 0.9, 0.85, 0.2], {"e3": 0.242}), ([0.8, 0.9, 0.85], {}), ([0.5, 5.0], {}), ([0.0, 0.0, 3.0], {}),
    ([1.0, 1.0, 1.0, 1.6, 0.6], {}), ([1.0, 1.0, 1.0, 1.61, 0.59], {"e3": 1.61, "e4": 0.59}), ([1.0, 1.0, None, 9.0], {"e3": 9.0}),
])
def test_ratio_anomalies(spark, ratios, flagged):
    df = spark.createDataFrame([(f"e{i}", r) for i, r in enumerate(ratios)], "entity string, ratio_exact double")
    assert {r.entity: r.deviation for r in budgets.ratio_anomalies(df).collect()} == flagged


# ------------------------------------------------------------------------- discovery


def test_unset_bounds_are_left_out_and_zero_is_a_bound(spark):
    df = spark.createDataFrame([("a", 0.0, -1.0), ("b", 5.0, 3.0), ("c", None, 9.0)], "slug string, cost_usd double, temperature_c double")
    assert column(discovery.search(df), "slug") == ["a", "b", "c"]
    assert column(discovery.search(df, max_cost_usd=0), "slug") == ["a"]
    assert column(discovery.search(df, min_temperature_c=0, max_temperature_c=5), "slug") == ["b"]
    cut = discovery.cut_with_counts(df, [F.col("slug")], 2).collect()
    assert [(r.slug, r.total_matching, r.returned) for r in cut] == [("a", 3, 2), ("b", 3, 2)]
    assert discovery.cut_with_counts(df, [F.col("slug")], 100).count() == 3
    with pytest.raises(ValueError):
        discovery.cut_with_counts(df, [F.col("slug")], 101)


def test_lookup_hides_private_fields(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "slug string, _age int, note string")
    assert [tuple(r) for r in discovery.field_rows(df, "a").collect()] == [("note", None), ("slug", "a")]


def test_links(spark):
    html = """<a href="/cost-of-living/in/Da-Nang">x</a><a href='/cost-of-living/in/Xi'an'>y</a> /cost-of-living/in/Da-Nang"""
    pages = spark.createDataFrame([(html,), ("nothing",)], "html string")
    assert column(discovery.link_slugs(pages), "slug") == ["Da-Nang", "Xi'an"]
