"""Queries over price items: keys, units, budgets, comparison, control, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions import numbers as num
from panelspark.operators import budgets, discovery, items
from panelspark.plans.compare import compare, display_keys, side_by_side
from panelspark.sources.sinks import comparison_rows, flat_columns
from panelspark.vocab import DEFAULT_ITEM_KEYS

from .registry import query
from .sql import ENTITIES, ITEMS
from .views import control_figures, customer_entities, event_meetups, price_items, supplier_entities

SQL = "WITH " + ITEMS


def _records(spark: SparkSession, sf: str, control: bool = False) -> DataFrame:
    return compare(price_items(spark, sf), control=control_figures(spark, sf) if control else None)


@query("items_keyed", SQL + " SELECT entity, key, CAST(pos AS INTEGER) AS pos, label, value_text, value FROM keyed")
def items_keyed(spark, sf):
    return items.keyed_items(price_items(spark, sf))


@query("units_normalised", SQL + """ SELECT entity, measurement_system, key, value,
    measurement_system = 'imperial' AND value IS NOT NULL AND key IN ('buy_sqm_center', 'buy_sqm_outside', 'taxi_km')
      AS converted FROM figures WHERE key IN ('buy_sqm_center', 'buy_sqm_outside', 'taxi_km', 'cinema')""")
def units_normalised(spark, sf):
    records = items.price_records(price_items(spark, sf))
    long = records.select("entity", "measurement_system", "converted", F.explode("values").alias("key", "value"))
    wanted = long.filter(F.col("key").isin("buy_sqm_center", "buy_sqm_outside", "taxi_km", "cinema"))
    return wanted.select(
        "entity", "measurement_system", "key", "value",
        F.coalesce(F.map_contains_key("converted", F.col("key")), F.lit(False)).alias("converted"),
    )


@query("units_as_served", SQL + " SELECT entity, key, value FROM keyed WHERE key IN ('buy_sqm_center', 'taxi_km')")
def units_as_served(spark, sf):
    records = items.price_records(price_items(spark, sf), units="source")
    long = records.select("entity", F.explode("values").alias("key", "value"))
    return long.filter(F.col("key").isin("buy_sqm_center", "taxi_km"))


@query("missing_report", SQL + """ SELECT s.entity,
    coalesce(string_agg(k.key, ';' ORDER BY k.key) FILTER (f.key IS NULL), '') AS unmatched,
    coalesce(string_agg(k.key, ';' ORDER BY k.key) FILTER (f.key IS NOT NULL AND f.value IS NULL), '') AS blank
    FROM systems s CROSS JOIN (SELECT unnest(item_keys) AS key FROM labels) k
    LEFT JOIN figures f ON f.entity = s.entity AND f.key = k.key GROUP BY s.entity""")
def missing_report(spark, sf):
    report = items.missing_report(items.price_records(price_items(spark, sf)))
    return report.select("entity", F.array_join("unmatched", ";").alias("unmatched"), F.array_join("blank", ";").alias("blank"))


@query("budget_strict", SQL + " SELECT entity, country, budget FROM budgets")
def budget_strict(spark, sf):
    return _records(spark, sf).select("entity", "country", "budget")


@query("budget_breakdown", SQL + """ SELECT b.entity, b.budget, b.missing, b.n_parts,
    (SELECT f.value * 30 FROM figures f WHERE f.entity = b.entity AND f.key = 'cheap_meal') AS meals FROM budgets b""")
def budget_breakdown(spark, sf):
    return _records(spark, sf).select(
        "entity", "budget", F.array_join("missing", ";").alias("missing"), F.size("parts").alias("n_parts"),
        F.try_element_at("parts", F.lit("cheap_meal")).alias("meals"),
    )


@query("savings_and_rent_share", SQL + " SELECT entity, savings, rent_to_income_pct FROM records")
def savings_and_rent_share(spark, sf):
    return _records(spark, sf).select("entity", "savings", "rent_to_income_pct")


@query("budget_order", SQL + " SELECT entity, budget FROM budgets")
def budget_order(spark, sf):
    return _records(spark, sf).select("entity", "budget").orderBy(*budgets.budget_order())


SHOWN = ", ".join(f"'{k}'" for k in DEFAULT_ITEM_KEYS)
LONG = SQL + f""", long AS (
    SELECT s.entity, k.metric, f.value FROM systems s CROSS JOIN (SELECT unnest([{SHOWN}]) AS metric) k
    LEFT JOIN figures f ON f.entity = s.entity AND f.key = k.metric
    UNION ALL SELECT entity, 'budget', budget FROM records
    UNION ALL SELECT entity, 'rent_to_income', rent_to_income_pct FROM records
    UNION ALL SELECT entity, 'monthly_savings', savings FROM records),
    best AS (SELECT metric, CASE WHEN count(value) >= 2 THEN CASE WHEN metric IN ('net_salary', 'monthly_savings')
      THEN max(value) ELSE min(value) END END AS best FROM long GROUP BY metric)"""


@query("best_of", LONG + " SELECT * FROM best")
def best_of(spark, sf):
    return budgets.best_of(budgets.long_figures(_records(spark, sf), display_keys()))


@query("best_marked", LONG + " SELECT entity, metric, value FROM long JOIN best USING (metric) WHERE value = best")
def best_marked(spark, sf):
    marked = budgets.mark_best(budgets.long_figures(_records(spark, sf), display_keys()))
    return marked.filter("is_best").select("entity", "metric", "value")


@query("compare_side_by_side", LONG + """ SELECT metric,
    max(value) FILTER (entity = 'Supplier-000000003') AS "Supplier-000000003",
    max(value) FILTER (entity = 'Supplier-000000005') AS "Supplier-000000005",
    max(value) FILTER (entity = 'Supplier-000000008') AS "Supplier-000000008" FROM long GROUP BY metric""")
def compare_side_by_side(spark, sf):
    chosen = [f"Supplier-00000000{i}" for i in (3, 5, 8)]
    return side_by_side(_records(spark, sf), chosen)


FLAT = SQL + " SELECT c.entity AS slug, c.country, " + ", ".join(
    f"(SELECT f.value FROM figures f WHERE f.entity = c.entity AND f.key = '{k}') AS {k}" for k in DEFAULT_ITEM_KEYS
) + """, c.budget, c.savings, c.rent_to_income_pct, c.control_local, round(c.ratio_exact, 3) AS ratio,
    nullif(c.missing, '') AS missing FROM checked c"""


@query("compare_flat", FLAT)
def compare_flat(spark, sf):
    return comparison_rows(_records(spark, sf, control=True), display_keys()).select(*flat_columns(display_keys()))


@query("crosscheck", SQL + " SELECT entity, budget, control_local, round(ratio_exact, 3) AS ratio FROM checked")
def crosscheck(spark, sf):
    return _records(spark, sf, control=True).select("entity", "budget", "control_local", "ratio")


@query("ratio_anomalies", SQL + """, m AS (SELECT median(ratio_exact) AS median_ratio, count(ratio_exact) AS n FROM checked)
    SELECT entity, median_ratio, round(ratio_exact / median_ratio, 3) AS deviation FROM checked, m
    WHERE n >= 3 AND median_ratio <> 0 AND ratio_exact IS NOT NULL
      AND NOT (ratio_exact / median_ratio BETWEEN 0.6 AND 1.6)""")
def ratio_anomalies(spark, sf):
    found = budgets.ratio_anomalies(_records(spark, sf, control=True))
    return found.select("entity", "median_ratio", "deviation")


@query("ratio_anomalies_by_system", SQL + """, c AS (SELECT * FROM checked JOIN (SELECT entity, measurement_system FROM systems) USING (entity)),
    m AS (SELECT measurement_system, median(ratio_exact) AS median_ratio, count(ratio_exact) AS n FROM c GROUP BY 1)
    SELECT entity, measurement_system, median_ratio, round(ratio_exact / median_ratio, 3) AS deviation
    FROM c JOIN m USING (measurement_system) WHERE n >= 3 AND median_ratio <> 0 AND ratio_exact IS NOT NULL
      AND NOT (ratio_exact / median_ratio BETWEEN 0.6 AND 1.6)""")
def ratio_anomalies_by_system(spark, sf):
    found = budgets.ratio_anomalies(_records(spark, sf, control=True), ["measurement_system"])
    return found.select("entity", "measurement_system", "median_ratio", "deviation")


# -------------------------------------------------------------------- discovery


@query("discover_filter", "WITH " + ENTITIES + """, hit AS (SELECT * FROM entities WHERE cost_usd <= 3000 AND region = 'ASIA'
      AND internet_mbps >= 10 AND safety >= 0 AND temperature_c >= -5 AND temperature_c <= 15)
    SELECT slug, country, cost_usd, total_matching, returned FROM (SELECT *, count(*) OVER () AS total_matching,
      least(count(*) OVER (), 30) AS returned FROM hit ORDER BY cost_usd, slug LIMIT 30)""")
def discover_filter(spark, sf):
    hits = discovery.search(
        customer_entities(spark, sf), max_cost_usd=3000, region="ASIA", min_internet_mbps=10, min_safety=0,
        min_temperature_c=-5, max_temperature_c=15,
    )
    cut = discovery.cut_with_counts(hits, [F.col("cost_usd"), F.col("slug")], 30)
    return cut.select("slug", "country", "cost_usd", "total_matching", "returned")


SUPPLIERS = """, found AS (
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 AND s_acctbal < 0 THEN 'O' || replace(s_name, '#', '-')
             ELSE replace(s_name, '#', '-') END AS slug_guess
    FROM supplier)"""


@query("discover_verify", SQL + SUPPLIERS + """ SELECT s_suppkey, slug_guess, budget AS verified_budget, b.missing AS verified_missing,
    CASE WHEN b.entity IS NULL THEN 'no price page for ''' || slug_guess || '''' END AS verify_error
    FROM found LEFT JOIN budgets b ON b.entity = slug_guess""")
def discover_verify(spark, sf):
    checked = discovery.verify(supplier_entities(spark, sf), _records(spark, sf))
    return checked.select(
        "s_suppkey", "slug_guess", "verified_budget", F.array_join("verified_missing", ";").alias("verified_missing"),
        "verify_error",
    )


@query("slug_guess", "WITH x AS (SELECT 1)" + SUPPLIERS + " SELECT s_suppkey, slug_guess FROM found")
def slug_guess(spark, sf):
    return discovery.with_slug_guess(supplier_entities(spark, sf)).select("s_suppkey", "slug_guess")


@query("entity_lookup", "WITH " + ENTITIES + """, one AS (SELECT * FROM entities WHERE slug = 'customer-000000042')
    SELECT 'cost_usd' AS field, CAST(cost_usd AS VARCHAR) AS value FROM one UNION ALL SELECT 'country', country FROM one
    UNION ALL SELECT 'internet_mbps', CAST(internet_mbps AS VARCHAR) FROM one UNION ALL SELECT 'name', name FROM one
    UNION ALL SELECT 'region', region FROM one UNION ALL SELECT 'safety', CAST(safety AS VARCHAR) FROM one
    UNION ALL SELECT 'slug', slug FROM one UNION ALL SELECT 'temperature_c', CAST(temperature_c AS VARCHAR) FROM one""")
def entity_lookup(spark, sf):
    return discovery.field_rows(customer_entities(spark, sf), "customer-000000042")


@query("upcoming", """SELECT event_id, ts, event_type AS city, 'C' || CAST(user_id % 5 AS VARCHAR) AS country FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' AND event_type = 'purchase' AND user_id % 5 = 2
    ORDER BY ts, event_id LIMIT 20""")
def upcoming(spark, sf):
    found = discovery.upcoming(
        event_meetups(spark, sf), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), city="purchase", country="C2", days_ahead=3
    )
    return found.select("event_id", "ts", "city", "country")


@query("upcoming_counted", """WITH u AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10')
    SELECT event_id, count(*) OVER () AS total_matching, least(count(*) OVER (), 50) AS returned FROM u ORDER BY ts, event_id LIMIT 50""")
def upcoming_counted(spark, sf):
    """A cut list of fifty says how many there are."""
    found = discovery.upcoming(event_meetups(spark, sf), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), limit=50)
    return found.select("event_id", "total_matching", "returned")


@query("upcoming_all", """SELECT event_id, ts, count(*) OVER () AS total_matching FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND event_type = 'purchase'""")
def upcoming_all(spark, sf):
    found = discovery.upcoming(
        event_meetups(spark, sf), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), city="purchase", limit=None)
    return found.select("event_id", "ts", "total_matching")


# ---------------------------------------------------------------------- scalars

CELLS = """WITH cells AS (
    SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN '?' WHEN 2 THEN 'N/A' WHEN 3 THEN '12abc'
      WHEN 4 THEN ' -' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5 '
      WHEN 5 THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' / mo'
      WHEN 6 THEN '' ELSE '1,' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS cell FROM lineitem)"""


def _cells(spark, sf) -> DataFrame:
    from .views import load

    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    n = F.col("l_linenumber")
    cell = (
        F.when(n == 1, "?").when(n == 2, "N/A").when(n == 3, "12abc")
        .when(n == 4, F.concat(F.lit(" -"), F.col("l_quantity").cast("int").cast("string"), F.lit(".5 ")))
        .when(n == 5, F.concat(F.lit("$"), price, F.lit(" / mo")))
        .when(n == 6, "").otherwise(F.concat(F.lit("1,"), price))
    )
    return lines.withColumn("cell", cell)


@query("to_number", CELLS + """ SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN regexp_full_match(trim(cell), '-?[0-9,]+\\.?[0-9]*') THEN TRY_CAST(replace(trim(cell), ',', '') AS DOUBLE) END AS value
    FROM cells""")
def to_number(spark, sf):
    return _cells(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", num.to_number(F.col("cell")).alias("value"))


@query("parse_value", CELLS + """ SELECT l_orderkey, l_linenumber, l_partkey,
    TRY_CAST(replace(regexp_extract(cell, '[0-9,]+\\.?[0-9]*'), ',', '') AS DOUBLE) AS value FROM cells""")
def parse_value(spark, sf):
    return _cells(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", num.parse_value(F.col("cell")).alias("value"))
