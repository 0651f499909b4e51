"""Registered queries beside their SQL twins on the smallest tables.

All of them take a quarter of an hour, so a part stands for them by default; ``PANELSPARK_ALL=1`` runs
every query, and ``check.py`` does the same on any scale.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from panelspark.testing import TABLES, canonical

SF = "/root/testdata/sf0.001"
QUICK = [
    "movers_rows", "movers_stats", "movers_dup_keys", "drift_cause", "rank_sorted", "place_tiers", "trend_series",
    "items_keyed", "compare_flat", "ratio_anomalies", "discover_verify", "json_results", "corpus_totals",
    "panel_from_html", "split_place", "links_distinct", "movers_by_view", "movers_odd_figures", "drift_answers",
    "requests_judged", "conservation_checks", "conservation_broken", "charset_pages", "units_from_html", "page_text", "ingest_failures",
]
NAMES = sorted(entry_module.oracle_sql()) if os.environ.get("PANELSPARK_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    theirs = duck.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, theirs.fetchall())


def test_entry_has_a_stable_schema(spark):
    df = entry_module.entry(spark)
    assert df.columns[:5] == ["place", "city", "country", "key", "status"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_page_text_against_a_plain_reading(spark):
    """Checked page by page with the parser of another kind."""
    import hashlib
    import html as html_lib
    import re

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in entry_module.queries()["page_text"](spark, SF).collect()}
    assert set(got) == set(rows)
    for page_id, source in rows.items():
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", source)
        text = re.sub(r"(?s)<!--.*?-->|<![^>]*>|<[/a-zA-Z][^>]*>", " ", text)
        text = re.sub(r"\s+", " ", html_lib.unescape(text)).strip()
        assert got[page_id].digest == hashlib.sha256(text.encode()).hexdigest()
