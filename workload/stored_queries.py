"""Queries over a stored panel of city, country and region slices, and over a resumed ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators import fingerprints
from panelspark.operators.panels import SLICE, as_panel, with_ranks
from panelspark.plans.stored import StoredPanel, store_panel, stored_headers
from panelspark.session import scratch_path
from panelspark.sources.corpus_store import remove_entries, scan_corpus
from panelspark.operators.corpus import expired
from panelspark.streaming.ingest import PAGE_SCHEMA, IngestStopped, ingest_stream, slice_state
from panelspark.vocab import REGIONS

from . import views
from .registry import query
from .sql import COPIED, PANEL
from .views import MONEY, PAGE_ROWS, load

FAMILY = "cost-of-living"
HEADERS = {"city": ["Order Revenue", "Order Count", "Max Order"], "country": ["Order Count", "Order Revenue"],
           "region": ["Max Order", "Order Revenue"]}


def sliced_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by year as cities, their nations as countries, and the customers of each known region."""
    figures = views.customer_figures(spark, sf)
    metric = {"Order Revenue": F.col("revenue"), "Order Count": F.col("orders_n"), "Max Order": F.col("top_order")}
    pick = lambda view: {name: metric[name] for name in HEADERS[view]}
    city = as_panel(figures, label=F.col("label"), snapshot=F.col("snapshot"), metrics=pick("city"))
    # The oldest table had a column less.
    city = city.withColumn("metrics", F.when(F.col("snapshot") == "1995", F.map_filter(
        "metrics", lambda k, v: k != "Max Order")).otherwise(F.col("metrics")))
    nations = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "c_nationkey", F.year("o_orderdate").cast("string").alias("snapshot")
    ).agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("revenue"), F.count(F.lit(1)).cast("double").alias("orders_n"))
    nations = nations.join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    country = as_panel(nations, label=F.col("n_name"), snapshot=F.col("snapshot"), metrics=pick("country"), view="country")
    codes = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    region = as_panel(figures, label=F.col("label"), snapshot=F.col("snapshot"), metrics=pick("region"), view="region")
    region = region.withColumn("region", F.try_element_at(codes, F.lower("country"))).filter("region IS NOT NULL")
    both = city.unionByName(country).unionByName(region)
    return with_ranks(both, [F.try_element_at("metrics", F.lit("Order Revenue")).desc(), F.col("place").asc()])


def stored(spark: SparkSession, sf: str) -> StoredPanel:
    root = scratch_path(spark, "stored")
    panel = sliced_panel(spark, sf)
    labels = lambda names: F.array(*[F.lit(name) for name in names])
    columns = (
        F.when((F.col("view") == "city") & (F.col("snapshot") == "1995"), labels(HEADERS["city"][:2]))
        .when(F.col("view") == "city", labels(HEADERS["city"])).when(F.col("view") == "country", labels(HEADERS["country"]))
        .otherwise(labels(HEADERS["region"]))
    )
    headers = panel.select(*SLICE).distinct().withColumn("columns", columns)
    store_panel(panel, headers, f"{root}/panel", f"{root}/corpus", schema_tag=views.CORPUS_TAG, now=views.now())
    return StoredPanel(spark, f"{root}/panel", f"{root}/corpus")


REGION_CODES = ", ".join(f"('{name}', '{code}')" for name, code in REGIONS.items())
SLICED = "WITH " + PANEL + f""", codes AS (SELECT * FROM (VALUES {REGION_CODES}) t(name, code)),
nations AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS snapshot, n_name AS place,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(count(*) AS DOUBLE) AS orders_n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
sliced AS (
  SELECT 'city' AS "view", '' AS region, snapshot, place, revenue, orders_n,
         CASE WHEN snapshot <> '1995' THEN top_order END AS top_order FROM panel
  UNION ALL SELECT 'country', '', snapshot, place, revenue, orders_n, NULL FROM nations
  UNION ALL SELECT 'region', code, snapshot, place, revenue, NULL, top_order FROM panel JOIN codes ON lower(country) = name),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY "view", region, snapshot ORDER BY revenue DESC, place) AS INTEGER) AS rank,
         CAST(count(*) OVER (PARTITION BY "view", region, snapshot) AS INTEGER) AS "of" FROM sliced),
heads AS (
  SELECT DISTINCT "view", region, snapshot, CASE "view" WHEN 'city' THEN CASE snapshot WHEN '1995' THEN ['Order Revenue', 'Order Count']
    ELSE ['Order Revenue', 'Order Count', 'Max Order'] END WHEN 'country' THEN ['Order Count', 'Order Revenue']
    ELSE ['Max Order', 'Order Revenue'] END AS columns FROM sliced)"""


@query("stored_headers", SLICED + """ SELECT "view", region, snapshot, CAST(unnest(range(len(columns))) AS INTEGER) AS pos,
    unnest(columns) AS "column" FROM heads""")
def stored_headers_query(spark, sf):
    return stored_headers(spark, stored(spark, sf).corpus_path).select("view", "region", "snapshot", "pos", "column")


VIEW_ARGS = (("city", None), ("country", None), ("city", "Asia"))


@query("movers_by_view", SLICED + """, figure AS (
    SELECT "view", region, snapshot, place, rank,
      CASE "view" WHEN 'city' THEN revenue WHEN 'country' THEN orders_n ELSE top_order END AS value
    FROM ranked WHERE "view" <> 'region' OR region = '142'),
    a AS (SELECT * FROM figure WHERE snapshot = '1996'), b AS (SELECT * FROM figure WHERE snapshot = '2000')
    SELECT coalesce(b."view", a."view") AS "view", coalesce(b.place, a.place) AS place,
      CASE WHEN a.place IS NULL THEN 'new' WHEN b.place IS NULL THEN 'delisted' ELSE 'moved' END AS status,
      a.value AS value_from, b.value AS value_to, b.value - a.value AS delta, a.rank AS rank_from, b.rank AS rank_to
    FROM a FULL JOIN b ON a."view" = b."view" AND a.place = b.place""")
def movers_by_view(spark, sf):
    panel, out = stored(spark, sf), None
    for by, region in VIEW_ARGS:
        found = panel.movers(FAMILY, "1996", "2000", by=by, region=region).rows.select(
            F.lit("region" if region else by).alias("view"), "place", "status", "value_from", "value_to", "delta",
            "rank_from", "rank_to")
        out = found if out is None else out.unionByName(found)
    return out


@query("trend_from_store", SLICED + """, asked AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot DESC) - 1 AS pos
      FROM (SELECT DISTINCT snapshot FROM ranked WHERE "view" = 'country'))
    SELECT CAST(pos AS INTEGER) AS pos, a.snapshot, r.place IS NOT NULL AS found, r.place, r.rank, r."of", r.orders_n AS value
    FROM asked a LEFT JOIN ranked r ON r.snapshot = a.snapshot AND "view" = 'country' AND r.place = 'NATION_7'""")
def trend_from_store(spark, sf):
    series = stored(spark, sf).trend(FAMILY, "nation_7", by="country").series
    return series.select("pos", "snapshot", "found", "place", "rank", "of",
                         F.try_element_at("metrics", F.lit("Order Count")).alias("value"))


@query("trend_default_column", SLICED + """ SELECT count(DISTINCT snapshot) AS requested, count(*) FILTER (place = 'NATION_7') AS found_in,
    max(place) FILTER (place = 'NATION_7') AS anchor, 'Order Count' AS "column" FROM ranked WHERE "view" = 'country'""")
def trend_default_column(spark, sf):
    summary = stored(spark, sf).trend(FAMILY, "Nation_7", by="country").summary
    return summary.select("requested", "found_in", "anchor", "column")


@query("stored_series", SLICED + """ SELECT snapshot, place, rank, top_order AS value FROM ranked
    WHERE "view" = 'city' AND snapshot <> '1995'""")
def stored_series(spark, sf):
    return stored(spark, sf).series_of(FAMILY, "Max Order")


@query("stored_sides", SLICED + """ SELECT side, s.snapshot, (SELECT CAST(count(*) AS INTEGER) FROM sliced WHERE "view" = 'country'
    AND sliced.snapshot = s.snapshot) AS rows, 86400::BIGINT AS age_s, false AS archival
    FROM (VALUES ('from', '1996'), ('to', '2000')) s(side, snapshot)""")
def stored_sides(spark, sf):
    panel = stored(spark, sf)
    later = (views.now() + F.expr("INTERVAL 1 DAY")).cast("timestamp")
    return panel.movers(FAMILY, "1996", "2000", by="country").sides(panel.entries(FAMILY, "country"), later)


# ------------------------------------------------------------------------- drift

CASES = (
    ("1996", "2000", ("1995", "1996", "1997", "2000")),
    ("1997", "2003", ("1995", "1996", "1997", "2003")),
    ("2004-mid", "2003", ("1997", "2003", "2004-mid")),  # 1995 lies in the panel, but is not published
    ("1997", "2003", ("1997", "2003")),
)
CASE_SQL = ", ".join(f"({i}, '{a}', '{b}', [{', '.join(repr(p) for p in pub)}])" for i, (a, b, pub) in enumerate(CASES))


@query("drift_answers", "WITH " + COPIED + f""", cases AS (SELECT * FROM (VALUES {CASE_SQL}) t(case_no, frm, tos, pub)),
    probed AS (SELECT *, list_min(list_filter(pub, lambda p: p <> frm AND p <> tos)) AS target FROM cases)
    SELECT case_no, x.fp = y.fp AS identical_tables, CASE WHEN x.fp <> y.fp THEN NULL WHEN target IS NULL THEN 'identical_tables_cause_unknown'
      WHEN p.fp = y.fp THEN 'snapshot_parameter_ignored' ELSE 'same_published_table' END AS drift,
      CASE WHEN x.fp = y.fp THEN target END AS probe_snapshot, CASE WHEN x.fp = y.fp THEN p.n_rows END AS probe_rows
    FROM probed JOIN prints x ON x.snapshot = frm JOIN prints y ON y.snapshot = tos LEFT JOIN prints p ON p.snapshot = target""")
def drift_answers(spark, sf):
    panel, out = views.copied_panel(spark, sf), None
    prints = fingerprints.panel_fingerprints(panel)
    for i, (frm, to, published) in enumerate(CASES):
        row = fingerprints.drift_cause(prints, frm, to, published).withColumn("case_no", F.lit(i))
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------------------ ingest

BROKEN, EMPTY, MISSING = 5, 3, 1


def write_pages(pages: DataFrame, path: str, *, only: int | None = None, mended: bool = False) -> None:
    """Ranking pages of all years as files, each block of entities a family of its own; some broken, some without a table, some missing.

    ``only`` keeps the blocks with that remainder of 7; ``mended`` gives these a page that can be read.
    """
    kind = F.col("block") % 7
    if only is not None:
        pages = pages.filter(kind == only)
    if mended:
        row = F.concat(F.lit("<tr><td></td><td>Town "), F.col("block").cast("string"), F.lit(", X</td><td>"), "snapshot", F.lit("</td></tr>"))
        html = F.concat(F.lit("<table id='t2'><tr><th>Rank</th><th>City</th><th>Order Revenue</th></tr>"), row, F.lit("</table>"))
    else:
        html = F.when(kind != MISSING, F.col("html"))
    item_no = F.col("block") * 10_000 + F.col("snapshot").cast("int") + (500_000_000 if mended else 0)
    pages.select(
        F.concat(F.lit("block-"), F.col("block").cast("string")).alias("vertical"), F.lit("city").alias("view"),
        F.lit("").alias("region"), "snapshot", item_no.cast("bigint").alias("item_no"), html.alias("html"),
    ).write.mode("append").parquet(path)


def run_stream(spark: SparkSession, root: str) -> bool:
    """Whether the run was stopped by pages of another layout."""
    try:
        ingest_stream(
            spark, f"{root}/pages", panel_path=f"{root}/panel", corpus_path=f"{root}/corpus", report_path=f"{root}/reports",
            checkpoint=f"{root}/checkpoint", schema_tag=views.CORPUS_TAG, now=views.now())
    except IngestStopped:
        return True
    return False


PAGES = "WITH " + PANEL + f""", pages_of AS (
    SELECT snapshot, (rank - 1) // {PAGE_ROWS} AS block, ((rank - 1) // {PAGE_ROWS}) % 7 AS kind,
      CAST(count(*) FILTER (orders_n <> 5) AS INTEGER) AS n_rows FROM panel GROUP BY ALL)"""


@query("ingest_failures", PAGES + f""" SELECT 'block-' || CAST(block AS VARCHAR) AS vertical, snapshot,
    CASE kind WHEN {BROKEN} THEN 'unresolved' WHEN {EMPTY} THEN 'empty' WHEN {MISSING} THEN 'failed' ELSE 'ok' END AS outcome,
    CASE kind WHEN {BROKEN} THEN 2 WHEN {MISSING} THEN 1 ELSE 0 END AS tries, kind = {BROKEN} AS waits, false AS moved FROM pages_of""")
def ingest_failures(spark, sf):
    root = scratch_path(spark, "ingest")
    write_pages(views.ranking_pages(spark, sf), f"{root}/pages")
    run_stream(spark, root)
    run_stream(spark, root)  # nothing new: the pages that wait are tried again
    state = slice_state(spark, f"{root}/checkpoint")
    return state.select("vertical", "snapshot", "outcome", "tries", F.col("html").isNotNull().alias("waits"), "moved")


@query("ingest_resume", PAGES + f""" SELECT 'block-' || CAST(block AS VARCHAR) AS vertical, snapshot,
    CASE WHEN kind IN ({BROKEN}, {MISSING}, 0) THEN 1 ELSE n_rows END AS n_rows, kind = 0 AND n_rows > 0 AS moved,
    CASE WHEN kind IN ({BROKEN}, {MISSING}, 0) THEN 'Order Revenue' ELSE 'Order Revenue;Order Count' END AS columns
    FROM pages_of WHERE kind <> {EMPTY}""")
def ingest_resume(spark, sf):
    root = scratch_path(spark, "resume")
    ranked = views.ranking_pages(spark, sf)  # ranked and stored once, read by all four
    write_pages(ranked, f"{root}/pages")
    run_stream(spark, root)
    for kind in (BROKEN, MISSING, 0):  # the last one changes tables that were stored before
        write_pages(ranked, f"{root}/pages", only=kind, mended=True)
    run_stream(spark, root)
    return scan_corpus(spark, f"{root}/corpus").select(
        "vertical", "snapshot", "n_rows", "moved", F.array_join("columns", ";").alias("columns"))


@query("retention_applied", SLICED + """ SELECT "view", region, snapshot FROM heads WHERE snapshot >= '1999' OR "view" = 'country'""")
def retention_applied(spark, sf):
    panel = stored(spark, sf)
    aged = F.when(F.col("snapshot") < "1999", F.lit("2020-01-01 00:00:00").cast("timestamp")).otherwise(views.now())
    entries = scan_corpus(spark, panel.corpus_path).drop("file_mtime").withColumns(
        {"written_at": aged, "keep": F.col("view") == "country"})
    from panelspark.sources.corpus_store import write_entries

    write_entries(entries, panel.corpus_path)
    remove_entries(spark, panel.corpus_path, expired(views.now()))
    return scan_corpus(spark, panel.corpus_path).select("view", "region", "snapshot")


__all__ = ["PAGE_SCHEMA", "sliced_panel", "stored"]
