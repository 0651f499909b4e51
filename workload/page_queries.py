"""Queries over pages, result sets and files: reading in, writing out, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions.text import join_key, norm_label, split_place, squash
from panelspark.operators import diffing, discovery, items, panels
from panelspark.session import scratch_path
from panelspark.sources import pages as page_source
from panelspark.sources import results, sinks
from panelspark.sources.corpus_store import scan_corpus
from panelspark.streaming.ingest import ingest_stream

from . import views
from .panel_queries import MOVERS, _comparison
from .registry import query
from .sql import ENTITIES, ITEMS, PANEL
from .views import PAGE_ROWS, load


@query("links_distinct", """SELECT DISTINCT rtrim(s, '''"') AS slug FROM (
    SELECT unnest(regexp_extract_all(html, 'href="/([A-Za-z0-9\\-'']+)', 1)) AS s FROM pages)""")
def links_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.link_slugs(load(spark, sf, "pages"), 'href="/')


#: Script, style and comment go with what they hold, every tag parts the text, and the few named characters are put in.
VISIBLE = r"""regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?(</(script|style)\s*>|$)|<!--.*?-->', '<>', 'g'), '(?s)<[^>]*>', ' ', 'g')"""
NAMED = f"""replace(replace(replace(replace({VISIBLE}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""
PAGE_TEXT = rf"""WITH t AS (SELECT page_id, trim(regexp_replace({NAMED}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g')) AS text FROM pages)
    SELECT page_id, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS digest FROM t"""


@query("page_text", PAGE_TEXT)
def page_text(spark, sf):
    texts = page_source.visible_text(load(spark, sf, "pages"))
    return texts.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


@query("squashed_text", f"""SELECT doc_id, md5(trim(regexp_replace(text, '{SPACE}', ' ', 'g'))) AS digest FROM documents""")
def squashed_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(squash(F.col("text"))).alias("digest"))


@query("norm_label", """SELECT doc_id,
    md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS digest FROM documents""")
def normalised(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(norm_label(F.col("text"))).alias("digest"))


@query("split_place", """WITH p AS (SELECT c_custkey, list_filter(list_transform(string_split(
      CASE c_nationkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || ',  ' || n_name
        WHEN 2 THEN c_name || ', , ' || n_name || ' ,' || r_name ELSE ' ,, ' END, ','), lambda x: trim(x)), lambda x: x <> '') AS parts
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, CASE WHEN len(parts) = 0 THEN ',,' ELSE array_to_string(parts, ', ') END AS place,
      coalesce(parts[1], '') AS city,
      CASE WHEN len(parts) > 2 THEN array_to_string(parts[2:len(parts) - 1], ', ') ELSE '' END AS subdivision,
      CASE WHEN len(parts) > 1 THEN parts[-1] ELSE '' END AS country FROM p""")
def split_places(spark, sf):
    base = (
        load(spark, sf, "customer")
        .join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    kind = F.col("c_nationkey") % 4
    label = (
        F.when(kind == 0, F.col("c_name")).when(kind == 1, F.concat("c_name", F.lit(",  "), "n_name"))
        .when(kind == 2, F.concat("c_name", F.lit(", , "), "n_name", F.lit(" ,"), "r_name")).otherwise(" ,, ")
    )
    return base.select("c_custkey", split_place(label).alias("p")).select("c_custkey", "p.*")


@query("join_keys", "WITH " + PANEL + " SELECT DISTINCT place, key FROM panel")
def join_keys(spark, sf):
    return views.customer_panel(spark, sf).select("place", join_key(F.col("place")).alias("key")).distinct()


# ------------------------------------------------------------------ ranking pages

BLOCKS = "WITH " + PANEL + f""", numbered AS (
    SELECT *, CAST((rank - 1) // {PAGE_ROWS} AS INTEGER) AS block, (rank - 1) % {PAGE_ROWS} + 1 AS line FROM panel),
    good AS (SELECT * FROM numbered WHERE block % 7 NOT IN (3, 5))"""


@query("page_status", BLOCKS + """ SELECT snapshot, block, CASE block % 7 WHEN 3 THEN 'no_such_selection'
    WHEN 5 THEN 'layout_changed' ELSE 'ok' END AS page_status FROM numbered GROUP BY 1, 2""")
def page_status(spark, sf):
    return page_source.triage(views.ranking_pages(spark, sf)).select("snapshot", "block", "page_status")


@query("html_tables", BLOCKS + """ SELECT snapshot, block, 0 AS table_no, CASE block % 7 WHEN 5 THEN 't9' ELSE 'nav' END AS id,
      '' AS header, 1 AS n_rows FROM numbered WHERE block % 7 <> 3 GROUP BY 1, 2
    UNION ALL SELECT snapshot, block, 1, 't2', 'Rank;City;Order Revenue;Order Count', CAST(count(*) AS INTEGER) FROM good GROUP BY 1, 2""")
def html_tables(spark, sf):
    found = page_source.html_tables(views.ranking_pages(spark, sf))
    return found.select(
        "snapshot", "block", "table_no", "id", F.array_join("header", ";").alias("header"), F.size("rows").alias("n_rows")
    )


@query("panel_from_html", BLOCKS + """ SELECT snapshot, block, CAST(line AS INTEGER) AS rank,
      CAST(row_number() OVER (PARTITION BY snapshot, block ORDER BY line) AS INTEGER) AS row_no, place, city, subdivision, country,
      key AS place_key, revenue, CASE WHEN orders_n <> 1 THEN orders_n END AS orders_n, 'Order Revenue;Order Count' AS columns
    FROM good WHERE orders_n <> 5""")
def panel_from_html(spark, sf):
    rows = page_source.ranking_rows(page_source.triage(views.ranking_pages(spark, sf)), ["snapshot", "block"])
    metric = lambda name, out: F.try_element_at("metrics", F.lit(name)).alias(out)
    return rows.select(
        "snapshot", "block", "rank", "row_no", "place", "city", "subdivision", "country", "place_key",
        metric("Order Revenue", "revenue"), metric("Order Count", "orders_n"), F.array_join("columns", ";").alias("columns"),
    )


@query("snapshot_options", BLOCKS + """ SELECT snapshot AS page, block, CAST(pos AS INTEGER) AS pos, id AS snapshot
    FROM (SELECT DISTINCT snapshot, block FROM good), (VALUES (0, '1996'), (1, '1997-mid')) t(pos, id)""")
def snapshot_options(spark, sf):
    pages = views.ranking_pages(spark, sf).withColumnRenamed("snapshot", "page")
    return page_source.snapshot_options(pages, ["page", "block"])


# -------------------------------------------------------------------- price pages

PRICE_PAGES = "WITH " + ITEMS + """, paged AS (
    SELECT *, CAST(right(entity, 3) AS INTEGER) % 10 AS kind FROM items)"""


@query("items_from_html", PRICE_PAGES + """ SELECT entity, CASE WHEN country LIKE '%\\_0%' ESCAPE '\\' THEN 'NATION ' ELSE 'NATION' END AS country,
    CAST(row_number() OVER (PARTITION BY entity ORDER BY pos) AS INTEGER) AS pos, label, value_text FROM paged WHERE kind < 7""")
def items_from_html(spark, sf):
    return page_source.item_rows(page_source.triage(views.price_pages(spark, sf), kind="price"))


@query("price_page_errors", PRICE_PAGES + """ SELECT DISTINCT entity, CASE kind WHEN 7 THEN 'unknown_entity'
    WHEN 8 THEN 'thin_data' ELSE 'layout_changed' END AS kind FROM paged WHERE kind >= 7""")
def price_page_errors(spark, sf):
    failed = page_source.error_records(page_source.triage(views.price_pages(spark, sf), kind="price"))
    return failed.select("entity", "kind")


@query("price_run_status", PRICE_PAGES + """ SELECT count(DISTINCT entity) AS pages,
    count(DISTINCT entity) FILTER (kind >= 7) AS failed, false AS run_failed FROM paged""")
def price_run_status(spark, sf):
    return page_source.run_failed(page_source.triage(views.price_pages(spark, sf), kind="price"))


@query("compare_from_html", PRICE_PAGES + """ SELECT b.entity, CASE WHEN kind < 7 THEN budget END AS budget,
    CASE kind WHEN 7 THEN 'unknown_entity' WHEN 8 THEN 'thin_data' WHEN 9 THEN 'layout_changed' END AS kind
    FROM budgets b JOIN (SELECT DISTINCT entity, kind FROM paged) USING (entity)""")
def compare_from_html(spark, sf):
    from panelspark.plans.compare import compare

    triaged = page_source.triage(views.price_pages(spark, sf), kind="price")
    records = compare(page_source.item_rows(triaged), errors=page_source.error_records(triaged))
    return records.select("entity", "budget", "kind")


@query("missing_with_errors", PRICE_PAGES + """, k AS (SELECT unnest(item_keys) AS key FROM labels)
    SELECT s.entity, CASE WHEN any_value(kind) >= 7 THEN 0 ELSE CAST(count(*) FILTER (f.key IS NULL) AS INTEGER) END AS n_unmatched,
    CASE WHEN any_value(kind) >= 7 THEN 0 ELSE CAST(count(*) FILTER (f.key IS NOT NULL AND f.value IS NULL) AS INTEGER) END AS n_blank
    FROM (SELECT DISTINCT entity, kind FROM paged) s CROSS JOIN k
    LEFT JOIN figures f ON f.entity = s.entity AND f.key = k.key GROUP BY s.entity""")
def missing_with_errors(spark, sf):
    triaged = page_source.triage(views.price_pages(spark, sf), kind="price")
    records = items.price_records(page_source.item_rows(triaged)).unionByName(
        page_source.error_records(triaged), allowMissingColumns=True
    )
    report = items.missing_report(records)
    return report.select("entity", F.size("unmatched").alias("n_unmatched"), F.size("blank").alias("n_blank"))


# ------------------------------------------------------------------- result sets

ANSWERS = "WITH " + ENTITIES + """, blocks AS (
    SELECT c_custkey // 50 AS block, count(*) AS n FROM entities GROUP BY 1),
    judged AS (SELECT block, n, CASE WHEN block % 7 = 6 THEN 'reported_error' WHEN block % 11 = 4 THEN 'no_content' END AS refused,
      block % 5 = 3 AS broken FROM blocks)"""


def _envelopes(spark, sf) -> DataFrame:
    return results.parse_envelopes(results.unwrap_answers(views.result_envelopes(spark, sf)))


@query("json_results", ANSWERS + """ SELECT j.block, CAST(n * 3 AS INTEGER) AS total_matching, CAST(n AS INTEGER) AS returned,
    slug, name, country, region, safety AS overall_score, cost_usd
    FROM judged j JOIN entities e ON e.c_custkey // 50 = j.block WHERE refused IS NULL AND NOT broken""")
def json_results(spark, sf):
    return results.city_rows(_envelopes(spark, sf).filter("refused IS NULL"), ["block"])


@query("json_refused", ANSWERS + """ SELECT block, refused, refused IS NULL AND broken AS kept_as_text
    FROM judged WHERE refused IS NOT NULL OR broken""")
def json_refused(spark, sf):
    parsed = _envelopes(spark, sf)
    plain = F.col("refused").isNull() & F.col("plain_text").isNotNull()
    return parsed.select("block", "refused", plain.alias("kept_as_text")).filter("refused IS NOT NULL OR kept_as_text")


# ------------------------------------------------------------------------ files


@query("csv_roundtrip", MOVERS + " SELECT " + ", ".join(diffing.CSV_COLUMNS) + " FROM rows_of")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    rows = _comparison(spark, sf, ranked=True).rows
    sinks.write_csv(rows, path, diffing.CSV_COLUMNS)
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in diffing.CSV_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


@query("json_roundtrip", MOVERS + " SELECT place, status, delta FROM rows_of")
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_json(_comparison(spark, sf).rows.select("place", "status", "delta"), path)
    return spark.read.schema("place string, status string, delta double").json(path)


@query("panel_store", "WITH " + PANEL + " SELECT snapshot, place, rank, revenue FROM panel WHERE snapshot IN ('1996', '1999')")
def panel_store(spark, sf):
    path = scratch_path(spark, "panel")
    panels.write_panel(views.customer_panel(spark, sf, (1996, 1998, 1999), ranked=True), path)
    stored = panels.read_panel(spark, path)
    both = panels.select_slice(stored, "cost-of-living", snapshot="1996").unionByName(
        panels.select_slice(stored, "cost-of-living", snapshot="1999")
    )
    return both.select("snapshot", "place", "rank", F.try_element_at("metrics", F.lit("Order Revenue")).alias("revenue"))


def _batch(spark, sf, years, path) -> None:
    """Page files for the stream: each block is its own family, so that no id repeats in a batch."""
    pages = views.ranking_pages(spark, sf, years).filter(F.col("block") % 7 != 5)
    vertical = F.concat(F.lit("block-"), F.col("block").cast("string"))
    item_no = F.col("block") * 10_000 + F.col("snapshot").cast("int")
    pages.select(vertical.alias("vertical"), F.lit("city").alias("view"), F.lit("").alias("region"), "snapshot", item_no.cast("bigint").alias("item_no"), "html").write.mode(
        "append"
    ).parquet(path)


STREAM = "WITH " + PANEL + f""", numbered AS (SELECT *, (rank - 1) // {PAGE_ROWS} AS block FROM panel)"""


@query("ingest_stream", STREAM + """ SELECT 'block-' || CAST(block AS VARCHAR) AS vertical, snapshot,
    CAST(count(*) FILTER (orders_n <> 5) AS INTEGER) AS n_rows, false AS moved, 'panel-2' AS schema_tag
    FROM numbered WHERE snapshot IN ('1996', '1997') AND block % 7 NOT IN (3, 5) GROUP BY 1, 2""")
def ingest_stream_query(spark, sf):
    root = scratch_path(spark, "stream")
    paths = {name: f"{root}/{name}" for name in ("pages", "panel", "corpus", "reports", "checkpoint")}
    for year in (1996, 1997):
        # Two runs over one checkpoint: the second only sees the new files.
        _batch(spark, sf, (year,), paths["pages"])
        ingest_stream(
            spark, paths["pages"], panel_path=paths["panel"], corpus_path=paths["corpus"],
            report_path=paths["reports"], checkpoint=paths["checkpoint"], schema_tag="panel-2", now=views.now(),
        )
    return scan_corpus(spark, paths["corpus"]).select("vertical", "snapshot", "n_rows", "moved", "schema_tag")


@query("ingest_report", STREAM + """, b AS (SELECT DISTINCT snapshot, block FROM numbered WHERE snapshot = '1996' AND block % 7 <> 5)
    SELECT count(*) AS planned, count(*) FILTER (block % 7 <> 3) AS ok, count(*) FILTER (block % 7 = 3) AS empty, 0::BIGINT AS failed,
      0::BIGINT AS unresolved, count(*) AS attempted, count(*) FILTER (block % 7 <> 3) AS stored, false AS aborted,
      0::BIGINT AS repeated_verticals, true AS complete, 0 AS exit FROM b""")
def ingest_report(spark, sf):
    from panelspark.streaming.ingest import PAGE_SCHEMA, ingest_batch

    root = scratch_path(spark, "batch")
    _batch(spark, sf, (1996,), f"{root}/pages")
    report = ingest_batch(
        spark.read.schema(PAGE_SCHEMA).parquet(f"{root}/pages"), panel_path=f"{root}/panel",
        corpus_path=f"{root}/corpus", schema_tag="panel-2", now=views.now(),
    )
    return report.select("planned", "ok", "empty", "failed", "unresolved", "attempted", "stored", "aborted",
                         "repeated_verticals", "complete", "exit")


@query("decoded_pages", "SELECT page_id, md5(html) AS digest FROM pages")
def decoded_pages(spark, sf):
    content = F.concat(F.to_binary(F.lit("EFBBBF"), F.lit("hex")), F.encode("html", "UTF-8"))
    raw = load(spark, sf, "pages").select("page_id", content.alias("content"))
    return page_source.decode_pages(raw).select("page_id", F.md5("html").alias("digest"))
