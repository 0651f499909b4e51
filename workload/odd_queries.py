"""Queries over what a panel rarely holds: unknown, zero and overflowing figures, requests that are refused, odd charsets."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from panelspark.functions.digests import schema_tag
from panelspark.operators import diffing, requests
from panelspark.operators.numbering import number_rows
from panelspark.operators.panels import as_panel, with_ranks
from panelspark.plans import movers as movers_plan
from panelspark.session import scratch_path
from panelspark.sources import pages as page_source
from panelspark.sources.corpus_store import alive, scan_corpus
from panelspark.vocab import IMPERIAL_TO_METRIC, ITEM_SPELLINGS

from . import stored_queries, views
from .registry import query
from .sql import ITEMS, PANEL
from .stored_queries import FAMILY, SLICED
from .views import load

# ------------------------------------------------------------------ odd figures

FIGURE, CONTROL = "Odd Figure", "Odd Control"
#: Per customer number: what each side shows.  A balance is negative for some customers, so bases are too.
FROM_SQL = """CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN -1e308 WHEN 3 THEN 1e-308 ELSE c_acctbal END"""
TO_SQL = """CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1e308 ELSE c_acctbal * 2 END"""
CONTROL_SQL = """CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 1e308 ELSE 1.0 END"""


def odd_sides(spark, sf):
    customers = load(spark, sf, "customer")
    panels = []
    for snapshot, text in (("2001", FROM_SQL), ("2002", TO_SQL)):
        panel = as_panel(
            customers, label=F.concat(F.col("c_name"), F.lit(", X")), snapshot=F.lit(snapshot),
            metrics={FIGURE: F.expr(text).cast("double"), CONTROL: F.expr(CONTROL_SQL).cast("double") * (1 if snapshot == "2001" else -1)})
        panels.append(with_ranks(panel, [F.col("place").asc()]))
    return panels


ODD = f"""WITH odd AS (
    SELECT c_name || ', X' AS place, CAST({FROM_SQL} AS DOUBLE) AS a, CAST({TO_SQL} AS DOUBLE) AS b FROM customer),
  changed AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'metric_absent_in_both' WHEN a IS NULL THEN 'metric_absent_in_from'
      WHEN b IS NULL THEN 'metric_absent_in_to' WHEN NOT isfinite(b - a) THEN 'not_finite' ELSE 'moved' END AS status,
    CASE WHEN isfinite(b - a) THEN b - a END AS delta,
    CASE WHEN a > 0 AND isfinite((b - a) / a * 100.0) THEN (b - a) / a * 100.0 END AS pct FROM odd)"""


@query("movers_odd_figures", ODD + """ SELECT place, status, CASE WHEN status = 'moved' AND pct IS NULL
    THEN CASE WHEN a <= 0 THEN 'base_not_positive' ELSE 'not_finite' END END AS reason,
    a AS value_from, b AS value_to, delta, pct FROM changed""")
def movers_odd_figures(spark, sf):
    rows = diffing.diff_rows(diffing.sides(*odd_sides(spark, sf)), FIGURE)
    return rows.select("place", "status", "reason", "value_from", "value_to", "delta", "pct")


ODD_STATUSES = ", ".join(f"('{s}')" for s in diffing.STATUSES)


@query("movers_odd_counts", ODD + f""" SELECT s.status, count(changed.status) AS n FROM (VALUES {ODD_STATUSES}) s(status)
    LEFT JOIN changed ON changed.status = s.status GROUP BY s.status""")
def movers_odd_counts(spark, sf):
    return movers_plan.diff(diffing.sides(*odd_sides(spark, sf)), [FIGURE, CONTROL], [FIGURE, CONTROL], FIGURE).counts()


@query("control_answers", """WITH c AS (SELECT c_custkey % 3 AS kind FROM customer)
    SELECT 'moved' AS asked, bool_or(kind = 2) AS control_moved FROM c
    UNION ALL SELECT 'not_finite', CASE WHEN bool_or(kind = 1) THEN NULL END FROM c
    UNION ALL SELECT 'unchanged', NOT bool_or(kind = 2) FROM c WHERE kind = 2 UNION ALL SELECT 'absent', NULL""")
def control_answers(spark, sf):
    """Whether another column moved: yes, no, and unknown for two reasons."""
    before, after = odd_sides(spark, sf)
    number = F.regexp_extract("place", "#([0-9]+)", 1).cast("bigint") % 3
    out = None
    for asked, kind, same in (("moved", None, False), ("not_finite", 1, False), ("unchanged", 2, True), ("absent", 0, False)):
        sides = [side if kind is None else side.filter(number == kind) for side in (before, before if same else after)]
        row = movers_plan.diff(diffing.sides(*sides), [FIGURE, CONTROL], [FIGURE, CONTROL], FIGURE).summary.select(
            F.lit(asked).alias("asked"), "control_moved")
        out = row if out is None else out.unionByName(row)
    return out


# --------------------------------------------------------------- refused requests

REQUESTS_SQL = """
request AS (
  SELECT CAST(n_nationkey AS BIGINT) AS request_no, CASE WHEN n_nationkey = 24 THEN 'weather' WHEN n_nationkey = 23 THEN 'crime'
      ELSE 'cost-of-living' END AS vertical,
    CASE WHEN n_nationkey % 3 = 2 THEN 'country' ELSE 'city' END AS "view", '' AS region,
    CASE WHEN n_nationkey % 11 = 0 THEN ' ' WHEN n_nationkey % 11 = 1 THEN '1987' WHEN n_nationkey % 4 = 0 THEN ' 1995 '
      ELSE CAST(1995 + n_nationkey % 4 AS VARCHAR) END AS frm,
    CASE WHEN n_nationkey % 11 = 3 THEN NULL WHEN n_nationkey % 5 = 0 THEN '1996' ELSE '2000' END AS tos,
    CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 6 = 1 THEN ' order   REVENUE ' WHEN n_nationkey % 6 = 2 THEN 'order'
      WHEN n_nationkey % 6 = 3 THEN 'max' WHEN n_nationkey % 6 = 4 THEN 'weather' ELSE 'Max Order' END AS "column"
  FROM nation)"""


def request_rows(spark, sf):
    number = F.col("n_nationkey")
    pick = lambda *cases: F.expr("CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in cases[:-1]) + f" ELSE {cases[-1]} END")
    return load(spark, sf, "nation").select(
        number.cast("bigint").alias("request_no"),
        pick(("n_nationkey = 24", "'weather'"), ("n_nationkey = 23", "'crime'"), "'cost-of-living'").alias("vertical"),
        pick(("n_nationkey % 3 = 2", "'country'"), "'city'").alias("view"), F.lit("").alias("region"),
        pick(("n_nationkey % 11 = 0", "' '"), ("n_nationkey % 11 = 1", "'1987'"), ("n_nationkey % 4 = 0", "' 1995 '"),
             "cast(1995 + n_nationkey % 4 AS string)").alias("frm"),
        pick(("n_nationkey % 11 = 3", "NULL"), ("n_nationkey % 5 = 0", "'1996'"), "'2000'").alias("tos"),
        pick(("n_nationkey % 6 = 0", "NULL"), ("n_nationkey % 6 = 1", "' order   REVENUE '"), ("n_nationkey % 6 = 2", "'order'"),
             ("n_nationkey % 6 = 3", "'max'"), ("n_nationkey % 6 = 4", "'weather'"), "'Max Order'").alias("column"))


@query("requests_judged", SLICED + "," + REQUESTS_SQL + """,
  cleaned AS (SELECT request_no, vertical, "view", region, coalesce(trim(frm), '') AS frm,
      coalesce(trim(tos), 'current') AS tos, trim(regexp_replace(lower(coalesce("column", '')), '\\s+', ' ', 'g')) AS wanted FROM request),
  known AS (SELECT r.*, r.vertical IN ('cost-of-living', 'quality-of-life', 'crime', 'health-care', 'pollution', 'traffic', 'property') AS family,
      (SELECT count(*) FROM heads h WHERE r.vertical = 'cost-of-living' AND h."view" = r."view" AND h.region = r.region) AS n_published,
      (SELECT any_value(columns) FROM heads h WHERE r.vertical = 'cost-of-living' AND h."view" = r."view" AND h.region = r.region
         AND h.snapshot = r.frm) AS old,
      (SELECT any_value(columns) FROM heads h WHERE r.vertical = 'cost-of-living' AND h."view" = r."view" AND h.region = r.region
         AND h.snapshot = r.tos) AS new FROM cleaned r),
  answered AS (SELECT *, list_filter(new, lambda c: list_contains(old, c)) AS shared,
      CASE WHEN len(list_filter(old, lambda c: lower(c) = wanted)) > 0 THEN list_filter(old, lambda c: lower(c) = wanted)
        ELSE list_filter(old, lambda c: contains(lower(c), wanted)) END AS olds,
      CASE WHEN len(list_filter(new, lambda c: lower(c) = wanted)) > 0 THEN list_filter(new, lambda c: lower(c) = wanted)
        ELSE list_filter(new, lambda c: contains(lower(c), wanted)) END AS news FROM known),
  judged AS (SELECT *, CASE WHEN NOT family THEN 'unknown_vertical' WHEN frm = '' THEN 'no_base' WHEN n_published = 0 THEN 'no_snapshots'
      WHEN (old IS NULL AND frm <> 'current') OR (new IS NULL AND tos <> 'current') THEN 'unknown_snapshot'
      WHEN frm = tos THEN 'same_slice' WHEN wanted = '' THEN CASE WHEN coalesce(len(shared), 0) = 0 THEN 'no_shared_column' END
      WHEN len(olds) = 1 AND olds = news THEN NULL WHEN greatest(coalesce(len(olds), 0), coalesce(len(news), 0)) > 1 THEN 'ambiguous_column'
      WHEN coalesce(len(olds), 0) = 0 AND coalesce(len(news), 0) = 0 THEN 'unknown_column'
      WHEN coalesce(len(news), 0) = 0 THEN 'column_only_in_from' WHEN coalesce(len(olds), 0) = 0 THEN 'column_only_in_to'
      ELSE 'different_columns' END AS reason FROM answered)
  SELECT request_no, reason, CASE WHEN reason IS NULL THEN CASE WHEN wanted = '' THEN shared[1] ELSE olds[1] END END AS resolved FROM judged""")
def requests_judged(spark, sf):
    store = stored_queries.stored(spark, sf)
    entries = alive(scan_corpus(spark, store.corpus_path))
    return requests.judged(request_rows(spark, sf), entries).select("request_no", "reason", "resolved")


# ------------------------------------------------------------------------ files

LATIN = r"^[\x00-\x7f\xa1-\xa3\xa5\xa7\xa9-\xb3\xb5-\xb7\xb9-\xbb\xbf-\xff]*$"
LATIN_SQL = r"^[\x00-\x7f\x{a1}-\x{a3}\x{a5}\x{a7}\x{a9}-\x{b3}\x{b5}-\x{b7}\x{b9}-\x{bb}\x{bf}-\x{ff}]*$"


def written_by_tasks(spark, rows, root) -> bool:
    """Writes ``charset=.../page_id=...`` of ``rows`` (page_id, charset, value), if ``root`` is a folder that tasks can open.

    Spark's writer needs a folder a page in all stores and, in a folder, two processes a file to set its rights.  Rows of
    one page are lines of one file, as its writer has them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getScheme() != "file":
        return False
    store.mkdirs(path)
    folder, at_once = path.toUri().getPath(), page_source.PAGES_AT_ONCE

    def write(batches):
        out = last = hidden = None

        def placed():
            if out is not None:
                out.close()
                os.replace(hidden, f"{folder}/charset={last[0]}/page_id={last[1]}")

        parts = (batch.slice(first, at_once) for batch in batches for first in range(0, batch.num_rows, at_once))
        for row in (row for part in parts for row in part.to_pylist()):
            if (row["charset"], row["page_id"]) != last:
                placed()
                last = row["charset"], row["page_id"]
                os.makedirs(f"{folder}/charset={last[0]}", exist_ok=True)
                # Another attempt at the same task writes the same; each puts its whole file in place.
                hidden = f"{folder}/charset={last[0]}/.{last[1]}-{uuid.uuid4().hex}"
                out = open(hidden, "wb")
            out.write((row["value"] or b"") + b"\n")
        placed()
        yield from ()

    rows.sortWithinPartitions("charset", "page_id").mapInArrow(write, "page_id long").write.format("noop").mode("overwrite").save()
    return True


@query("charset_pages", rf"""SELECT page_id, md5(html || CASE WHEN page_id % 4 IN (1, 2) AND regexp_matches(html, '{LATIN_SQL}') THEN '€'
    WHEN page_id % 4 = 3 THEN chr(65533) ELSE '' END || chr(10)) AS digest FROM pages""")
def charset_pages(spark, sf):
    """Every page as a file of its own, in three charsets and with broken bytes, read back as bytes."""
    root = scratch_path(spark, "files")
    pages = load(spark, sf, "pages").select("page_id", "html")
    kind, latin = F.col("page_id") % 4, F.col("html").rlike(LATIN)
    utf8, narrow = F.encode("html", "UTF-8"), F.encode(F.when(latin, F.col("html")), "ISO-8859-1")
    byte = lambda text: F.to_binary(F.lit(text), F.lit("hex"))
    kinds = {
        "windows-1252": (kind == 1) & latin, "iso-8859-15": (kind == 2) & latin, "broken": kind == 3,
        "utf-8": (kind == 0) | ((kind != 3) & ~latin),
    }
    content = {"windows-1252": F.concat(narrow, byte("80")), "iso-8859-15": F.concat(narrow, byte("A4")),
               "broken": F.concat(utf8, byte("FF")), "utf-8": F.concat(byte("EFBBBF"), utf8)}
    chosen, value = F.lit(None).cast("string"), F.lit(None).cast("binary")
    for charset, rows in kinds.items():
        chosen = F.when(rows, F.lit(charset)).otherwise(chosen)
        value = F.when(rows, content[charset]).otherwise(value)
    rows = pages.select("page_id", chosen.alias("charset"), value.alias("value")).filter("charset IS NOT NULL").repartition("page_id")
    if not written_by_tasks(spark, rows, root):
        # A text file holds the bytes of its strings as they are.  Each task puts its own files in place: moving them
        # one by one at the end of the job would take the driver longer.
        rows.withColumn("value", F.col("value").cast("string")).write.partitionBy("charset", "page_id").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").text(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{page_id=*,part-*}").load(root)
    charset = F.regexp_extract("path", r"/charset=([^/]+)/page_id=", 1)
    declared = F.when(charset.isin("windows-1252", "iso-8859-15"), F.concat(F.lit("text/html; charset="), charset))
    decoded = page_source.decode_pages(files.select("path", "content"), declared)
    return decoded.select(F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"), F.md5("html").alias("digest"))


# ------------------------------------------------------------------- pages, tags

PAGE_SQL = "WITH " + ITEMS + """, paged AS (SELECT *, CAST(right(entity, 3) AS INTEGER) % 10 AS kind FROM items)"""


@query("units_from_html", PAGE_SQL + """ SELECT entity, CASE WHEN any_value(country) LIKE '%\\_0%' ESCAPE '\\' THEN 'NATION ' ELSE 'NATION' END AS country,
    CASE WHEN any_value(kind) = 5 OR (any_value(kind) <> 6 AND bool_or(label LIKE '%Square Feet%' OR label LIKE '%1 mile%'))
      THEN 'imperial' ELSE 'metric' END AS measurement_system,
    CASE WHEN any_value(kind) = 6 THEN 0 ELSE CAST(count(DISTINCT key) AS INTEGER) END AS n_seen, any_value(kind) = 6 AS no_prices
    FROM paged WHERE kind < 7 GROUP BY entity""")
def units_from_html(spark, sf):
    """Pages whose only marker stands in a row without a price, and good pages without any price."""
    number = F.right("entity", F.lit(3)).cast("int") % 10
    marked = views.price_pages(spark, sf).withColumn("html", F.when(number == 5, F.replace(
        "html", F.lit("<tr><td>only one cell</td></tr>"), F.lit("<tr><td>Prices for 1 lb</td></tr>"))).when(
        number == 6, F.regexp_replace("html", "(?s)<tr><td>only one cell</td></tr>.*</table>", "<tr><td>nothing yet</td></tr></table>")
    ).otherwise(F.col("html")))
    triaged = page_source.triage(marked, kind="price")
    from panelspark.operators.items import price_records

    records = price_records(page_source.item_rows(triaged), pages=page_source.price_page_facts(triaged))
    return records.select("entity", "country", "measurement_system", F.size("seen").alias("n_seen"),
                          (F.size("values") == 0).alias("no_prices"))


def _tag_sql(factors) -> str:
    parts = sorted(f"{label}->{key}" for label, key in ITEM_SPELLINGS) + sorted(f"{key}*{f!r}" for key, f in factors.items())
    return "substr(sha256('" + "|".join(parts).replace("'", "''") + "'), 1, 12)"


OTHER_FACTORS = {**IMPERIAL_TO_METRIC, "taxi_km": 1.0}


@query("schema_tags", "WITH " + ITEMS + f""", tagged AS (SELECT DISTINCT entity,
      CASE WHEN CAST(right(entity, 3) AS INTEGER) % 2 = 0 THEN {_tag_sql(IMPERIAL_TO_METRIC)} ELSE {_tag_sql(OTHER_FACTORS)} END AS tag FROM items)
    SELECT entity, tag, tag = {_tag_sql(IMPERIAL_TO_METRIC)} AS is_current FROM tagged""")
def schema_tags(spark, sf):
    """Entries parsed under two sets of factors: the tag tells them apart."""
    even = F.right("entity", F.lit(3)).cast("int") % 2 == 0
    tag = F.when(even, schema_tag()).otherwise(schema_tag(factors=OTHER_FACTORS))
    entities = views.price_items(spark, sf).select("entity").distinct()
    return entities.select("entity", tag.alias("tag"), (tag == schema_tag()).alias("is_current"))


# ------------------------------------------------------------------------ order

@query("rank_sorted_positions", "WITH " + PANEL + """ SELECT place, CAST(row_number() OVER (ORDER BY orders_n, rank) AS INTEGER) AS position
    FROM panel WHERE snapshot = '1998'""")
def rank_sorted_positions(spark, sf):
    from panelspark.plans.rank import rank_order

    table = views.customer_panel(spark, sf, (1998,), ranked=True)
    return number_rows(table, [], rank_order("Order Count"), "position").select("place", "position")


@query("budget_positions", "WITH " + ITEMS + """ SELECT entity, budget,
    CAST(row_number() OVER (ORDER BY budget NULLS LAST, entity) AS INTEGER) AS position FROM budgets""")
def budget_positions(spark, sf):
    from panelspark.operators.budgets import budget_order
    from panelspark.plans.compare import compare

    records = compare(views.price_items(spark, sf)).select("entity", "budget")
    return number_rows(records, [], budget_order(), "position")


__all__ = ["FAMILY"]
