"""Queries over panels: rank, trend, movers, fingerprints, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions import snapshots as snap
from panelspark.functions.numbers import is_better
from panelspark.operators import diffing, fingerprints, headers, panels, places
from panelspark.plans import movers as movers_plan
from panelspark.plans.rank import rank
from panelspark.plans.trend import trend
from panelspark.session import one_row, scratch_path

from . import views
from .registry import query
from .sql import COPIED, PANEL, PARTS, diff_ctes
from .views import METRICS, customer_panel, load, part_panels, slice_of

YEARS = (1996, 2000)
PUBLISHED = ["1995", "1996", "1997", "1998", "1999", "2000", "2001"]
ROWS = ", ".join(diffing.ROW_COLUMNS)


def _comparison(spark, sf, ranked=False, column="Order Revenue") -> movers_plan.Comparison:
    return movers_plan.diff(diffing.sides_of(customer_panel(spark, sf, YEARS, ranked=ranked), "1996", "2000"), METRICS, METRICS, column)


MOVERS = "WITH " + PANEL + diff_ctes("1996", "2000")


@query("movers_rows", MOVERS + f" SELECT {ROWS} FROM rows_of")
def movers_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _comparison(spark, sf, ranked=True).rows


@query("movers_top_abs", MOVERS + f""" SELECT {ROWS} FROM rows_of WHERE status = 'moved'
    ORDER BY abs(delta) DESC, place LIMIT 20""")
def movers_top_abs(spark, sf):
    return _comparison(spark, sf, ranked=True).movers(top=20)


@query("movers_rising", MOVERS + """ SELECT place, value_from, value_to, delta, pct FROM rows_of
    WHERE status = 'moved' AND delta > 0 ORDER BY delta DESC, place LIMIT 20""")
def movers_rising(spark, sf):
    found = _comparison(spark, sf).movers(direction="rising", top=20)
    return found.select("place", "value_from", "value_to", "delta", "pct")


@query("movers_falling", MOVERS + """ SELECT place, value_from, value_to, delta, pct FROM rows_of
    WHERE status = 'moved' AND delta < 0 ORDER BY abs(delta) DESC, place""")
def movers_falling(spark, sf):
    found = _comparison(spark, sf).movers(direction="falling")
    return found.select("place", "value_from", "value_to", "delta", "pct")


@query("movers_pct", MOVERS + """ SELECT place, value_from, value_to, delta, pct FROM rows_of
    WHERE status = 'moved' ORDER BY abs(pct) DESC NULLS LAST, place LIMIT 20""")
def movers_pct(spark, sf):
    found = _comparison(spark, sf).movers(order="pct", top=20)
    return found.select("place", "value_from", "value_to", "delta", "pct")


@query("movers_samples", MOVERS + """
    (SELECT place, status, rank_from, rank_to FROM rows_of WHERE status = 'new' ORDER BY rank_to LIMIT 5)
    UNION ALL (SELECT place, status, rank_from, rank_to FROM rows_of WHERE status = 'delisted' ORDER BY rank_from LIMIT 5)""")
def movers_samples(spark, sf):
    rows = _comparison(spark, sf, ranked=True).rows
    return diffing.one_sided_samples(rows).select("place", "status", "rank_from", "rank_to")


STATUS_VALUES = ", ".join(f"('{s}')" for s in diffing.STATUSES)
COUNTS = f""" SELECT s.status, count(r.status) AS n FROM (VALUES {STATUS_VALUES}) s(status)
    LEFT JOIN rows_of r ON r.status = s.status GROUP BY s.status"""


@query("movers_status_counts", MOVERS + COUNTS)
def movers_status_counts(spark, sf):
    return _comparison(spark, sf).counts()


STATS = """ SELECT count(*) AS with_metric_in_both, count(DISTINCT round(delta, 6)) AS distinct_delta_values,
    count(*) FILTER (delta = 0) / nullif(count(*), 0)::DOUBLE AS zero_delta_share,
    greatest(count(*) FILTER (delta > 0), count(*) FILTER (delta < 0))
      / nullif(count(*) FILTER (delta <> 0), 0)::DOUBLE AS same_direction_share,
    median(delta) AS median_delta, median(pct) AS median_pct, count(*) FILTER (delta > 0) AS rising,
    count(*) FILTER (delta < 0) AS falling, count(*) FILTER (delta = 0) AS unchanged
    FROM rows_of WHERE status = 'moved'"""


@query("movers_stats", MOVERS + STATS)
def movers_stats(spark, sf):
    return _comparison(spark, sf).summary.select(
        "with_metric_in_both", "distinct_delta_values", "zero_delta_share", "same_direction_share",
        "median_delta", "median_pct", "rising", "falling", "unchanged",
    )


@query("movers_overlap", MOVERS + """ SELECT count(*) FILTER (a.key IS NOT NULL AND b.key IS NOT NULL) AS joined,
    100.0 * (count(*) FILTER (a.key IS NOT NULL AND b.key IS NOT NULL)
      / least(any_value(of_from), any_value(of_to))::DOUBLE) AS overlap_pct_of_smaller,
    count(*) FILTER (a.key IS NOT NULL AND b.key IS NOT NULL)
      < 0.5 * least(any_value(of_from), any_value(of_to)) AS below_floor
    FROM a FULL JOIN b ON a.key = b.key, sizes""")
def movers_overlap(spark, sf):
    return _comparison(spark, sf).summary.select("joined", "overlap_pct_of_smaller", "below_floor")


@query("movers_truncation", MOVERS + """ SELECT (SELECT count(*) FROM a JOIN b USING (key)) AS joined,
    count(*) AS matched_direction, least(count(*), 20) AS shown, count(*) > 20 AS truncated
    FROM rows_of WHERE status = 'moved' AND delta > 0""")
def movers_truncation(spark, sf):
    return diffing.truncation_counts(_comparison(spark, sf).summary, "rising", 20)


DUPLICATES = "WITH " + PARTS + diff_ctes("2001", "2002")


@query("movers_dup_keys", DUPLICATES + f" SELECT {ROWS} FROM rows_of")
def movers_dup_keys(spark, sf):
    return diffing.diff_rows(diffing.sides(*part_panels(spark, sf)), "Retail Price")


@query("movers_dup_counts", DUPLICATES + COUNTS)
def movers_dup_counts(spark, sf):
    pairs = diffing.pair_by_key(diffing.sides(*part_panels(spark, sf)), "Retail Price")
    return diffing.status_counts(diffing.summary(pairs))


@query("movers_excluded_keys", DUPLICATES + """
    SELECT 'from' AS side, key, CASE WHEN key = '' THEN 'unkeyable_label' ELSE 'duplicate_key' END AS reason,
           count(*) AS n FROM a_all WHERE key = '' OR n > 1 GROUP BY key
    UNION ALL SELECT 'to', key, CASE WHEN key = '' THEN 'unkeyable_label' ELSE 'duplicate_key' END, count(*)
    FROM b_all WHERE key = '' OR n > 1 GROUP BY key""")
def movers_excluded_keys(spark, sf):
    return diffing.excluded_keys(diffing.pair_by_key(diffing.sides(*part_panels(spark, sf)), "Retail Price"))


# A second table in which one column stood still while another moved.
FROZEN = "WITH " + PANEL + """, frozen AS (
  SELECT * FROM panel WHERE snapshot = '1996'
  UNION ALL SELECT * REPLACE ('1996-mid' AS snapshot, revenue * 1.5 AS revenue, orders_n AS orders_n)
  FROM panel WHERE snapshot = '1996')""" + diff_ctes("1996", "1996-mid", "orders_n", "frozen")


def _frozen(spark, sf, column) -> movers_plan.Comparison:
    before = customer_panel(spark, sf, (1996,))
    changed = F.transform_values(
        "metrics", lambda k, v: F.when(k == "Order Revenue", v * 1.5).otherwise(v)
    )
    after = before.withColumn("metrics", changed).withColumn("snapshot", F.lit("1996-mid"))
    return movers_plan.diff(diffing.sides(before, after), METRICS, METRICS, column)


@query("drift_flags", FROZEN + """ SELECT count(*) AS with_metric_in_both,
    CASE WHEN count(*) >= 10 AND bool_and(delta = 0) THEN 'diffed_column_did_not_move_while_another_did' ELSE '' END
    || CASE WHEN count(*) >= 50 AND count(DISTINCT round(delta, 6)) <= 3 THEN ';too_few_distinct_deltas' ELSE '' END AS flags
    FROM rows_of WHERE status = 'moved'""")
def drift_flags(spark, sf):
    row = _frozen(spark, sf, "Order Count").summary
    return row.select("with_metric_in_both", F.array_join("partial_drift", ";").alias("flags"))


@query("control_moves", FROZEN + """ SELECT
    (SELECT bool_or(b.revenue <> a.revenue OR b.top_order <> a.top_order) FROM a JOIN b USING (key)) AS frozen_count,
    (SELECT bool_or(b.orders_n <> a.orders_n OR b.top_order <> a.top_order) FROM a JOIN b USING (key)) AS moved_revenue""")
def control_moves(spark, sf):
    frozen = _frozen(spark, sf, "Order Count").summary.select(F.col("control_moved").alias("frozen_count"))
    moved = _frozen(spark, sf, "Order Revenue").summary.select(F.col("control_moved").alias("moved_revenue"))
    return frozen.crossJoin(F.broadcast(moved))


@query("rebase", "WITH " + PANEL + """, shifted AS (
    SELECT * FROM panel WHERE snapshot = '1996'
    UNION ALL SELECT * REPLACE ('1996-mid' AS snapshot, revenue * 1.5 AS revenue) FROM panel WHERE snapshot = '1996')"""
    + diff_ctes("1996", "1996-mid", "revenue", "shifted") + """
    SELECT count(*) FILTER (delta > 0) AS rising, count(*) FILTER (delta <> 0) >= 10
      AND greatest(count(*) FILTER (delta > 0), count(*) FILTER (delta < 0)) >= 0.9 * count(*) FILTER (delta <> 0)
      AS rebase_suspected FROM rows_of WHERE status = 'moved'""")
def rebase(spark, sf):
    return _frozen(spark, sf, "Order Revenue").summary.select("rising", "rebase_suspected")


VERDICT = COPIED + diff_ctes("1997", "2003", "revenue", "copied") + """
    SELECT x.fp = y.fp AS identical_tables,
           CASE WHEN x.fp <> y.fp THEN NULL WHEN p.fp = y.fp THEN 'snapshot_parameter_ignored'
                ELSE 'same_published_table' END AS drift,
           p.snapshot AS probe_snapshot, p.n_rows AS probe_rows"""
DRIFT_FROM = """ FROM prints x, prints y, prints p
    WHERE x.snapshot = '1997' AND y.snapshot = '2003' AND p.snapshot = '1995'"""


def _copied_comparison(spark, sf) -> movers_plan.Comparison:
    panel = views.copied_panel(spark, sf)
    published = [*PUBLISHED, "2003", "2004-mid"]
    return movers_plan.compare_snapshots(
        panel, published, dict.fromkeys(published, METRICS), frm="1997", to="2003", column="order revenue"
    )


@query("movers_verdict", "WITH " + VERDICT + """, 'same_published_table;too_few_distinct_deltas' AS reasons,
    '' AS warnings, 2 AS exit""" + DRIFT_FROM)
def movers_verdict(spark, sf):
    return _copied_comparison(spark, sf).verdict().select(
        "identical_tables", "drift", "probe_snapshot", "probe_rows",
        F.array_join("reasons", ";").alias("reasons"), F.array_join("warnings", ";").alias("warnings"), "exit",
    )


@query("drift_cause", "WITH " + VERDICT + DRIFT_FROM)
def drift_cause(spark, sf):
    prints = fingerprints.panel_fingerprints(views.copied_panel(spark, sf))
    return fingerprints.drift_cause(prints, "1997", "2003")


@query("panel_same", "WITH " + COPIED + """ SELECT a.snapshot AS snapshot, a.fp = b.fp AS same_as_1997
    FROM prints a, prints b WHERE b.snapshot = '1997'""")
def panel_same(spark, sf):
    prints = fingerprints.panel_fingerprints(views.copied_panel(spark, sf))
    base = one_row(prints.agg(F.max(F.when(F.col("snapshot") == "1997", F.col("fingerprint"))).alias("base")))
    same = fingerprints.same_print(F.col("fingerprint"), F.col("base"))
    return prints.crossJoin(base).select("snapshot", same.alias("same_as_1997"))


@query("repeated_tables", "WITH " + COPIED + """, c AS (SELECT fp, count(*) AS n FROM prints GROUP BY fp)
    SELECT 'cost-of-living' AS vertical, CAST(sum(n) AS BIGINT) AS "of", count(*) AS distinct_tables,
           max(n) AS max_repeat, 0::BIGINT AS unfingerprintable, max(n) >= 3 AS repeated FROM c""")
def repeated_tables(spark, sf):
    prints = fingerprints.panel_fingerprints(views.copied_panel(spark, sf), ["vertical", "snapshot"])
    return fingerprints.distinct_tables(prints, ["vertical"])


@query("mutated_snapshots", """WITH seen AS (
    SELECT 1 AS reading, o_custkey, year(o_orderdate) AS y, o_totalprice FROM orders
    UNION ALL SELECT 2, o_custkey, year(o_orderdate), o_totalprice FROM orders
    WHERE NOT (year(o_orderdate) = 1998 AND o_orderstatus = 'P')),
    f AS (SELECT reading, o_custkey, y, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, count(*) AS n,
                 max(o_totalprice) AS top FROM seen GROUP BY ALL),
    prints AS (SELECT reading, y, md5(string_agg(o_custkey || '|' || revenue || '|' || n || '|' || top, ';' ORDER BY o_custkey)) AS fp
               FROM f GROUP BY reading, y)
    SELECT CAST(y AS VARCHAR) AS snapshot, count(*) AS observations, count(DISTINCT fp) AS distinct_tables,
           count(DISTINCT fp) > 1 AS moved FROM prints GROUP BY y""")
def mutated_snapshots(spark, sf):
    late = ~((F.year("o_orderdate") == 1998) & (F.col("o_orderstatus") == "P"))
    first = fingerprints.panel_fingerprints(customer_panel(spark, sf, ranked=True))
    second = fingerprints.panel_fingerprints(customer_panel(spark, sf, ranked=True, keep=late))
    return fingerprints.moved_snapshots(first.unionByName(second), ["snapshot"])


# ------------------------------------------------------------------------- rank

RANKED_SQL = "WITH " + PANEL


def _rank(spark, sf, **options):
    return rank(customer_panel(spark, sf, (1998,), ranked=True), METRICS, **options)


@query("rank_sorted", RANKED_SQL + """ SELECT rank, place, city, country, revenue AS "Order Revenue",
    orders_n AS "Order Count", top_order AS "Max Order" FROM panel WHERE snapshot = '1998'
    """)
def rank_sorted(spark, sf):
    return _rank(spark, sf, sort="count", top=None).flat()


@query("rank_match", RANKED_SQL + """ SELECT rank, place, city, country, revenue AS "Order Revenue",
    orders_n AS "Order Count", top_order AS "Max Order" FROM panel
    WHERE snapshot = '1998' AND contains(key, 'nation3europe')""")
def rank_match(spark, sf):
    return _rank(spark, sf, match="Nation 3, Europe").flat()


@query("rank_match_raw", RANKED_SQL + """ SELECT rank, place FROM panel
    WHERE snapshot = '1998' AND contains(lower(place), 'n_7, asi')""")
def rank_match_raw(spark, sf):
    return _rank(spark, sf, match="N_7, ASI").rows.select("rank", "place")


@query("rank_top", RANKED_SQL + """ SELECT rank, place, revenue AS "Order Revenue", orders_n AS "Order Count",
    top_order AS "Max Order" FROM panel WHERE snapshot = '1998' AND rank <= 25""")
def rank_top(spark, sf):
    return _rank(spark, sf, top=25).display()


@query("rank_positions", RANKED_SQL + """ SELECT snapshot, place, rank,
    CAST(count(*) OVER (PARTITION BY snapshot) AS INTEGER) AS "of" FROM panel""")
def rank_positions(spark, sf):
    panel = customer_panel(spark, sf, ranked=True)
    sized = panels.with_table_size(panel, panels.table_sizes(panel))
    return sized.select("snapshot", "place", "rank", "of")


@query("slice", RANKED_SQL + " SELECT place, country, revenue FROM panel WHERE snapshot = '1999'")
def slice_query(spark, sf):
    panel = customer_panel(spark, sf)
    chosen = panels.select_slice(panel, "cost-of-living", snapshot="1999")
    return chosen.select("place", "country", F.try_element_at("metrics", F.lit("Order Revenue")).alias("revenue"))


@query("place_tiers", RANKED_SQL + """, hits AS (
    SELECT *, CASE WHEN key = 'nation12' THEN 1
      WHEN regexp_replace(lower(city), '[^a-z0-9]', '', 'g') = 'nation12' THEN 2
      WHEN contains(key, 'nation12') THEN 3 END AS tier FROM panel)
    SELECT snapshot, place, CAST(tier AS INTEGER) AS tier FROM hits
    QUALIFY tier = min(tier) OVER (PARTITION BY snapshot)""")
def place_tiers(spark, sf):
    return places.find_place(customer_panel(spark, sf), "Nation 12", slices=["snapshot"]).select(
        "snapshot", "place", "tier"
    )


@query("place_resolved", RANKED_SQL + """, hits AS (
    SELECT *, CASE WHEN regexp_replace(lower(city), '[^a-z0-9]', '', 'g') = 'customer000000012' THEN 2
      WHEN contains(key, 'customer000000012') THEN 3 END AS tier FROM panel)
    SELECT snapshot, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(place) END AS place
    FROM (SELECT * FROM hits WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY snapshot))
    GROUP BY snapshot""")
def place_resolved(spark, sf):
    return places.resolve_place(customer_panel(spark, sf), "Customer#000000012", slices=["snapshot"])


@query("place_ambiguous", RANKED_SQL + """ SELECT count(*) AS candidates,
    CASE WHEN count(*) = 1 THEN min(place) END AS place FROM panel WHERE snapshot = '1998' AND contains(key, 'nation7asia')""")
def place_ambiguous(spark, sf):
    return places.resolve_place(customer_panel(spark, sf, (1998,)), "nation_7, asia")


# ------------------------------------------------------------------------ trend

ANCHOR = "Customer#000000007"
TREND = RANKED_SQL + """, asked AS (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS pos, s AS snapshot FROM (
      SELECT unnest(['2001','2000','1999','1998','1997','1996','1995']) AS s)),
    sizes AS (SELECT snapshot, CAST(count(*) AS INTEGER) AS "of" FROM panel GROUP BY 1),
    hits AS (SELECT * FROM panel WHERE city = 'Customer#000000007'),
    first AS (SELECT min(pos) AS anchor_pos FROM asked JOIN hits USING (snapshot)),
    series AS (SELECT pos, a.snapshot, h.place IS NOT NULL AS found, h.place, h.rank,
      CASE WHEN h.place IS NOT NULL THEN s."of" END AS "of", h.revenue,
      CASE WHEN h.place IS NULL THEN 'not ranked in this snapshot' END AS note
      FROM asked a LEFT JOIN hits h USING (snapshot) LEFT JOIN sizes s USING (snapshot))"""


def _trend(spark, sf, place=ANCHOR, **options):
    panel = customer_panel(spark, sf, ranked=True)
    return trend(panel, place, list(reversed(PUBLISHED)), **options)


@query("trend_series", TREND + ' SELECT pos, snapshot, found, place, rank, "of", revenue, note FROM series')
def trend_series(spark, sf):
    value = F.try_element_at("metrics", F.lit("Order Revenue")).alias("revenue")
    return _trend(spark, sf).series.select("pos", "snapshot", "found", "place", "rank", "of", value, "note")


@query("trend_summary", TREND + """ SELECT count(*) FILTER (found) AS found_in, count(*) AS requested,
    CAST(count(*) AS INTEGER) AS published, false AS identical_across_snapshots, max(place) AS anchor, 'Order Count' AS "column" FROM series""")
def trend_summary(spark, sf):
    return _trend(spark, sf, column="Order Count").summary


@query("trend_ambiguous", RANKED_SQL + """ SELECT snapshot, place, rank FROM panel
    WHERE snapshot = '1995' AND contains(key, 'nation7asia')""")
def trend_ambiguous(spark, sf):
    return _trend(spark, sf, "Nation_7, Asia").ambiguous


@query("trend_repeated", "WITH " + COPIED + """ SELECT count(*) AS found_in, 3::BIGINT AS requested,
    count(*) >= 3 AS identical_across_snapshots FROM copied
    WHERE city = 'Customer#000000007' AND snapshot IN ('1997', '2003', '2004-mid')""")
def trend_repeated(spark, sf):
    found = trend(views.copied_panel(spark, sf), ANCHOR, ["2004-mid", "2003", "1997"])
    return found.summary.select("found_in", "requested", "identical_across_snapshots")


# --------------------------------------------------------------- ids and headers


@query("snapshots_order", """SELECT DISTINCT CAST(year(o_orderdate) + 18 AS VARCHAR)
      || CASE WHEN month(o_orderdate) > 6 THEN '-mid' ELSE '' END AS snapshot,
    CAST(year(o_orderdate) + 18 AS INTEGER) AS year, CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS half FROM orders""")
def snapshots_order(spark, sf):
    return panels.published_snapshots(_half_years(spark, sf)).select("snapshot", "year", "half").orderBy("year", "half")


def _half_years(spark, sf) -> DataFrame:
    half = F.when(F.month("o_orderdate") > 6, F.lit("-mid")).otherwise(F.lit(""))
    return load(spark, sf, "orders").select(
        F.lit("cost-of-living").alias("vertical"),
        F.concat((F.year("o_orderdate") + 18).cast("string"), half).alias("snapshot"), "o_orderstatus",
    )


@query("archival_flags", """WITH ids AS (SELECT CAST(year(o_orderdate) + 12 AS VARCHAR)
      || CASE WHEN month(o_orderdate) > 6 THEN '-mid' ELSE '' END AS snapshot, year(o_orderdate) + 12 AS y,
      bool_or(o_orderstatus = 'P' AND day(o_orderdate) = 31) AS moved FROM orders GROUP BY 1, 2)
    SELECT snapshot, moved, y >= 2009 AND NOT moved
      AND TIMESTAMP '2012-06-28 23:59:59' >= make_date(CAST(y + 1 AS INTEGER), 1, 1) + INTERVAL 180 DAY AS archival FROM ids""")
def archival_flags(spark, sf):
    half = F.when(F.month("o_orderdate") > 6, F.lit("-mid")).otherwise(F.lit(""))
    moved = F.bool_or((F.col("o_orderstatus") == "P") & (F.dayofmonth("o_orderdate") == 31))
    ids = load(spark, sf, "orders").groupBy(
        F.concat((F.year("o_orderdate") + 12).cast("string"), half).alias("snapshot")
    ).agg(moved.alias("moved"))
    at = F.lit("2012-06-28 23:59:59").cast("timestamp")
    return ids.withColumn("archival", snap.is_archival(F.col("snapshot"), at, F.col("moved")))


def _priority_long(spark, sf) -> DataFrame:
    """A panel whose header differs per snapshot: one column per priority seen there."""
    kept = ~((F.year("o_orderdate") == 1997) & (F.col("o_orderpriority") == "2-HIGH"))
    return load(spark, sf, "orders").filter(kept).select(
        F.lit("cost-of-living").alias("vertical"), F.lit("city").alias("view"), F.lit("").alias("region"),
        F.year("o_orderdate").cast("string").alias("snapshot"),
        F.concat(F.lit("Orders "), F.substring("o_orderpriority", 3, 20)).alias("metric"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("at"),
    )


HEADERS = """WITH m AS (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS snapshot,
      'Orders ' || substr(o_orderpriority, 3, 20) AS metric, CAST(left(o_orderpriority, 1) AS INTEGER) AS "at"
      FROM orders WHERE NOT (year(o_orderdate) = 1997 AND o_orderpriority = '2-HIGH')),
    h AS (SELECT snapshot, string_agg(metric, ';' ORDER BY m."at") AS columns FROM m GROUP BY 1)"""


def _headers(spark, sf) -> DataFrame:
    return panels.header_columns(_priority_long(spark, sf), F.col("at")).select("snapshot", "columns")


@query("header_columns", HEADERS + " SELECT * FROM h")
def header_columns(spark, sf):
    return _headers(spark, sf).select("snapshot", F.array_join("columns", ";").alias("columns"))


@query("shared_columns", HEADERS + """ SELECT a.snapshot AS frm, string_agg(b.metric, ';' ORDER BY b."at") AS shared
      FROM m a JOIN m b ON a.metric = b.metric AND b.snapshot = '2001' GROUP BY 1""")
def shared_columns(spark, sf):
    h = _headers(spark, sf)
    newest = one_row(h.agg(F.max(F.when(F.col("snapshot") == "2001", F.col("columns"))).alias("to_columns")))
    shared = headers.shared_columns(F.col("to_columns"), F.col("columns"))
    return h.crossJoin(newest).select(F.col("snapshot").alias("frm"), F.array_join(shared, ";").alias("shared"))


@query("column_resolution", HEADERS + """ SELECT snapshot, min_by(metric, "at") FILTER (contains(lower(metric), 'hi')) AS sort_column,
      coalesce(string_agg(metric, ';' ORDER BY "at") FILTER (lower(metric) = 'orders low'),
               string_agg(metric, ';' ORDER BY "at") FILTER (contains(lower(metric), 'orders low'))) AS matches,
      CAST(coalesce(min(rn) FILTER (contains(lower(metric), 'medium')), min(rn)) - 1 AS INTEGER) AS medium_at
      FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY "at") AS rn FROM m) GROUP BY snapshot""")
def column_resolution(spark, sf):
    columns = F.col("columns")
    return _headers(spark, sf).select(
        "snapshot", headers.sort_column_expr(columns, "HI").alias("sort_column"),
        F.array_join(headers.matches_expr(columns, " orders   LOW "), ";").alias("matches"),
        headers.header_index_expr(columns, "medium", "orders").alias("medium_at"),
    )


@query("published_ids", """SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS snapshot FROM orders
    WHERE year(o_orderdate) NOT IN (1996, 2000)""")
def published_ids(spark, sf):
    ids = panels.published_snapshots(customer_panel(spark, sf))
    return ids.filter(~F.col("snapshot").isin("1996", "2000")).select("snapshot")


@query("only_in", MOVERS + """ SELECT place, status FROM rows_of WHERE status IN ('new', 'delisted')""")
def only_in(spark, sf):
    return _comparison(spark, sf).rows.filter(F.col("status").isin("new", "delisted")).select("place", "status")


@query("is_better", "WITH " + PANEL + diff_ctes("1996", "2000") + """ SELECT key,
    value_to < value_from AS cost_better, value_to > value_from AS salary_better FROM joined WHERE status = 'moved'""")
def better(spark, sf):
    rows = _comparison(spark, sf).rows.filter("status = 'moved'")
    a, b = F.col("value_to"), F.col("value_from")
    return rows.select(
        "key", is_better(F.lit("cheap_meal"), a, b).alias("cost_better"),
        is_better(F.lit("net_salary"), a, b).alias("salary_better"),
    )


@query("panel_long", "WITH " + PANEL + """ SELECT snapshot, metric, count(*) AS n, max(value) AS top FROM (
    SELECT snapshot, 'Order Revenue' AS metric, revenue AS value FROM panel
    UNION ALL SELECT snapshot, 'Order Count', orders_n FROM panel
    UNION ALL SELECT snapshot, 'Max Order', top_order FROM panel) GROUP BY 1, 2""")
def panel_long(spark, sf):
    long = panels.long_panel(customer_panel(spark, sf))
    return long.groupBy("snapshot", "metric").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("slice_identity", """SELECT DISTINCT 'crime/' || v || '/' || CASE WHEN v = 'region' THEN '150' ELSE '' END || '/'
      || CASE WHEN o_orderpriority = '5-LOW' THEN 'current' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS slice
    FROM orders, (VALUES ('city'), ('region')) t(v)""")
def slice_identity(spark, sf):
    snapshot = F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate").cast("string"))
    view = F.explode(F.array(F.lit("city"), F.lit("region")))
    base = load(spark, sf, "orders").select(snapshot.alias("snapshot"), view.alias("view"))
    name = panels.slice_identity(F.lit("crime"), F.col("view"), F.lit("150"), F.col("snapshot"))
    return base.select(name.alias("slice")).distinct()


@query("movers_from_store", MOVERS + f" SELECT {ROWS} FROM rows_of")
def movers_from_store(spark, sf):
    path = scratch_path(spark, "long")
    panels.write_long_panel(customer_panel(spark, sf, YEARS, ranked=True), path)
    stored = panels.read_metrics(spark, path, ["Order Revenue"])
    return diffing.diff_rows(diffing.sides_of(stored, "1996", "2000"), "Order Revenue")


@query("movers_from_keyed", MOVERS + f" SELECT {ROWS} FROM rows_of")
def movers_from_keyed(spark, sf):
    """From a panel stored in buckets by key: neither the aggregation nor the join moves a stored row."""
    path = scratch_path(spark, "keyed")
    panels.write_keyed_panel(customer_panel(spark, sf, YEARS, ranked=True), path)
    return diffing.diff_rows(diffing.sides_of(panels.read_keyed_panel(spark, path), "1996", "2000"), "Order Revenue")
