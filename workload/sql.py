"""The base views once more, in plain SQL, for the side-by-side check."""

from __future__ import annotations

from panelspark.vocab import ITEM_KEYS

from .views import CORPUS_TAG, IMPERIAL_LABELS, LIST_MAX_AGE, MAX_AGE, METRIC_LABELS, NOW

FIGURES = """
figures AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS snapshot,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
         CAST(count(*) AS DOUBLE) AS orders_n, max(o_totalprice) AS top_order
  FROM orders GROUP BY 1, 2)"""

PANEL = FIGURES + """,
panel AS (
  SELECT snapshot, c_name || ', ' || n_name || ', ' || r_name AS place, c_name AS city,
         n_name AS subdivision, r_name AS country, revenue, orders_n, top_order,
         regexp_replace(lower(c_name || ', ' || n_name || ', ' || r_name), '[^a-z0-9]', '', 'g') AS key,
         CAST(row_number() OVER (PARTITION BY snapshot ORDER BY revenue DESC,
              c_name || ', ' || n_name || ', ' || r_name) AS INTEGER) AS rank
  FROM figures JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

COPIED = PANEL + """,
copied AS (
  SELECT * FROM panel
  UNION ALL SELECT * REPLACE ('2003' AS snapshot) FROM panel WHERE snapshot = '1997'
  UNION ALL SELECT * REPLACE ('2004-mid' AS snapshot) FROM panel WHERE snapshot = '1997'),
prints AS (
  SELECT snapshot, CAST(count(*) AS INTEGER) AS n_rows,
         md5(string_agg(place || '|' || revenue || '|' || orders_n || '|' || top_order, ';' ORDER BY rank)) AS fp
  FROM copied GROUP BY snapshot)"""

PARTS = """
parts AS (
  SELECT p_partkey, p_size, p_retailprice,
         CASE WHEN p_size = 50 THEN '--' ELSE p_name || ', ' || p_brand END AS label FROM part),
part_rows AS (
  SELECT '2001' AS snapshot, p_partkey, label, p_retailprice AS price FROM parts WHERE p_size <= 30
  UNION ALL
  SELECT '2002', p_partkey, label, p_retailprice + p_size FROM parts WHERE p_size >= 29),
panel AS (
  SELECT snapshot, label AS place, split_part(label, ', ', 1) AS city, split_part(label, ', ', 2) AS country,
         price AS revenue, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS key,
         CAST(row_number() OVER (PARTITION BY snapshot ORDER BY p_partkey) AS INTEGER) AS rank
  FROM part_rows)"""


def diff_ctes(frm: str, to: str, value: str = "revenue", source: str = "panel", value_from: str | None = None) -> str:
    """Both sides, their unique keys, the full join and the excluded rows."""
    value_from = value_from or value
    return f""",
a_all AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {source} WHERE snapshot = '{frm}'),
b_all AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {source} WHERE snapshot = '{to}'),
a AS (SELECT * FROM a_all WHERE n = 1 AND key <> ''),
b AS (SELECT * FROM b_all WHERE n = 1 AND key <> ''),
sizes AS (SELECT (SELECT CAST(count(*) AS INTEGER) FROM a_all) AS of_from,
                 (SELECT CAST(count(*) AS INTEGER) FROM b_all) AS of_to),
joined AS (
  SELECT coalesce(b.place, a.place) AS place, coalesce(b.city, a.city) AS city,
         coalesce(b.country, a.country) AS country, coalesce(b.key, a.key) AS key,
         CASE WHEN a.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'delisted'
              WHEN a.{value_from} IS NULL AND b.{value} IS NULL THEN 'metric_absent_in_both'
              WHEN a.{value_from} IS NULL THEN 'metric_absent_in_from'
              WHEN b.{value} IS NULL THEN 'metric_absent_in_to' ELSE 'moved' END AS status,
         a.{value_from} AS value_from, b.{value} AS value_to, b.{value} - a.{value_from} AS delta,
         CASE WHEN a.{value_from} > 0 THEN (b.{value} - a.{value_from}) / a.{value_from} * 100.0 END AS pct,
         a.rank AS rank_from, b.rank AS rank_to
  FROM a FULL JOIN b ON a.key = b.key),
all_rows AS (
  SELECT place, city, country, key, status,
         CASE WHEN status = 'moved' AND pct IS NULL THEN 'base_not_positive' END AS reason,
         value_from, value_to, delta, pct, rank_from, rank_to FROM joined
  UNION ALL
  SELECT place, city, country, key, CASE WHEN key = '' THEN 'unkeyable_label' ELSE 'duplicate_key' END,
         'excluded_from_from_snapshot', NULL, NULL, NULL, NULL, NULL, NULL FROM a_all WHERE key = '' OR n > 1
  UNION ALL
  SELECT place, city, country, key, CASE WHEN key = '' THEN 'unkeyable_label' ELSE 'duplicate_key' END,
         'excluded_from_to_snapshot', NULL, NULL, NULL, NULL, NULL, NULL FROM b_all WHERE key = '' OR n > 1),
rows_of AS (
  SELECT place, city, country, key, status, reason, value_from, value_to, delta, pct,
         rank_from, of_from, rank_to, of_to FROM all_rows, sizes)"""


def _labels(name: str, table: dict[str, str]) -> str:
    values = ", ".join("'" + table[k].replace("'", "''") + "'" for k in ITEM_KEYS)
    return f"[{values}] AS {name}"


_KEYS = "[" + ", ".join(f"'{k}'" for k in ITEM_KEYS) + "]"

ITEMS = f"""
labels AS (SELECT {_labels('metric_labels', METRIC_LABELS)}, {_labels('imperial_labels', IMPERIAL_LABELS)},
                  {_KEYS} AS item_keys),
priced AS (
  SELECT l_suppkey, CAST(p_partkey % {len(ITEM_KEYS)} AS INTEGER) AS item,
         CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS again, count(*) AS n,
         CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS top
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
items AS (
  SELECT replace(s_name, '#', '-') AS entity, n_name AS country, item * 2 + again AS pos,
         CASE WHEN s_nationkey % 3 = 0 THEN imperial_labels[item + 1] ELSE metric_labels[item + 1] END AS label,
         CASE WHEN n < 10 THEN '?' ELSE '$' || CAST(top AS VARCHAR) END AS value_text,
         item_keys[item + 1] AS key, s_nationkey % 3 = 0 AS maybe_imperial
  FROM priced JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey, labels),
keyed AS (
  SELECT entity, country, key, pos, label, value_text,
         CASE WHEN value_text <> '?' THEN CAST(replace(value_text, '$', '') AS DOUBLE) END AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY entity, key ORDER BY pos) AS rn FROM items) WHERE rn = 1),
systems AS (
  SELECT entity, max(country) AS country,
         CASE WHEN bool_or(label LIKE '%Square Feet%' OR label LIKE '%1 mile%') THEN 'imperial' ELSE 'metric' END
           AS measurement_system FROM items GROUP BY entity),
figures AS (
  SELECT k.entity, s.country, s.measurement_system, key, label, value_text,
         CASE WHEN measurement_system = 'imperial' AND key IN ('buy_sqm_center', 'buy_sqm_outside')
                THEN round(value * 10.7639, 4)
              WHEN measurement_system = 'imperial' AND key = 'taxi_km'
                THEN round(value * CAST({1 / 1.60934!r} AS DOUBLE), 4)
              ELSE value END AS value
  FROM keyed k JOIN systems s USING (entity)),
basket AS (
  SELECT * FROM (VALUES ('rent_1br_outside', 1, 0), ('utilities', 1, 1), ('internet', 1, 2), ('mobile', 1, 3),
                        ('transport_pass', 1, 4), ('cheap_meal', 30, 5)) t(key, mult, ord)),
budgets AS (
  SELECT s.entity, s.country,
         CASE WHEN count(f.value) = count(*) THEN round(sum(f.value * b.mult ORDER BY b.ord), 2) END AS budget,
         coalesce(string_agg(b.key, ';' ORDER BY b.ord) FILTER (WHERE f.value IS NULL), '') AS missing,
         CAST(count(f.value) AS INTEGER) AS n_parts
  FROM systems s CROSS JOIN basket b LEFT JOIN figures f ON f.entity = s.entity AND f.key = b.key
  GROUP BY s.entity, s.country),
records AS (
  SELECT b.*, sal.value AS net_salary, rent.value AS rent,
         round(sal.value - b.budget, 2) AS savings,
         round(rent.value / nullif(sal.value, 0) * 100, 1) AS rent_to_income_pct
  FROM budgets b
  LEFT JOIN figures sal ON sal.entity = b.entity AND sal.key = 'net_salary'
  LEFT JOIN figures rent ON rent.entity = b.entity AND rent.key = 'rent_1br_outside'),
control AS (
  SELECT replace(s_name, '#', '-') AS entity,
         CASE WHEN s_acctbal >= 0 THEN round(total / n * 35 * (1 + s_nationkey / 10.0::DOUBLE), 2) END AS local
  FROM supplier JOIN (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
                             count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey),
checked AS (
  SELECT r.*, nullif(c.local, 0) AS control_local,
         nullif(r.budget, 0) / nullif(c.local, 0) AS ratio_exact
  FROM records r LEFT JOIN control c USING (entity))"""

CORPUS = f"""
clock AS (SELECT TIMESTAMP '{NOW}' AS now),
entries AS (
  SELECT event_type AS vertical,
         CAST(2010 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 2 AS VARCHAR)
           || CASE WHEN date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 2 = 1 THEN '-mid' ELSE '' END AS snapshot,
         CAST(count(*) AS INTEGER) AS n_events, max(ts) AS last_ts, min(ts) AS first_ts, max(value) AS top_value,
         max(event_id) AS last_id, CAST(sum(length(props)) AS BIGINT) AS bytes
  FROM events GROUP BY 1, 2),
corpus AS (
  SELECT vertical, snapshot, CASE WHEN last_id % 11 = 0 THEN 'panel-1' ELSE '{CORPUS_TAG}' END AS schema_tag,
         CASE WHEN last_id % 13 <> 0 THEN first_ts END AS fetched_at, last_ts AS file_mtime,
         last_id % 17 <> 0 AS readable, last_id % 5 = 0 AS moved, last_id % 4 = 0 AS keep,
         CASE WHEN n_events % 9 = 0 THEN '' ELSE vertical || '/' || CAST(n_events % 17 AS VARCHAR) END AS fingerprint,
         n_events AS n_rows, bytes
  FROM entries WHERE top_value > 60),
verticals AS (
  SELECT * FROM (VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view'), (5, 'refund'))
    t(vertical_no, vertical)),
lists AS (
  SELECT v.vertical_no, v.vertical,
         CASE WHEN e.vertical IS NULL THEN 'absent'
              WHEN v.vertical = 'view' THEN 'schema_mismatch'
              WHEN date_diff('second', e.last_ts, clock.now) < {LIST_MAX_AGE} THEN 'fresh' ELSE 'stale' END AS list_state,
         v.vertical = 'signup' AS list_empty
  FROM verticals v LEFT JOIN (SELECT vertical, max(last_ts) AS last_ts FROM entries GROUP BY 1) e USING (vertical), clock),
known AS (SELECT * FROM lists WHERE list_state = 'fresh' AND NOT list_empty),
targets AS (
  SELECT k.vertical_no, k.vertical,
         CAST(row_number() OVER (PARTITION BY k.vertical ORDER BY e.snapshot) - 1 AS INTEGER) AS snapshot_no, e.snapshot,
         CASE WHEN c.vertical IS NULL THEN 'absent' WHEN NOT c.readable THEN 'unreadable'
              WHEN c.schema_tag <> '{CORPUS_TAG}' THEN 'schema_mismatch'
              WHEN (p.pinned AND NOT c.moved) OR a.age_s < {MAX_AGE} THEN 'fresh' ELSE 'stale' END AS state,
         CASE WHEN c.readable THEN a.age_s END AS age_s, p.pinned, c.fingerprint
  FROM known k JOIN entries e USING (vertical)
  LEFT JOIN corpus c ON c.vertical = e.vertical AND c.snapshot = e.snapshot, clock,
  LATERAL (SELECT CAST(floor(epoch_us(clock.now) / 1000000.0 - epoch_us(c.file_mtime) / 1000000.0) AS BIGINT) AS age_s) a,
  LATERAL (SELECT clock.now >= make_date(CAST(left(e.snapshot, 4) AS INTEGER) + 1, 1, 1) + INTERVAL 180 DAY AS pinned) p),
counted AS (
  SELECT vertical, count(*) AS denominator,
         count(*) FILTER (state = 'fresh') AS fresh, count(*) FILTER (state = 'stale') AS stale,
         count(*) FILTER (state = 'schema_mismatch') AS schema_mismatch,
         count(*) FILTER (state = 'unreadable') AS unreadable, count(*) FILTER (state = 'absent') AS absent,
         count(*) FILTER (pinned) AS pinned, count(*) FILTER (NOT pinned) AS unpinned,
         min(age_s) FILTER (state = 'fresh') AS age_min_s, max(age_s) FILTER (state = 'fresh') AS age_max_s
  FROM targets GROUP BY 1),
by_family AS (
  SELECT l.vertical_no, l.vertical, l.list_state,
         CASE WHEN l.list_state <> 'fresh' THEN 'list_' || l.list_state
              WHEN l.list_empty THEN 'list_empty' ELSE 'list_known' END AS denominator_source,
         CASE WHEN c.vertical IS NOT NULL THEN 1 END AS unrecognised_ids,
         CASE WHEN c.vertical IS NULL THEN 'unknown' ELSE 'known' END AS denominator_state,
         c.denominator, coalesce(fresh, 0) AS fresh, coalesce(stale, 0) AS stale,
         coalesce(schema_mismatch, 0) AS schema_mismatch, coalesce(unreadable, 0) AS unreadable,
         coalesce(absent, 0) AS absent, c.fresh AS already_cached, c.denominator - c.fresh AS to_fetch,
         c.pinned, c.unpinned, CASE WHEN c.vertical IS NULL THEN 1 ELSE 0 END AS list_request_cost,
         age_min_s, age_max_s
  FROM lists l LEFT JOIN counted c USING (vertical)),
held AS (
  SELECT vertical, fingerprint, count(*) AS n FROM targets
  WHERE state IN ('fresh', 'stale') AND fingerprint IS NOT NULL GROUP BY 1, 2),
repeats AS (
  SELECT vertical, CAST(sum(n) AS BIGINT) AS "of", count(*) FILTER (fingerprint <> '') AS distinct_tables,
         CAST(coalesce(max(n) FILTER (fingerprint <> ''), 0) AS BIGINT) AS max_repeat,
         CAST(coalesce(sum(n) FILTER (fingerprint = ''), 0) AS BIGINT) AS unfingerprintable,
         coalesce(max(n) FILTER (fingerprint <> ''), 0) >= 3 AS repeated
  FROM held GROUP BY 1)"""

ENTITIES = """
entities AS (
  SELECT lower(replace(c_name, '#', '-')) AS slug, c_name AS name, n_name AS country, r_name AS region,
         c_acctbal AS cost_usd, CAST(c_custkey % 97 AS DOUBLE) AS internet_mbps,
         CAST(c_nationkey * 4 AS DOUBLE) AS safety, CAST(c_nationkey - 5 AS DOUBLE) AS temperature_c, c_custkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
