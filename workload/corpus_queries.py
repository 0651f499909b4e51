"""Queries over the stored corpus: audit, totals, status, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import corpus as ops
from panelspark.operators.fingerprints import distinct_tables, repeated_anywhere
from panelspark.plans.audit import Audit, audit, stated

from .registry import query
from .sql import CORPUS
from .views import CORPUS_FAMILIES, CORPUS_TAG, LIST_MAX_AGE, MAX_AGE, NOW, event_corpus, event_lists, now

SQL = "WITH " + CORPUS
FAMILIES = (*CORPUS_FAMILIES, "refund")
STATES = "fresh, stale, schema_mismatch, unreadable, absent"


def _audit(spark, sf) -> Audit:
    return audit(
        event_lists(spark, sf), event_corpus(spark, sf), now=now(), schema_tag=CORPUS_TAG,
        verticals=FAMILIES, known=FAMILIES, max_age=MAX_AGE, list_max_age=LIST_MAX_AGE,
    )


@query("corpus_targets", SQL + """ SELECT CAST(vertical_no AS INTEGER) AS vertical_no, vertical, snapshot_no, snapshot, state,
    age_s, pinned, fingerprint FROM targets""")
def corpus_targets(spark, sf):
    return _audit(spark, sf).targets


@query("corpus_partition", SQL + f""" SELECT vertical, denominator, {STATES}, already_cached, to_fetch, pinned, unpinned FROM by_family""")
def corpus_partition(spark, sf):
    return _audit(spark, sf).by_family.select(
        "vertical", "denominator", "fresh", "stale", "schema_mismatch", "unreadable", "absent",
        "already_cached", "to_fetch", "pinned", "unpinned",
    )


@query("corpus_denominator", SQL + """ SELECT vertical, list_state, denominator_source, denominator_state,
    CAST(unrecognised_ids AS INTEGER) AS unrecognised_ids, CAST(list_request_cost AS INTEGER) AS list_request_cost FROM by_family""")
def corpus_denominator(spark, sf):
    return _audit(spark, sf).by_family.select(
        "vertical", "list_state", "denominator_source", "denominator_state", "unrecognised_ids", "list_request_cost"
    )


TOTALS = SQL + """, totals AS (SELECT count(*) AS "rows", count(*) FILTER (denominator_state = 'unknown') AS unknown_verticals,
    CASE WHEN bool_and(denominator_state = 'known') THEN CAST(sum(denominator) AS BIGINT) END AS denominator,
    CAST(sum(fresh) AS BIGINT) AS fresh, CAST(sum(stale) AS BIGINT) AS stale,
    CAST(sum(schema_mismatch) AS BIGINT) AS schema_mismatch, CAST(sum(unreadable) AS BIGINT) AS unreadable,
    CAST(sum(absent) AS BIGINT) AS absent,
    CASE WHEN bool_and(denominator_state = 'known') THEN CAST(sum(to_fetch) AS BIGINT) END AS to_fetch,
    CAST(sum(to_fetch) AS BIGINT) AS to_fetch_known, CAST(sum(list_request_cost) AS BIGINT) AS list_requests,
    CAST(sum(pinned) AS BIGINT) AS pinned, CAST(sum(unpinned) AS BIGINT) AS unpinned,
    min(age_min_s) AS age_min_s, max(age_max_s) AS age_max_s,
    (SELECT count(*) FILTER (repeated) FROM repeats) AS repeated_verticals,
    CAST(sum(to_fetch) + sum(list_request_cost) AS BIGINT) AS requests_planned,
    CASE WHEN bool_and(denominator_state = 'known') THEN 'exact' ELSE 'floor' END AS requests_planned_state,
    CASE WHEN bool_and(denominator_state = 'known') THEN sum(to_fetch) = 0
      AND (SELECT count(*) FILTER (repeated) FROM repeats) = 0 END AS complete FROM by_family)"""


@query("corpus_totals", TOTALS + " SELECT * FROM totals")
def corpus_totals(spark, sf):
    return _audit(spark, sf).totals


@query("corpus_grade", TOTALS + " SELECT repeated_verticals, CASE WHEN repeated_verticals > 0 THEN 1 ELSE 0 END AS exit FROM totals")
def corpus_grade(spark, sf):
    return ops.grade(_audit(spark, sf).totals).select("repeated_verticals", "exit")


@query("corpus_outstanding", SQL + " SELECT count(*) FILTER (state <> 'fresh') AS outstanding FROM targets")
def corpus_outstanding(spark, sf):
    return _audit(spark, sf).outstanding


@query("corpus_repeats", SQL + " SELECT * FROM repeats")
def corpus_repeats(spark, sf):
    return _audit(spark, sf).repeats


@query("corpus_conservation", SQL + f""" SELECT vertical, '' AS broken FROM by_family WHERE denominator_state = 'known'
    AND NOT (fresh + stale + schema_mismatch + unreadable + absent = denominator AND to_fetch = denominator - fresh)""")
def corpus_conservation(spark, sf):
    errors = ops.conservation_errors(_audit(spark, sf).by_family)
    return errors.select("vertical", F.array_join("broken", ";").alias("broken"))


CHECKS = """ SELECT unnest([vertical, vertical, vertical]) AS scope, unnest(['classified', 'cached', 'to_fetch']) AS "check",
      unnest([s, already_cached, to_fetch]) AS got, unnest([denominator, fresh, s - fresh]) AS wanted FROM (
        SELECT *, fresh + stale + schema_mismatch + unreadable + absent AS s FROM {source} WHERE denominator_state = 'known')"""


@query("conservation_checks", TOTALS + f""", checks AS ({CHECKS.format(source="by_family")}
      UNION ALL SELECT 'all', 'classified', fresh + stale + schema_mismatch + unreadable + absent,
        coalesce(denominator, fresh + stale + schema_mismatch + unreadable + absent) FROM totals
      UNION ALL SELECT 'all', 'requests_planned', requests_planned, to_fetch_known + list_requests FROM totals)
    SELECT scope, "check", CAST(got AS BIGINT) AS got, CAST(wanted AS BIGINT) AS wanted, got = wanted AS holds FROM checks""")
def conservation_checks(spark, sf):
    done = stated(
        event_lists(spark, sf), event_corpus(spark, sf), now=now(), schema_tag=CORPUS_TAG,
        verticals=FAMILIES, known=FAMILIES, max_age=MAX_AGE, list_max_age=LIST_MAX_AGE,
    )
    return ops.conservation_checks(done.by_family, done.totals)


@query("conservation_broken", SQL + f""", broken AS (SELECT * REPLACE (CASE WHEN fresh > 0 THEN fresh - 1 ELSE fresh END AS fresh,
      CASE WHEN vertical = 'click' THEN NULL ELSE to_fetch END AS to_fetch) FROM by_family), checks AS ({CHECKS.format(source="broken")})
    SELECT scope, "check", CAST(got AS BIGINT) AS got, CAST(wanted AS BIGINT) AS wanted, coalesce(got = wanted, false) AS holds FROM checks""")
def conservation_broken(spark, sf):
    """A report that lost a fresh entry in every family that has one, and one cost: its faults show."""
    lossy = _audit(spark, sf).by_family.withColumns({
        "fresh": F.when(F.col("fresh") > 0, F.col("fresh") - 1).otherwise(F.col("fresh")),
        "to_fetch": F.when(F.col("vertical") != "click", F.col("to_fetch")),
    })
    return ops.conservation_checks(lossy)


@query("corpus_unpinned", SQL + " SELECT vertical, snapshot FROM targets WHERE NOT pinned")
def corpus_unpinned(spark, sf):
    return _audit(spark, sf).targets.filter("NOT pinned").select("vertical", "snapshot")


@query("corpus_status", SQL + """ SELECT count(*) FILTER (NOT keep) AS ordinary, count(*) FILTER (keep) AS archived,
    CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (NOT readable) AS unreadable,
    count(*) FILTER (readable AND fetched_at IS NULL) AS legacy,
    count(*) FILTER (readable AND abs(epoch_us(file_mtime) - epoch_us(fetched_at)) > 3600000000) AS mtime_skew,
    CAST(max(floor(epoch_us(now) / 1000000.0 - epoch_us(fetched_at) / 1000000.0)) FILTER (readable) AS BIGINT) AS oldest_fetch_s
    FROM corpus, clock""")
def corpus_status(spark, sf):
    return ops.corpus_status(event_corpus(spark, sf), now())


@query("corpus_schemas", SQL + " SELECT schema_tag, count(*) AS entries FROM corpus WHERE readable GROUP BY 1")
def corpus_schemas(spark, sf):
    return ops.corpus_schemas(event_corpus(spark, sf))


RETENTION = 20 * 86_400


@query("retention", SQL + f""" SELECT count(*) FILTER (NOT keep) AS scanned, count(*) FILTER (NOT keep
    AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(file_mtime) > {RETENTION}000000) AS removed,
    count(*) FILTER (keep) AS protected FROM corpus""")
def retention(spark, sf):
    return ops.retention_report(event_corpus(spark, sf), now(), RETENTION)


@query("retention_kept", SQL + f""" SELECT vertical, snapshot FROM corpus WHERE keep
    OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(file_mtime) <= {RETENTION}000000""")
def retention_kept(spark, sf):
    return ops.pruned(event_corpus(spark, sf), now(), RETENTION).select("vertical", "snapshot")


@query("corpus_cleared", SQL + " SELECT count(*) FILTER (NOT keep) AS removed, count(*) FILTER (keep) AS protected FROM corpus")
def corpus_cleared(spark, sf):
    return ops.clear_report(event_corpus(spark, sf))


@query("corpus_repeat_union", SQL + """, shifted AS (SELECT vertical, fingerprint, count(*) AS n FROM corpus
      WHERE readable AND fingerprint <> '' GROUP BY 1, 2)
    SELECT vertical FROM repeats WHERE repeated UNION SELECT vertical FROM shifted GROUP BY 1 HAVING max(n) >= 3""")
def corpus_repeat_union(spark, sf):
    held = distinct_tables(event_corpus(spark, sf).filter("readable"), ["vertical"])
    return repeated_anywhere(_audit(spark, sf).repeats, held)
