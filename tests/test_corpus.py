import datetime as dt

import pytest
from helpers import column, one
from pyspark.sql import functions as F

from panelspark.operators import corpus as ops
from panelspark.operators.headers import Refused
from panelspark.plans.audit import audit

NOW = dt.datetime(2026, 8, 25)
HOUR = dt.timedelta(hours=1)
CORPUS = (
    "vertical string, snapshot string, schema_tag string, fetched_at timestamp, file_mtime timestamp, readable boolean, "
    "moved boolean, keep boolean, fingerprint string, n_rows int, bytes bigint"
)
LISTS = "vertical string, ids array<string>, file_mtime timestamp, readable boolean, schema_tag string"


def entry(snapshot, *, vertical="crime", tag="t", age=HOUR, readable=True, moved=False, keep=False, fp=None, fetched=True):
    at = NOW - age
    return (vertical, snapshot, tag, at if fetched is True else fetched, at, readable, moved, keep, fp or snapshot, 5, 100)


def run(spark, lists, entries, **options):
    options = {"verticals": ["crime", "traffic"], "max_age": 6 * 3600, "list_max_age": 86_400, **options}
    return audit(
        spark.createDataFrame(lists, LISTS), spark.createDataFrame(entries, CORPUS),
        now=F.lit(NOW), schema_tag="t", **options,
    )


IDS = ["2026-mid", "2026", "2024", "2020", "2019", "2018"]
OLD = dt.timedelta(days=900)


def test_states_in_order(spark):
    entries = [
        entry("2026-mid"), entry("2026", age=OLD), entry("2024", age=OLD), entry("2020", age=OLD, moved=True),
        entry("2019", tag="older"), entry("2018", readable=False, tag="older"),
    ]
    done = run(spark, [("crime", [*IDS, "2017"], NOW - HOUR, True, "t")], entries, verticals=["crime"])
    states = {r.snapshot: r.state for r in done.targets.collect()}
    assert states == {
        "2026-mid": "fresh", "2026": "stale", "2024": "fresh", "2020": "stale", "2019": "schema_mismatch",
        "2018": "unreadable", "2017": "absent",
    }
    row = one(done.by_family)
    assert (row.denominator, row.fresh, row.to_fetch, row.already_cached, row.pinned, row.unpinned) == (7, 2, 5, 2, 5, 2)
    assert (row.age_min_s, row.age_max_s) == (3600, 900 * 86_400)
    assert one(done.outstanding).outstanding == 5
    ops.require_conservation(done.by_family)
    live = run(spark, [("crime", IDS, NOW - HOUR, True, "t")], entries, verticals=["crime"], max_age=0)
    assert "fresh" not in column(live.targets, "state")


def test_age_limit_is_exclusive(spark):
    lists = [("crime", ["2026", "2026-mid"], NOW - HOUR, True, "t")]
    entries = [entry("2026", age=6 * HOUR), entry("2026-mid", age=6 * HOUR - dt.timedelta(seconds=1))]
    states = {r.snapshot: r.state for r in run(spark, lists, entries, verticals=["crime"]).targets.collect()}
    assert states == {"2026": "stale", "2026-mid": "fresh"}


@pytest.mark.parametrize("row,source", [
    (None, "list_absent"),
    (("traffic", ["2020"], NOW - 48 * HOUR, True, "t"), "list_stale"),
    (("traffic", ["2020"], NOW - HOUR, True, "older"), "list_schema_mismatch"),
    (("traffic", [], NOW - HOUR, True, "t"), "list_empty"),
    (("traffic", ["latest"], NOW - HOUR, True, "t"), "list_empty"),
    (("traffic", None, NOW - HOUR, True, "t"), "list_not_array"),
])
def test_unknown_denominators_never_count_as_zero(spark, row, source):
    lists = [("crime", ["2020", "x", "2019"], NOW - HOUR, True, "t")] + ([row] if row else [])
    done = run(spark, lists, [entry("2020")])
    got = {r.vertical: r for r in done.by_family.collect()}
    assert got["crime"].unrecognised_ids == 1 and got["crime"].to_fetch == 1
    unknown = got["traffic"]
    assert (unknown.denominator, unknown.to_fetch, unknown.denominator_source) == (None, None, source)
    totals = one(done.totals)
    assert (totals.denominator, totals.to_fetch, totals.to_fetch_known) == (None, None, 1)
    assert (totals.requests_planned, totals.requests_planned_state, totals.complete) == (2, "floor", None)


def test_complete_and_repeated(spark):
    lists = [("crime", ["2020", "2019", "2018"], NOW - HOUR, True, "t")]
    fine = run(spark, lists, [entry("2020"), entry("2019"), entry("2018")], verticals=["crime"])
    graded = one(ops.grade(fine.totals))
    assert (graded.complete, graded.exit, graded.requests_planned_state) == (True, 0, "exact")
    same = run(spark, lists, [entry(s, fp="one") for s in ("2020", "2019", "2018")], verticals=["crime"])
    graded = one(ops.grade(same.totals))
    assert (graded.complete, graded.repeated_verticals, graded.exit) == (False, 1, 1)


@pytest.mark.parametrize("extra,code", [
    ({"aborted": True, "executed": True}, 2), ({"executed": True, "failed": 1}, 1), ({"executed": False, "failed": 1}, 0),
    ({"executed": True, "failed": 0, "ok": 3, "stored": 2}, 1), ({"executed": True, "failed": 0, "ok": 3, "stored": 3}, 0),
])
def test_grades(spark, extra, code):
    totals = spark.range(1).withColumn("repeated_verticals", F.lit(0))
    for name, value in extra.items():
        totals = totals.withColumn(name, F.lit(value))
    assert one(ops.grade(totals)).exit == code


def test_lost_category_is_refused(spark):
    done = run(spark, [("crime", ["2020"], NOW - HOUR, True, "t")], [entry("2020")], verticals=["crime"])
    # The one fresh entry is no longer counted anywhere, so 0 of 1 states are classified.
    broken = done.by_family.withColumn("fresh", F.lit(0).cast("bigint"))
    assert set(one(ops.conservation_errors(broken)).broken) == {"classified", "cached"}
    wrong_cost = done.by_family.withColumn("to_fetch", F.lit(7).cast("bigint"))
    assert one(ops.conservation_errors(wrong_cost)).broken == ["to_fetch"]
    with pytest.raises(Refused):
        ops.require_conservation(broken)
    ops.require_conservation(done.by_family, done.totals)
    with pytest.raises(Refused):
        ops.require_conservation(done.by_family, done.totals.withColumn("requests_planned", F.lit(9).cast("bigint")))
    checks = {(r.scope, r.check): r.holds for r in ops.conservation_checks(broken, done.totals).collect()}
    assert checks == {("crime", "classified"): False, ("crime", "cached"): False, ("crime", "to_fetch"): True,
                      ("all", "classified"): True, ("all", "requests_planned"): True}


def test_status_and_retention(spark):
    week = dt.timedelta(days=7)
    entries = [
        entry("2020", age=week + dt.timedelta(seconds=1)), entry("2019", age=week), entry("2018", keep=True, age=OLD),
        entry("2017", readable=False), entry("2016", fetched=None), entry("2015", fetched=NOW - 5 * HOUR),
    ]
    stored = spark.createDataFrame(entries, CORPUS)
    status = one(ops.corpus_status(stored, F.lit(NOW)))
    assert tuple(status) == (5, 1, 600, 1, 1, 1, 900 * 86_400)
    assert {r.schema_tag: r.entries for r in ops.corpus_schemas(stored).collect()} == {"t": 5}
    assert tuple(one(ops.retention_report(stored, F.lit(NOW)))) == (5, 1, 1)
    assert sorted(column(ops.pruned(stored, F.lit(NOW)), "snapshot")) == ["2015", "2016", "2017", "2018", "2019"]
    assert tuple(one(ops.clear_report(stored))) == (5, 1)
    assert column(ops.cleared(stored), "snapshot") == ["2018"]
    assert tuple(one(ops.clear_report(stored, include_archive=True))) == (6, 0)
    assert ops.cleared(stored, include_archive=True).count() == 0
