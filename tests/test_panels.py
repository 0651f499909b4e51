import random
import statistics

import pytest
from helpers import column, one, panel, sides
from pyspark.sql import functions as F

from panelspark.operators import diffing, fingerprints, headers, panels, places
from panelspark.operators.medians import exact_medians, exact_medians_of
from panelspark.operators.numbering import number_rows
from panelspark.plans import movers as movers_plan
from panelspark.plans.rank import rank
from panelspark.plans.trend import trend

COL = "Crime Index"


# ----------------------------------------------------------------- numbering, medians


def test_row_numbers_match_a_sort_even_for_one_hot_slice(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), rng.randint(0, 5), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, v int, id int").repartition(7)
    out = number_rows(df, ["s"], [F.col("v").desc(), F.col("id").asc()], "n").collect()
    for name in "ab":
        want = [r[2] for r in sorted((r for r in rows if r[0] == name), key=lambda r: (-r[1], r[2]))]
        got = [r.id for r in sorted((r for r in out if r.s == name), key=lambda r: r.n)]
        assert got == want
        assert sorted(r.n for r in out if r.s == name) == list(range(1, len(want) + 1))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 101, 2000])
def test_medians_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, 0.0, rng.uniform(-5, 5)]) for _ in range(n)]
    df = spark.createDataFrame([(v, "g") for v in values] + [(None, "g"), (None, "h")], "v double, g string")
    assert one(exact_medians_of(df, {"m": F.col("v")})).m == statistics.median(values)
    grouped = {r.g: (r.n, r.median) for r in exact_medians(df, ["g"], "v").collect()}
    assert grouped == {"g": (n, statistics.median(values))}


def test_median_of_a_large_tied_column(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = [0.0 if i % 3 == 0 else float(i) for i in range(300_000)]
    assert one(exact_medians_of(df, {"m": F.col("v")})).m == statistics.median(values)


def test_medians_by_rounds(spark, monkeypatch):
    from panelspark.operators import medians

    monkeypatch.setattr(medians, "FEW_VALUES", 20)
    rng = random.Random(4)
    values = [rng.choice([rng.gauss(0, 1e3), rng.expovariate(1e-6), 7.0]) for _ in range(30_000)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v double, g int")
    assert one(exact_medians_of(df, {"m": F.col("v")})).m == statistics.median(values)
    grouped = {r.g: r.median for r in exact_medians(df, ["g"], "v").collect()}
    assert grouped == {g: statistics.median(values[g::3]) for g in range(3)}


def test_median_of_nothing_is_unknown(spark):
    df = spark.createDataFrame([], "v double")
    assert one(exact_medians_of(df, {"m": F.col("v")})).m is None


# ------------------------------------------------------------------------- the join


@pytest.fixture(scope="module")
def status_sides(spark):
    before = [
        ("Rome, Italy", {COL: 50.0}), ("Oslo, Norway", {COL: None}), ("Lima, Peru", {COL: 20.0}),
        ("Bern, Switzerland", {COL: None}), ("Gone, Nowhere", {COL: 9.0}), ("Zero, Base", {COL: 0.0}),
        ("Twin, A", {COL: 1.0}), ("Twin A", {COL: 2.0}), ("Half, B", {COL: 3.0}), ("東京", {COL: 4.0}),
    ]
    after = [
        ("Oslo, Norway", {COL: 30.0}), ("Rome, Italy", {COL: 60.0}), ("Lima, Peru", {COL: None}),
        ("Bern, Switzerland", {COL: None}), ("Fresh, Start", {COL: 8.0}), ("Zero, Base", {COL: 5.0}),
        ("Twin, A", {COL: 7.0}), ("Half, B", {COL: 3.0}), ("Half B", {COL: 4.0}),
    ]
    return sides(spark, before, after)


def test_every_status(status_sides):
    rows = diffing.diff_rows(diffing.sides(*status_sides), COL).collect()
    got = {(r.place, r.status, r.reason, r.value_from, r.value_to, r.delta, r.pct) for r in rows}
    assert got == {
        ("Rome, Italy", "moved", None, 50.0, 60.0, 10.0, 20.0),
        ("Oslo, Norway", "metric_absent_in_from", None, None, 30.0, None, None),
        ("Lima, Peru", "metric_absent_in_to", None, 20.0, None, None, None),
        ("Bern, Switzerland", "metric_absent_in_both", None, None, None, None, None),
        ("Fresh, Start", "new", None, None, 8.0, None, None),
        ("Gone, Nowhere", "delisted", None, 9.0, None, None, None),
        ("Zero, Base", "moved", "base_not_positive", 0.0, 5.0, 5.0, None),
        ("Twin, A", "new", None, None, 7.0, None, None),
        ("Half, B", "delisted", None, 3.0, None, None, None),
        ("Twin, A", "duplicate_key", "excluded_from_from_snapshot", None, None, None, None),
        ("Twin A", "duplicate_key", "excluded_from_from_snapshot", None, None, None, None),
        ("Half, B", "duplicate_key", "excluded_from_to_snapshot", None, None, None, None),
        ("Half B", "duplicate_key", "excluded_from_to_snapshot", None, None, None, None),
        ("東京", "unkeyable_label", "excluded_from_from_snapshot", None, None, None, None),
    }
    assert {(r.of_from, r.of_to) for r in rows} == {(10, 9)}
    assert not any("rank_delta" in name for name in diffing.ROW_COLUMNS)


def test_status_counts_name_every_status(status_sides):
    result = movers_plan.diff(diffing.sides(*status_sides), [COL], [COL])
    counts = {r.status: r.n for r in result.counts().collect()}
    assert counts == {
        "moved": 2, "metric_absent_in_from": 1, "metric_absent_in_to": 1, "metric_absent_in_both": 1,
        "not_finite": 0, "new": 2, "delisted": 2, "duplicate_key": 4, "unkeyable_label": 1,
    }
    summary = one(result.summary)
    assert (summary.of_from, summary.of_to, summary.joined) == (10, 9, 5)
    assert summary.median_delta == 7.5 and summary.median_pct == 20.0
    excluded = {(r.side, r.key, r.reason, r.n) for r in result.excluded.collect()}
    assert excluded == {
        ("from", "twina", "duplicate_key", 2), ("to", "halfb", "duplicate_key", 2), ("from", "", "unkeyable_label", 1)
    }


def test_rows_of_a_hot_repeated_key_are_refused_whole(spark):
    rows = [("Hot, X", {COL: float(i)}) for i in range(700)] + [(f"C{i}, X", {COL: 1.0}) for i in range(20)]
    from_table, to_table = sides(spark, rows, rows[700:])
    refused = diffing.diff_rows(diffing.sides(from_table, to_table), COL).filter("status = 'duplicate_key'")
    assert refused.count() == 700 and set(column(refused, "key")) == {"hotx"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_keys_are_compared_without_an_exchange(spark, tmp_path):
    both = panel(spark, {"2019": [(f"C{i}, X", {COL: float(i)}) for i in range(50)], "2020": [(f"C{i}, X", {COL: 1.0}) for i in range(40)]})
    panels.write_keyed_panel(both, str(tmp_path / "keyed"), 4)
    stored = panels.read_keyed_panel(spark, str(tmp_path / "keyed"))
    together = diffing.sides_of(stored, "2019", "2020")
    pairs = diffing.pair_by_key(together, COL, [COL])
    rows = diffing.compared(pairs, together)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(rows)
        assert "Exchange" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan
        assert sorted(r.status for r in rows.collect()) == ["delisted"] * 10 + ["moved"] * 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_views_do_not_mix(spark):
    city = panel(spark, {"2019": [("A, X", {COL: 1.0})], "2020": [("A, X", {COL: 3.0})]})
    country = panel(spark, {"2019": [("A, X", {COL: 5.0})], "2020": [("A, X", {COL: 9.0})]}).withColumn("view", F.lit("country"))
    heads = dict.fromkeys(["2019", "2020"], [COL])
    for by, delta in (("city", 2.0), ("country", 4.0)):
        found = movers_plan.compare_snapshots(city.unionByName(country), list(heads), heads, frm="2019", to="2020", by=by)
        assert [r.delta for r in found.rows.collect()] == [delta]


# ---------------------------------------------------------------------- drift alarms


def _series(n, before, after, other_before=None, other_after=None):
    left = [(f"P{i}, X", {COL: before(i), "Other": (other_before or (lambda _: 1.0))(i)}) for i in range(n)]
    right = [(f"P{i}, X", {COL: after(i), "Other": (other_after or (lambda _: 1.0))(i)}) for i in range(n)]
    return left, right


def _summary(spark, left, right, columns=(COL, "Other")):
    return one(movers_plan.diff(diffing.sides(*sides(spark, left, right)), columns, columns, COL).summary)


@pytest.mark.parametrize("n,fires", [(10, True), (9, False)])
def test_frozen_column_needs_ten_rows(spark, n, fires):
    s = _summary(spark, *_series(n, float, float, lambda i: 1.0, lambda i: 2.0))
    assert ("diffed_column_did_not_move_while_another_did" in s.partial_drift) is fires
    assert s.control_moved is True and s.zero_delta_share == 1.0


def test_control_is_three_valued(spark):
    still = _summary(spark, *_series(12, float, float))
    assert still.control_moved is False and still.partial_drift == []
    blind = _summary(spark, *_series(12, float, float, lambda i: None, lambda i: 2.0))
    assert blind.control_moved is None and blind.partial_drift == []
    alone = _summary(spark, *_series(12, float, float), columns=(COL,))
    assert alone.control_moved is None


@pytest.mark.parametrize("n,values,fires", [(50, 3, True), (49, 3, False), (50, 4, False)])
def test_distinct_delta_floor(spark, n, values, fires):
    s = _summary(spark, *_series(n, float, lambda i: i + float(i % values)))
    assert ("too_few_distinct_deltas" in s.partial_drift) is fires


@pytest.mark.parametrize("n,up,fires", [(10, 9, True), (10, 8, False), (9, 9, False)])
def test_rebase_needs_share_and_sample(spark, n, up, fires):
    s = _summary(spark, *_series(n, lambda i: 10.0, lambda i: 11.0 + i if i < up else 9.0))
    assert s.rebase_suspected is fires


@pytest.mark.parametrize("shared,below", [(2, False), (1, True)])
def test_overlap_floor(spark, shared, below):
    left = [(f"P{i}, X", {COL: 1.0}) for i in range(4)]
    right = [(f"P{i}, X" if i < shared else f"Q{i}, X", {COL: 2.0}) for i in range(4)]
    s = _summary(spark, left, right, (COL,))
    assert s.below_floor is below and s.overlap_pct_of_smaller == 25.0 * shared


def test_empty_sides_have_unknown_shares(spark):
    s = _summary(spark, [], [("A, B", {COL: 1.0})], (COL,))
    assert s.overlap_pct_of_smaller is None and s.below_floor is False
    assert s.zero_delta_share is None and s.same_direction_share is None and s.median_delta is None


# ------------------------------------------------------------------ order, truncation


@pytest.fixture(scope="module")
def moved(spark):
    left = [("A, X", {COL: 10.0}), ("B, X", {COL: 1.0}), ("C, X", {COL: 0.0}), ("D, X", {COL: 5.0}), ("E, X", {COL: 20.0})]
    right = [("A, X", {COL: 15.0}), ("B, X", {COL: 3.0}), ("C, X", {COL: 4.0}), ("D, X", {COL: 5.0}), ("E, X", {COL: 15.0})]
    return movers_plan.diff(diffing.sides(*sides(spark, left, right)), [COL], [COL])


def test_orders_and_directions(moved):
    names = lambda df: [r.place[0] for r in df.collect()]
    assert names(moved.movers()) == ["A", "E", "C", "B", "D"]
    assert names(moved.movers("pct")) == ["B", "A", "E", "D", "C"]
    assert names(moved.movers(direction="rising")) == ["A", "C", "B"]
    assert names(moved.movers(direction="falling")) == ["E"]
    assert names(moved.movers(top=2)) == ["A", "E"]
    with pytest.raises(ValueError):
        moved.movers("size")
    with pytest.raises(ValueError):
        moved.movers(direction="up")


def test_truncation_is_counted(moved):
    cut = one(diffing.truncation_counts(moved.summary, "rising", 2))
    assert (cut.joined, cut.matched_direction, cut.shown, cut.truncated) == (5, 3, 2, True)
    whole = one(diffing.truncation_counts(moved.summary))
    assert (whole.matched_direction, whole.shown, whole.truncated) == (5, 5, False)


# --------------------------------------------------------------------- fingerprints


def _tables(spark, **extra):
    base = [("A, X", {COL: 1.0, "O": 2.0}), ("B, X", {COL: None, "O": 3.0})]
    return panel(spark, {"2014": base, "2015": base, "2016": base[::-1], "2017": base[:1], **extra})


def test_fingerprints_see_order_values_and_size(spark):
    prints = {r.snapshot: r.fingerprint for r in fingerprints.panel_fingerprints(_tables(spark)).collect()}
    assert prints["2014"] == prints["2015"]
    assert len({prints["2014"], prints["2016"], prints["2017"]}) == 3
    other = panel(spark, {"2014": [("A, X", {"O": 2.0, COL: 1.0}), ("B, X", {"O": 3.0, COL: 0.0})]})
    assert one(fingerprints.panel_fingerprints(other)).fingerprint != prints["2014"]
    reordered = panel(spark, {"2014": [("A, X", {"O": 2.0, COL: 1.0}), ("B, X", {"O": 3.0, COL: None})]})
    assert one(fingerprints.panel_fingerprints(reordered)).fingerprint == prints["2014"]


def test_drift_causes(spark):
    same, other = [("A, X", {COL: 1.0})], [("A, X", {COL: 2.0})]

    def cause(tables, frm, to):
        return one(fingerprints.drift_cause(fingerprints.panel_fingerprints(panel(spark, tables)), frm, to))

    ignored = cause({"2014": same, "2019": same, "2020": same}, "2020", "2019")
    assert (ignored.drift, ignored.probe_snapshot) == ("snapshot_parameter_ignored", "2014")
    published = cause({"2014": other, "2019": same, "2020": same}, "2019", "2020")
    assert published.drift == "same_published_table" and published.probe_rows == 1
    unknown = cause({"2019": same, "current": same}, "2019", "current")
    assert unknown.drift == "identical_tables_cause_unknown" and unknown.probe_snapshot is None
    healthy = cause({"2014": same, "2019": other, "2020": same}, "2019", "2020")
    assert healthy.drift is None and healthy.identical_tables is False and healthy.probe_snapshot is None


def test_only_published_ids_are_probed(spark):
    same, other = [("A, X", {COL: 1.0})], [("A, X", {COL: 2.0})]
    tables = panel(spark, {"1900": other, "2014": same, "2019": same, "2020": same})
    prints = fingerprints.panel_fingerprints(tables)
    got = one(fingerprints.drift_cause(prints, "2019", "2020", ["2020", "2019", "2014"]))
    assert (got.drift, got.probe_snapshot) == ("snapshot_parameter_ignored", "2014")
    assert fingerprints.probe_of(["2020", "2019-mid", "2019"], "2020", "2019") == "2019-mid"
    heads = dict.fromkeys(["2014", "2019", "2020"], [COL])
    cause = movers_plan.compare_snapshots(tables, list(heads), heads, frm="2019", to="2020").cause
    assert one(cause).probe_snapshot == "2014"


def test_digest_needs_positions(spark):
    placeless = panel(spark, {"2014": [("A, X", {COL: 1.0})]}).withColumn("row_no", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="position of every row"):
        fingerprints.panel_fingerprints(placeless).collect()


@pytest.mark.parametrize("copies,alarm", [(3, True), (2, False)])
def test_repeat_alarm_needs_three(spark, copies, alarm):
    rows = [("crime", "x")] * copies + [("crime", ""), ("crime", ""), ("crime", ""), ("crime", "y")]
    prints = spark.createDataFrame(rows, "vertical string, fingerprint string")
    got = one(fingerprints.distinct_tables(prints, ["vertical"]))
    assert (got.of, got.distinct_tables, got.max_repeat, got.unfingerprintable, got.repeated) == (
        copies + 4, 2, copies, 3, alarm
    )


def test_moved_is_sticky(spark):
    rows = [("2014", "a", False), ("2014", "b", False), ("2015", "a", True), ("2015", "a", False), ("2016", "a", False)]
    seen = spark.createDataFrame(rows, "snapshot string, fingerprint string, moved boolean")
    got = {r.snapshot: r.moved for r in fingerprints.moved_snapshots(seen, ["snapshot"]).collect()}
    assert got == {"2014": True, "2015": True, "2016": False}


def test_verdicts(spark):
    same, other = [("A, X", {COL: 1.0})], [("A, X", {COL: 2.0})]
    tables = panel(spark, {"2014": other, "2019": same, "2020": same})
    heads = dict.fromkeys(["2014", "2019", "2020"], [COL])
    twice = movers_plan.compare_snapshots(tables, list(heads), heads, frm="2019", to="2020")
    graded = one(twice.verdict())
    assert graded.reasons == ["same_published_table"] and graded.exit == 2
    clean = one(movers_plan.compare_snapshots(tables, list(heads), heads, frm="2014", to="2020").verdict())
    assert clean.reasons == [] and clean.exit == 0 and clean.warnings == []
    lone = panel(spark, {"2014": [("A, X", {COL: None})], "2019": [("A, X", {COL: 1.0})]})
    none = one(movers_plan.compare_snapshots(lone, ["2014", "2019"], heads, frm="2014", to="2019").verdict())
    assert none.reasons == ["nothing_was_compared"] and none.exit == 1


# ------------------------------------------------------------------- ids and headers


def test_snapshot_arguments():
    published = ["2019", "2014", "2019-mid"]
    ok = headers.resolve_snapshots(published, " 2014 ", None)
    assert (ok["from"], ok["to"], ok["oldest"], ok["newest"]) == ("2014", "current", "2014", "2019-mid")
    for args, reason in [
        (([], "2014"), "no_snapshots"), ((published, ""), "no_base"), ((published, "2109"), "unknown_snapshot"),
        ((published, "2014", "1999"), "unknown_snapshot"), ((published, "2014", "2014"), "same_slice"),
        ((published, None, "current"), "same_slice"),
    ]:
        with pytest.raises(headers.Refused) as refused:
            headers.resolve_snapshots(*args)
        assert refused.value.reason == reason


def test_column_resolution():
    old, new = ["Rent Index", "Cost Index", "Old"], ["Cost Index", "Cost Index Plus", "Rent Index", "New", "Rental"]
    assert headers.resolve_column(old, new) == "Cost Index"
    assert headers.resolve_column(old, new, " rent   INDEX ") == "Rent Index"
    assert headers.resolve_column(old, new, "cost index") == "Cost Index"
    for args, reason in [
        ((["A"], ["B"]), "no_shared_column"), ((old, new, "cost"), "ambiguous_column"),
        ((old, new, "old"), "column_only_in_from"), ((old, new, "new"), "column_only_in_to"),
        ((old, new, "zzz"), "unknown_column"), ((["Rent A"], ["Rent B"], "rent"), "different_columns"),
    ]:
        with pytest.raises(headers.Refused) as refused:
            headers.resolve_column(*args)
        assert refused.value.reason == reason


def test_scope():
    assert headers.scope(None, ["b", "a"]) == ["a", "b"]
    assert headers.scope(["b", "a", "b"], ["a", "b"]) == ["b", "a"]
    with pytest.raises(headers.Refused):
        headers.scope(["c"], ["a"])


def test_header_positions(spark):
    df = spark.createDataFrame([(["Rank", "City", "Cost of City"],), (["", "Top Country"],), (["X"],)], "h array<string>")
    assert column(df.select(headers.header_index_expr(F.col("h"), "City", "Country").alias("i")), "i") == [1, 1, None]


# ---------------------------------------------------------------------------- places


@pytest.fixture(scope="module")
def cities(spark):
    labels = ["Vancouver, WA, United States", "Vancouver, Canada", "Penang, Malaysia", "New York, NY, United States", "York, UK"]
    return panel(spark, {"2026": [(x, {COL: float(i)}) for i, x in enumerate(labels)]})


@pytest.mark.parametrize("needle,found", [
    ("vancouver canada", ["Vancouver, Canada"]), ("York", ["York, UK"]), ("nang", ["Penang, Malaysia"]), ("", []),
    ("Vancouver", ["Vancouver, WA, United States", "Vancouver, Canada"]), ("--", []), ("nowhere", []),
])
def test_place_tiers(cities, needle, found):
    assert sorted(column(places.find_place(cities, needle), "place")) == sorted(found)
    answer = one(places.resolve_place(cities, needle))
    assert answer.candidates == len(found)
    assert answer.place == (found[0] if len(found) == 1 else None)


def test_rank(spark):
    rows = [("A, X", {COL: 3.0, "Safety Index": 1.0}), ("B, X", {COL: None, "Safety Index": 9.0}),
            ("C, Y", {COL: 1.0, "Safety Index": None}), ("D, Y", {COL: 3.0, "Safety Index": 9.0})]
    table = panel(spark, {"2026": rows})
    names = lambda r: [x.place[0] for x in r.rows.collect()]
    columns = [COL, "Safety Index", "Third", "Fourth"]
    assert names(rank(table, columns, sort="crime")) == ["C", "A", "D", "B"]
    assert names(rank(table, columns, sort="safety")) == ["B", "D", "A", "C"]
    assert names(rank(table, columns, top=2)) == ["A", "B"]
    assert names(rank(table, columns, match=", y")) == ["C", "D"]
    missed = rank(table, columns, sort="zzz", top=0)
    assert missed.sorted_by is None and "zzz" in missed.note and names(missed) == ["A", "B", "C", "D"]
    assert missed.shown == columns[:3] and rank(table, columns, full=True).shown == columns
    assert missed.flat().columns == ["rank", "place", "city", "country", *columns]


def test_slices(spark):
    table = panel(spark, {"2019": [("A, X", {COL: 1.0})], "current": [("B, X", {COL: 1.0})]})
    assert column(panels.select_slice(table, "crime"), "place") == ["B, X"]
    assert column(panels.select_slice(table, "crime", snapshot="2019"), "place") == ["A, X"]
    assert panels.select_slice(table, "crime", by="country").count() == 0
    assert panels.select_slice(table, "crime", region="Europe").count() == 0
    with pytest.raises(ValueError):
        panels.select_slice(table, "weather")


# ----------------------------------------------------------------------------- trend


def test_trend_is_anchored_to_one_label(spark):
    tables = panel(spark, {
        "2026": [("Vancouver, WA, United States", {COL: 1.0}), ("Vancouver, Canada", {COL: 2.0})],
        "2025": [("Oslo, Norway", {COL: 5.0})],
        "2024": [("Oslo, Norway", {COL: 5.0}), ("Vancouver, Canada", {COL: 3.0})],
        "2023": [("Vancouver, WA, United States", {COL: 9.0})],
        "2022": [("Vancouver, Canada", {COL: 4.0}), ("Vancouver, WA, United States", {COL: 8.0})],
    })
    found = trend(tables, "Vancouver", ["2026", "2025", "2024", "2023", "2022", "2021"], unreadable={"2021": "broken"})
    series = {r.snapshot: r for r in found.series.collect()}
    assert series["2026"].note == "ambiguous: 2 places match" and not series["2026"].found
    assert series["2025"].note == "not ranked in this snapshot"
    assert (series["2024"].place, series["2024"].rank, series["2024"].of) == ("Vancouver, Canada", 2, 2)
    assert not series["2023"].found and series["2023"].metrics is None
    assert series["2022"].metrics == {COL: 4.0}
    assert series["2021"].error == "broken" and series["2021"].note is None
    summary = one(found.summary)
    assert (summary.anchor, summary.found_in, summary.requested) == ("Vancouver, Canada", 2, 6)
    assert sorted(column(found.ambiguous, "place")) == ["Vancouver, Canada", "Vancouver, WA, United States"]
    heads = spark.createDataFrame([("2026", [COL, "B"]), ("2022", ["B", COL])], "snapshot string, columns array<string>")
    assert one(trend(tables, "Vancouver", ["2026", "2022"], headers=heads).summary).column == "B"
    assert trend(tables, "Vancouver", ["2026", "2025", "2024"], limit=2).series.count() == 2
    with pytest.raises(ValueError):
        trend(tables, "Vancouver", [])


@pytest.mark.parametrize("snapshots,grown,flat", [(3, False, True), (2, False, False), (3, True, False)])
def test_repeated_series(spark, snapshots, grown, flat):
    base = [("A, X", {COL: 1.0, "O": None})]
    tables = {str(2020 + i): base for i in range(snapshots)}
    if grown:
        tables["2020"] = base + [("B, X", {COL: 2.0})]
    found = trend(panel(spark, tables), "A, X", list(tables))
    assert one(found.summary).identical_across_snapshots is flat
