import json
import os

import pytest
from helpers import column, one
from pyspark.sql import functions as F

from panelspark.operators import panels
from panelspark.sources import pages as src
from panelspark.sources import results, sinks
from panelspark.sources.corpus_store import backed_rows, scan_corpus
from panelspark.streaming import ingest

HEAD = "<tr><th>Rank</th><th>City</th><th>Cost<br>Index</th><th>Rent Index</th></tr>"


def page(body, table_id="t2", head=HEAD):
    return f'<p>hi</p><table id="{table_id}" class="stripe wide">{head}{body}</table>'


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def frame(spark, htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")


def test_ranking_page(spark):
    body = (
        row("", "Da Nang, Vietnam", "1,020.5", "?") + row("", "", "5", "6") + row("", "Oslo &amp; Bergen,\n Norway", "7")
        + row("x") + row("", "", "") + row("", "Rome, Italy", "-", "3")
    )
    rows = src.ranking_rows(src.triage(frame(spark, [page(body)])), ["page_id"]).orderBy("rank").collect()
    assert [(r.rank, r.row_no, r.place, r.country) for r in rows] == [
        (1, 1, "Da Nang, Vietnam", "Vietnam"), (3, 2, "Oslo & Bergen, Norway", "Norway"), (5, 3, "Rome, Italy", "Italy")
    ]
    assert rows[0].metrics == {"Cost Index": 1020.5, "Rent Index": None}
    assert rows[1].metrics == {"Cost Index": 7.0, "Rent Index": None}
    assert rows[0].columns == ["Cost Index", "Rent Index"]


def test_country_view_and_place_at_the_start(spark):
    heads = ["<tr><th>Rank</th><th>Country</th><th>A</th></tr>", "<tr><th>City</th><th>Rank</th><th>A</th></tr>"]
    pages = frame(spark, [page(row("", "Peru", "4"), head=heads[0]), page(row("Lima", "Peru", "4"), head=heads[1])])
    rows = src.ranking_rows(src.triage(pages), ["page_id"]).orderBy("page_id").collect()
    assert [(r.place, r.country, r.metrics) for r in rows] == [("Peru", "", {"A": 4.0}), ("Peru", "", {"A": 4.0})]


def test_ranking_triage(spark):
    pages = frame(spark, [
        page(row("", "A", "1")), "Cannot find it", "<p>No  DATA</p>", page("", table_id="t3"), page("", head=""),
        "<script>no data</script>", None,
    ])
    got = column(src.triage(pages).orderBy("page_id"), "page_status")
    assert got == [
        "ok", "no_such_selection", "no_such_selection", "layout_changed", "layout_changed", "layout_changed", "layout_changed"
    ]


def test_price_pages(spark):
    table = "<table class='x data_wide_table'><tr><td>one</td></tr>" + row("Cinema\n Ticket", "$ 5") + "</table>"
    pages = frame(spark, [
        f'<a href="?country=Viet+Nam">v</a>{table}', "Cannot find city id", "We don't have enough", "<table></table>",
    ]).withColumnRenamed("page_id", "entity").withColumn("entity", F.col("entity").cast("string"))
    triaged = src.triage(pages, kind="price")
    got = one(src.item_rows(triaged))
    assert (got.entity, got.country, got.pos, got.label, got.value_text) == ("0", "Viet Nam", 1, "Cinema Ticket", "$ 5")
    errors = {r.entity: r.kind for r in src.error_records(triaged).collect()}
    assert errors == {"1": "unknown_entity", "2": "thin_data", "3": "layout_changed"}
    assert tuple(one(src.run_failed(triaged))) == (4, 3, False)
    assert one(src.run_failed(triaged.filter("entity <> '0'"))).run_failed is True


def test_nested_unclosed_and_empty_tables(spark):
    html = (
        "<table id='out'><tr><td>a<table id='in'><tr><th>H</th></tr><tr><td>x</td><td></td></tr></table></td><td>b</td></tr>"
        "<tr><td> </td></tr><tr><td>c<br/>d<br>e</td></tr></table><table id='open'><tr><td>lost</td></tr>"
    )
    got = src.html_tables(frame(spark, [html, "", None])).orderBy("page_id", "table_no").collect()
    assert [(r.id, r.header, r.rows) for r in got] == [("in", ["H"], [["x", ""]]), ("out", [], [["c d e"]])]


def test_visible_text(spark):
    html = "<style>p{}</style><p>Hello <b>big</b>\n&amp; small</p><script>var x='no';</script> end"
    assert one(src.visible_text(frame(spark, [html]))).text == "Hello big & small end"


def test_snapshot_options(spark):
    html = '<option value="USD">x</option><option selected value="2026-mid">m</option><option value="2014" >y</option>'
    got = src.snapshot_options(frame(spark, [html]), ["page_id"]).collect()
    assert [(r.pos, r.snapshot) for r in got] == [(0, "2026-mid"), (1, "2014")]


def test_decoding(spark):
    rows = [
        (0, bytearray("﻿é".encode()), None), (1, bytearray("é€".encode("cp1252")), "text/html; charset=windows-1252"),
        (2, bytearray(b"\xff\xe9"), "text/html; charset=nonsense"), (3, bytearray("plain".encode()), "x; CHARSET=latin-1"),
        (4, bytearray(b"\xe9"), "text/html"),
    ]
    df = spark.createDataFrame(rows, "i int, content binary, ct string")
    assert column(src.decode_pages(df, F.col("ct")).orderBy("i"), "html") == ["é", "é€", "��", "plain", "�"]


def test_result_sets(spark):
    city = {"slug": "a", "name": "A", "country": "X", "region": "R", "overall_score": 1.5, "cost_usd": 9.0}
    good = json.dumps({"total_matching": 137, "returned": 1, "cities": [city]})
    wrap = lambda text, **kw: json.dumps({"content": [{"type": "image"}, {"type": "text", "text": text}], **kw})
    answers = [wrap(good), wrap("sorry"), wrap(good, isError=True), wrap(""), json.dumps({"content": []}), json.dumps({"content": [{"text": good}]})]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    parsed = results.parse_envelopes(results.unwrap_answers(df)).orderBy("i").collect()
    assert [r.refused for r in parsed] == [None, None, "reported_error", "no_content", "no_content", None]
    assert parsed[1].plain_text == "sorry" and parsed[0].plain_text is None
    rows = results.city_rows(results.parse_envelopes(results.unwrap_answers(df)).filter("refused IS NULL"), ["i"]).collect()
    assert [(r.i, r.total_matching, r.returned, r.slug, r.cost_usd) for r in rows] == [(0, 137, 1, "a", 9.0), (5, 137, 1, "a", 9.0)]


def test_sinks_keep_unknowns(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.0), ("b", "x", None)], "k string, t string, v double")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["k", "v", "extra"])
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.splitlines() == ["k,v,extra", "a,1.0,", "b,,"]
    sinks.write_json(df.coalesce(1), str(tmp_path / "json"))
    lines = "".join(p.read_text() for p in (tmp_path / "json").glob("*.json")).splitlines()
    assert [json.loads(x) for x in lines] == [{"k": "a", "t": None, "v": 1.0}, {"k": "b", "t": "x", "v": None}]


# ----------------------------------------------------------------------------- ingest


def _pages(spark, rows):
    """``(vertical, snapshot, item_no, html)``, or with view and region behind the vertical."""
    return spark.createDataFrame([row if len(row) == 6 else (row[0], "city", "", *row[1:]) for row in rows], ingest.PAGE_SCHEMA)


def _paths(tmp_path):
    return {"panel_path": str(tmp_path / "panel"), "corpus_path": str(tmp_path / "corpus"), "schema_tag": "t",
            "now": F.lit("2026-08-25 00:00:00").cast("timestamp")}


def test_batch_outcomes(spark, tmp_path):
    good = page(row("", "A, X", "1", "2"))
    report = one(ingest.ingest_batch(_pages(spark, [
        ("crime", "2014", 1, good), ("crime", "2015", 2, "Cannot find"), ("crime", "2016", 3, None),
        ("crime", "2017", 4, "<p>new look</p>"), ("crime", "2018", 5, good),
    ]), **_paths(tmp_path)))
    assert (report.planned, report.ok, report.empty, report.failed, report.unresolved, report.attempted) == (5, 2, 1, 1, 1, 5)
    assert report.attempted == report.ok + report.empty + report.failed + report.unresolved
    assert (report.complete, report.exit) == (False, 2)
    assert report.aborted and report.aborted_at.snapshot == "2017" and report.stored == 2
    stored = scan_corpus(spark, str(tmp_path / "corpus")).orderBy("snapshot").collect()
    assert [(r.snapshot, r.keep, r.moved, r.n_rows) for r in stored] == [("2014", True, False, 1), ("2018", True, False, 1)]
    assert stored[0].bytes > 0 and stored[0].columns == ["Cost Index", "Rent Index"]
    row_ = panels.read_panel(spark, str(tmp_path / "panel")).filter("snapshot = '2014'").first()
    assert (row_.place_key, row_.metrics) == ("ax", {"Cost Index": 1.0, "Rent Index": 2.0})


def test_changed_snapshot_stays_moved(spark, tmp_path):
    first, second = page(row("", "A, X", "1", "2")), page(row("", "A, X", "9", "2"))
    seen = []
    for html in (first, first, second, second, first):
        ingest.ingest_batch(_pages(spark, [("crime", "2014", 1, html), ("crime", "2015", 2, first)]), **_paths(tmp_path))
        stored = {r.snapshot: (r.moved, r.keep) for r in scan_corpus(spark, str(tmp_path / "corpus")).collect()}
        assert stored["2015"] == (False, True)
        seen.append(stored["2014"])
    assert seen == [(False, True), (False, True), (True, False), (True, False), (True, False)]
    assert panels.read_panel(spark, str(tmp_path / "panel")).count() == 2


def test_one_table_under_three_ids_raises_the_alarm_until_it_is_repaired(spark, tmp_path):
    a, b = page(row("", "A, X", "1", "2")), page(row("", "B, X", "1", "2"))
    run = lambda rows: one(ingest.ingest_batch(_pages(spark, rows), **_paths(tmp_path)))
    first = run([("crime", "2014", 1, a), ("crime", "2015", 2, a)])
    assert (first.repeated_verticals, first.exit) == (0, 0)
    third = run([("crime", "2016", 3, a)])
    assert (third.repeated_verticals, third.complete, third.exit) == (1, False, 1)
    other = run([("traffic", "2016", 4, a)])
    assert (other.repeated_verticals, other.exit) == (1, 1)
    repaired = run([("crime", "2016", 5, b)])
    assert (repaired.repeated_verticals, repaired.complete, repaired.exit) == (0, True, 0)


def test_emptied_page_is_left_out_when_read_through_the_corpus(spark, tmp_path):
    a = page(row("", "A, X", "1", "2"))
    for html in (a, page("")):
        ingest.ingest_batch(_pages(spark, [("crime", "2014", 1, html), ("crime", "2015", 2, a)]), **_paths(tmp_path))
    corpus = scan_corpus(spark, str(tmp_path / "corpus"))
    assert {r.snapshot: (r.n_rows, r.moved) for r in corpus.collect()} == {"2014": (0, True), "2015": (1, False)}
    rows = backed_rows(panels.read_panel(spark, str(tmp_path / "panel")), corpus)
    assert column(rows, "snapshot") == ["2015"]


def test_versions_of_one_snapshot_in_one_batch(spark, tmp_path):
    a, b, blank = page(row("", "A, X", "1", "2")), page(row("", "B, X", "3", "4")), page("")
    report = one(ingest.ingest_batch(_pages(spark, [
        ("crime", "2014", 1, a), ("crime", "2014", 2, b), ("crime", "2015", 3, a), ("crime", "2015", 4, a),
        ("crime", "2016", 5, blank), ("crime", "2016", 6, a), ("crime", "2017", 7, a), ("crime", "2017", 8, blank),
    ]), **_paths(tmp_path)))
    assert (report.ok, report.stored, report.complete, report.exit) == (8, 8, True, 0)
    moved = {r.snapshot: (r.moved, r.n_rows) for r in scan_corpus(spark, str(tmp_path / "corpus")).collect()}
    assert moved == {"2014": (True, 1), "2015": (False, 1), "2016": (False, 1), "2017": (True, 0)}
    stored = panels.read_panel(spark, str(tmp_path / "panel"))
    assert sorted((r.snapshot, r.place) for r in stored.collect()) == [("2014", "B, X"), ("2015", "A, X"), ("2016", "A, X")]


def test_corpus_has_one_file_a_family_and_all_four_parts(spark, tmp_path):
    good = page(row("", "A, X", "1", "2"))
    rows = [(family, *view, str(2014 + n), 10 * i + n, good) for i, (family, view) in enumerate(
        [("crime", ("city", "")), ("crime", ("country", "")), ("crime", ("region", "150")), ("traffic", ("city", ""))]) for n in range(3)]
    for part in (rows[:5], rows[5:], rows[:2]):
        ingest.ingest_batch(_pages(spark, part), **_paths(tmp_path))
    corpus = scan_corpus(spark, str(tmp_path / "corpus"))
    assert corpus.select("vertical", "view", "region", "snapshot").distinct().count() == corpus.count() == 12
    files = [f for _, _, names in os.walk(tmp_path / "corpus") for f in names if f.endswith(".parquet")]
    assert len(files) == 2
    stored = panels.read_panel(spark, str(tmp_path / "panel"))
    assert panels.select_slice(stored, "crime", region="Europe", snapshot="2015").count() == 1
    assert panels.select_slice(stored, "crime", by="country", snapshot="2015").count() == 1


def test_expired_entries_leave_the_store(spark, tmp_path):
    from panelspark.operators.corpus import expired
    from panelspark.sources.corpus_store import remove_entries, write_entries

    good = page(row("", "A, X", "1", "2"))
    ingest.ingest_batch(_pages(spark, [("crime", "2014", 1, good), ("crime", "2026", 2, good), ("traffic", "2026", 3, good)]), **_paths(tmp_path))
    path = str(tmp_path / "corpus")
    old = F.lit("2026-01-01 00:00:00").cast("timestamp")
    write_entries(scan_corpus(spark, path).drop("file_mtime").withColumn("written_at", old), path)
    remove_entries(spark, path, expired(F.lit("2026-08-25 00:00:00").cast("timestamp")))
    assert [(r.vertical, r.snapshot) for r in scan_corpus(spark, path).collect()] == [("crime", "2014")]  # archived
    remove_entries(spark, path, F.lit(True))
    assert [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")] == []


@pytest.fixture
def stream(spark, tmp_path):
    """Adds pages to the source, runs the stream once and says whether it was stopped."""
    source = str(tmp_path / "in")
    options = {**_paths(tmp_path), "report_path": str(tmp_path / "reports"), "checkpoint": str(tmp_path / "cp")}

    def run(*rows, **more):
        if rows:
            _pages(spark, rows).coalesce(1).write.mode("append").parquet(source)
        try:
            return ingest.ingest_stream(spark, source, **options, **more).first()
        except ingest.IngestStopped as stopped:
            return stopped

    return run


def _state(spark, tmp_path):
    return {r.snapshot: (r.outcome, r.tries) for r in ingest.slice_state(spark, str(tmp_path / "cp")).collect()}


def test_stream_resumes_and_keeps_what_moved(spark, tmp_path, stream):
    a, b = page(row("", "A, X", "1", "2")), page(row("", "B, X", "1", "2"))
    assert stream(("crime", "2014", 1, a), ("crime", "2015", 2, b), max_files=1).ok == 2
    assert stream(("crime", "2014", 3, b), ("traffic", "2014", 4, a)).complete
    assert stream(("crime", "2014", 5, b)).ok == 1
    corpus = {(r.vertical, r.snapshot): r.moved for r in scan_corpus(spark, str(tmp_path / "corpus")).collect()}
    assert corpus == {("crime", "2014"): True, ("crime", "2015"): False, ("traffic", "2014"): False}
    places = {(r.vertical, r.snapshot): r.place for r in panels.read_panel(spark, str(tmp_path / "panel")).collect()}
    assert places["crime", "2014"] == "B, X" and places["traffic", "2014"] == "A, X"
    assert len([d for d in os.listdir(tmp_path / "reports") if d.startswith("run=")]) == 3


def test_broken_page_stands_in_the_way_of_its_own_slice_alone(spark, tmp_path, stream):
    good, broken = lambda n: page(row("", f"A{n}, X", "1", "2")), "<p>new look</p>"
    stopped = stream(("crime", "2019", 1, good(1)), ("crime", "2020", 2, broken), ("crime", "2021", 3, good(3)), ("crime", "2022", 4, None))
    assert isinstance(stopped, ingest.IngestStopped) and "2020" in str(stopped)
    assert _state(spark, tmp_path) == {"2019": ("ok", 0), "2020": ("unresolved", 1), "2021": ("ok", 0), "2022": ("failed", 1)}
    assert isinstance(stream(), ingest.IngestStopped)  # without new files the page is tried again
    assert _state(spark, tmp_path)["2020"] == ("unresolved", 2)
    report = stream(("crime", "2020", 6, good(6)), ("crime", "2022", 7, good(7)))  # the old page and its better one come together
    assert (report.planned, report.ok, report.complete, report.exit) == (2, 2, True, 0)
    assert _state(spark, tmp_path) == {s: ("ok", 0) for s in ("2019", "2020", "2021", "2022")}
    assert stream().planned == 0
    assert sorted(column(scan_corpus(spark, str(tmp_path / "corpus")), "snapshot")) == ["2019", "2020", "2021", "2022"]


def test_equal_header_labels_keep_the_last_column(spark):
    html = page(row("", "A, X", "1", "2")).replace("Rent Index", "Cost Index")
    rows = src.ranking_rows(src.triage(spark.createDataFrame([(1, html)], "page_id int, html string")), ["page_id"])
    assert one(rows).metrics == {"Cost Index": 2.0} and one(rows)["columns"] == ["Cost Index"]


def test_a_failed_read_is_no_layout_change(spark):
    pages = spark.createDataFrame([("a", None), ("b", "<p>new</p>")], "entity string, html string")
    found = {r.entity: r.kind for r in src.error_records(src.triage(pages, kind="price")).collect()}
    assert found == {"a": "source_unavailable", "b": "layout_changed"}


def test_panel_store_replaces_one_slice(spark, tmp_path):
    from helpers import panel

    path = str(tmp_path / "p")
    panels.write_panel(panel(spark, {"2014": [("A, X", {"m": 1.0})], "2015": [("B, X", {"m": None})]}), path)
    panels.write_panel(panel(spark, {"2014": [("C, X", {"m": 2.0}), ("D, X", {"m": 3.0})]}), path)
    stored = panels.read_panel(spark, path)
    assert sorted((r.snapshot, r.place) for r in stored.collect()) == [("2014", "C, X"), ("2014", "D, X"), ("2015", "B, X")]
    plan = panels.select_slice(stored, "crime", snapshot="2014")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "snapshot" in plan.split("PartitionFilters")[1].split("]")[0]


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    from panelspark.session import shared_dir

    assert shared_dir(spark)
    with pytest.raises(ValueError):
        panels.select_slice(spark.range(1), "crime", by="planet")
