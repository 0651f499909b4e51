import datetime as dt
import random
import re
import sys
import unicodedata

import pytest
from helpers import column, one
from pyspark.sql import functions as F

from panelspark.functions import numbers as num
from panelspark.functions import snapshots as snap
from panelspark.functions import text


def apply(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return column(df.select("i", fn(F.col("v")).alias("out")).orderBy("i"), "out")


def python_norm(label):
    kept = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]", "", kept.lower())


def test_norm_label_agrees_with_unicode_on_every_code_point(spark):
    labels = []
    for start in range(0, sys.maxunicode + 1, 512):
        points = [p for p in range(start, start + 512) if not 0xD800 <= p <= 0xDFFF]
        if points:
            labels.append("a".join(map(chr, points)))
    assert apply(spark, labels, text.norm_label) == [python_norm(x) for x in labels]


@pytest.mark.parametrize("a,b,same", [
    ("São Paulo, Brazil", "Sao Paulo, Brazil", True),
    ("St. Petersburg, Russia", "St Petersburg, Russia", True),
    ("Vancouver, WA, United States", "Vancouver, Canada", False),
    ("Kiev, Ukraine", "Kyiv, Ukraine", False),
])
def test_join_keys(spark, a, b, same):
    left, right = apply(spark, [a, b], text.join_key)
    assert (left == right) is same


def test_label_without_latin_letters_has_no_key(spark):
    assert apply(spark, ["東京", "--", "", None, "ﬁ①½"], text.join_key) == ["", "", "", "", "fi112"]


def test_squash_matches_python(spark):
    cells = ["  a \n b ", "a  b", "\x1ca\x1fb\x85", "", "a​b"]
    assert apply(spark, cells, text.squash) == [re.sub(r"\s+", " ", c).strip() for c in cells]


def test_split_place(spark):
    cases = {
        "Da Nang, Vietnam": ("Da Nang", "", "Vietnam"),
        "Honolulu, HI, United States": ("Honolulu", "HI", "United States"),
        "Hong Kong, Hong Kong (China)": ("Hong Kong", "", "Hong Kong (China)"),
        "A, B, C, D": ("A", "B, C", "D"),
        "Monaco": ("Monaco", "", ""),
        " , ,": ("", "", ""),
        "X,, Y ,": ("X", "", "Y"),
    }
    got = apply(spark, list(cases), text.split_place)
    assert [(r.city, r.subdivision, r.country) for r in got] == list(cases.values())
    assert got[-1].place == "X, Y" and got[5].place == ", ,"


def test_slug_guess(spark):
    rows = [
        ("Ho Chi Minh City", "x", "y", "Ho-Chi-Minh-City"), ("Xi'an", None, None, "Xian"),
        ("", "da-nang-vietnam", "Vietnam", "Da-Nang"), (None, "san-jose-costa-rica", "Costa Rica", "San-Jose"),
        ("", "lima", "", "Lima"), ("", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "name string, slug string, country string, want string")
    out = df.select(text.slug_guess(F.col("name"), F.col("slug"), F.col("country")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_country_of_link(spark):
    pages = ['<a href="?country=Viet+Nam&x">', "country=C%C3%B4te", "none", 'country=Peru"']
    assert apply(spark, pages, text.country_of_link) == ["Viet Nam", "C%C", "", "Peru"]


def test_strict_numbers(spark):
    cells = ["12", "1,234.5", "-3.0", "5.", "?", "-", "--", "N/A", "n/a", "", None, "12a", "1.2.3", " 7 ", ",", "１２"]
    want = [12.0, 1234.5, -3.0, 5.0, None, None, None, None, None, None, None, None, None, 7.0, None, 12.0]
    assert apply(spark, cells, num.to_number) == want


def test_loose_prices(spark):
    cells = ["$1,234.50", "≈45.00 €", "-7", "?", "", None, "from 3 to 5", ", 5"]
    assert apply(spark, cells, num.parse_value) == [1234.5, 45.0, 7.0, None, None, None, 3.0, None]


def test_changes(spark):
    rows = [(None, None), (None, 1.0), (1.0, None), (2.0, 3.0), (0.0, 3.0), (-1.0, 3.0), (1e308, -1e308), (4.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double").select(
        num.abs_change(F.col("a"), F.col("b")).alias("d"), num.pct_change(F.col("a"), F.col("b")).alias("p")
    )
    got = [(r.d.delta, r.d.reason, r.p.pct, r.p.reason) for r in df.collect()]
    both, frm, to = "metric_absent_in_both", "metric_absent_in_from", "metric_absent_in_to"
    assert got == [
        (None, both, None, both), (None, frm, None, frm), (None, to, None, to), (1.0, None, 50.0, None),
        (3.0, None, None, "base_not_positive"), (4.0, None, None, "base_not_positive"),
        (None, "not_finite", None, "not_finite"), (0.0, None, 0.0, None),
    ]


def test_budget_is_strict_and_zero_is_a_value(spark):
    full = {"rent_1br_outside": 300.0, "utilities": 40.0, "internet": 10.0, "mobile": 5.0, "transport_pass": 15.0, "cheap_meal": 3.0}
    free = {**full, "utilities": 0.0}
    short = {k: v for k, v in full.items() if k != "mobile"}
    blank = {**full, "internet": None}
    df = spark.createDataFrame([(0, full), (1, free), (2, short), (3, blank)], "i int, v map<string,double>")
    out = df.select(
        num.monthly_budget(F.col("v")).alias("total"), num.basket_missing(F.col("v")).alias("missing"),
        F.size(num.basket_parts(F.col("v"))).alias("parts"),
    ).collect()
    assert [(r.total, r.missing, r.parts) for r in out] == [
        (460.0, [], 6), (420.0, [], 6), (None, ["mobile"], 5), (None, ["internet"], 5)
    ]


def test_shares_and_ratios(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (None, 2.0), (3.0, 4.0)], "a double, b double")
    assert column(df.select(num.control_ratio(F.col("a"), F.col("b")).alias("r")), "r") == [None, None, None, 0.75]
    assert column(df.select(num.share(F.col("a"), F.col("b")).alias("r")), "r") == [None, None, None, 0.75]


def test_snapshot_ids_and_order(spark):
    ids = ["2019", "2019-mid", "current", "201", "2019-MID", "2019-mid\n", None, "2009"]
    assert apply(spark, ids, snap.is_snapshot_id) == [True, True, False, False, False, False, False, True]
    keys = apply(spark, ids, snap.sort_key)
    assert [tuple(k) for k in keys] == [(2019, 0), (2019, 1), (-1, 0), (-1, 0), (-1, 0), (-1, 0), (-1, 0), (2009, 0)]
    assert [snap.sort_key_of(i) for i in ids[:3]] == [(2019, 0), (2019, 1), (-1, 0)]


@pytest.mark.parametrize("snapshot,now,moved,want", [
    ("2024", "2025-06-30 00:00:00", False, True), ("2024", "2025-06-29 23:59:59", False, False),
    ("2024-mid", "2026-08-25 00:00:00", False, True), ("2026-mid", "2026-08-25 00:00:00", False, False),
    ("2009", "2026-08-25 00:00:00", False, True), ("2008", "2026-08-25 00:00:00", False, False),
    ("2019", "2026-08-25 00:00:00", True, False), ("current", "2026-08-25 00:00:00", False, False),
    (None, "2026-08-25 00:00:00", False, False),
])
def test_archival(spark, snapshot, now, moved, want):
    df = spark.createDataFrame([(snapshot, dt.datetime.fromisoformat(now), moved)], "s string, now timestamp, m boolean")
    assert one(df.select(snap.is_archival(F.col("s"), F.col("now"), F.col("m")).alias("x"))).x is want


def test_schema_tag_follows_labels(spark):
    from panelspark.functions.digests import schema_tag

    tags = spark.range(1).select(
        schema_tag().alias("a"), schema_tag().alias("b"), schema_tag([("Taxi 1km", "taxi_km")]).alias("c"),
        schema_tag(factors={"taxi_km": 0.5}).alias("d"),
    ).collect()[0]
    assert tags.a == tags.b and len({tags.a, tags.c, tags.d}) == 3


def test_random_labels_split_like_python(spark):
    rng = random.Random(3)
    labels = ["".join(rng.choice("ab ,, é.") for _ in range(rng.randint(0, 14))) for _ in range(200)]
    got = apply(spark, labels, text.split_place)
    for label, r in zip(labels, got):
        parts = [p for p in (q.strip() for q in re.sub(r"\s+", " ", label).strip().split(",")) if p]
        assert r.city == (parts[0] if parts else "")
        assert r.country == (parts[-1] if len(parts) > 1 else "")
