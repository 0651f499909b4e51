"""Periodic runs and ranked search beside brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from panelspark.llm import periodic_runs, queries, ranked_search

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, runs string, score double, item long, owner int, copy string"


def frame(spark, rows):
    return spark.createDataFrame([(i, text, "x", 0.5, 1, 1, "y") for i, text in rows], COLUMNS)


def plain_runs(words):
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(6, 4 * q):
                part = words[start:start + length]
                if all(any(part[k] != part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.add((start, length, q))
            i += 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-math.inf if r[2] == 0 else -r[1] / r[2], r[0], r[2])) if runs else None
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + ln for s, ln, q in runs)]
    lines = "".join(f"{s},{ln},{q}\n" for s, ln, q in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def by_id(rows):
    return sorted(rows, key=lambda row: (row[0] is not None, *map(str, row)))


def test_runs_of_random_words():
    draw = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(0, 4)):
            kinds = draw.choice([1, 2, 3, 5])
            words = [b"%d" % draw.randrange(kinds) for _ in range(draw.choice([0, 1, 5, 6, 7, 20, 60, 150]))]
            texts.append(words * draw.choice([1, 1, 4]))
        assert periodic_runs.runs_of(texts) == [plain_runs(words) for words in texts]


def test_runs_of_a_long_text():
    assert periodic_runs.runs_of([[b"a"] * 60_000, [b"a", b"b", b"c"] * 20_000]) == [[(0, 60_000, 1)], [(0, 60_000, 3)]]


def test_digests(spark):
    rows = [(i, None) for i in (1, None)] + [(2, ""), (3, " \n\t"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "b " * 9),
            (5, "x y x y x y x y z q q q q q q q q"), (6, "é ü " * 5 + "end"), (7, "a b\x1cc " * 8)]
    rows += [(i, " ".join(str(random.Random(i).randrange(40)) for _ in range(i))) for i in range(8, 120)]
    got = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_repeated_tails(frame(spark, rows))))
    assert by_id(map(tuple, got.collect())) == by_id(plain_digest(*row) for row in rows)
    assert got.filter("n_runs > 0 and doc_id > 7").count() > 3
    assert periodic_runs.digests(periodic_runs.find_runs(frame(spark, []))).collect() == []


def test_query_beside_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic_runs(spark, SF).collect()
    assert by_id(map(tuple, got)) == by_id(plain_digest(*row) for row in docs)


def plain_search(docs, items, top=10):
    def split(text):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    terms = [(doc_id, Counter(split(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms)
    df = Counter(term for _, c in terms for term in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, counts in terms:
            score = 0
            for term, repeats in Counter(split(text)).items():
                if counts[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 100 - 75 + (75 * counts.total() * n_docs) // n_terms
                    score += repeats * w * ((1000000000 * counts[term]) // (1000 * counts[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else doc_id, -score)
                for rank, (score, none, doc_id) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 7)
    monkeypatch.setattr(ranked_search, "BUNDLE_ITEMS", 2)


def test_search(spark, small_steps):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "A1", "x_y", "b-c", "ZZ"]
    docs = [(i // 2 * 2, " ".join(draw.choices(words, range(len(words), 0, -1), k=draw.randrange(40)))) for i in range(80)]
    docs += [(None, None), (None, "w1 w2 w3"), (200, ""), (201, "..."), (202, "w1"), (202, "w1"), (203, "w1 " * 30_000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(12)))) for i in range(12)]
    items += [(None, "w1 w1 zz"), (50, None), (51, "nowhere"), (52, "w1"), (52, "w1")]
    benchmark = frame(spark, items).withColumnRenamed("doc_id", "item_id").withColumnRenamed("item", "doc_id")
    got = ranked_search.search(frame(spark, docs).repartition(3), benchmark, 10).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_search(docs, items)))


def test_search_without_documents_or_items(spark):
    one = frame(spark, [(1, "a b")])
    none = frame(spark, [])
    rename = lambda df: df.withColumnRenamed("doc_id", "item_id")
    assert ranked_search.search(none, rename(one), 10).collect() == []
    assert ranked_search.search(one, rename(none), 10).collect() == []
