"""The back-off model beside plain Python over whole token lists, its sums, and odd input."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from panelspark.llm import katz

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, block long, part int, score double, held_out string"


def frame(spark, rows):
    return spark.createDataFrame([(i, text, 1, 2, 0.5, "x") for i, text in rows], COLUMNS)


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), None]


def plain_discounts(counts):
    n = Counter(counts.values())
    half = {r: (r - 0.5) / r for r in range(1, 6)}
    if not all(n[r] for r in range(1, 7)):
        return half
    last = 6 * n[6] / n[1]
    if last >= 1:
        return half
    got = {r: ((r + 1) * n[r + 1] / n[r] / r - last) / (1 - last) for r in range(1, 6)}
    return got if all(0 < d < 1 for d in got.values()) else half


class Plain:
    """Katz back-off of any order, written down from its definition."""

    def __init__(self, texts, order):
        self.counts = [None, *(Counter() for _ in range(order))]
        for tokens in texts:
            for i, token in enumerate(tokens):
                for k in range(1, order + 1):
                    self.counts[k][self.history(tokens, i, k), token] += 1
        self.discount = [None, *(plain_discounts(counts) for counts in self.counts[1:])]
        self.seen = [None]
        for counts in self.counts[1:]:
            by = defaultdict(dict)
            for (history, token), n in counts.items():
                by[history][token] = n
            self.seen.append(by)
        self.left = {}

    @staticmethod
    def history(tokens, i, k):
        return (("<begin>",) + tuple(tokens[:i]))[-(k - 1):] if k > 1 else ()

    def p(self, history, token, k):
        if k == 0:
            return 1.0  # the one unknown word takes all that is left
        seen = self.seen[k].get(history if k > 1 else ())
        shorter = history[1:] if len(history) == k - 1 else history
        if k > 1 and not seen:
            return self.p(shorter, token, k - 1)
        seen = seen or {}
        total = sum(seen.values())
        free = sum((1 - self.discount[k].get(n, 1)) * n for n in seen.values())
        if not free:
            total, free = total + 1, 1
        if token in seen:
            return self.discount[k].get(seen[token], 1) * seen[token] / total
        if k == 1:
            return free / total
        if (history, k) not in self.left:
            self.left[history, k] = 1 - math.fsum(self.p(shorter, other, k - 1) for other in seen)
        return free / total / self.left[history, k] * self.p(shorter, token, k - 1)

    def log10(self, tokens, order):
        return sum(math.log10(self.p(self.history(tokens, i, order), token, order)) for i, token in enumerate(tokens))


def check(spark, rows, order, monkeypatch, block=6000, part=4000):
    monkeypatch.setattr(katz, "BLOCK_BYTES", block)
    monkeypatch.setattr(katz, "PART_BYTES", part)
    texts = [tokens_of(text) for doc_id, text in rows if not held_out(doc_id)]
    words = Counter(token for tokens in texts for token in tokens)
    n, v = sum(words.values()), len(words)
    plain = Plain(texts, order)
    want = []
    for doc_id, text in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        want.append((doc_id, held_out(doc_id), len(tokens), sum(words[t] > 0 for t in tokens), n,
                     round(base, 6), round(plain.log10(tokens, order), 6)))
    got = katz.score(frame(spark, rows).repartition(2), order).collect()
    got = [(*row[:5], round(row["base_score"], 6), round(row["score"], 6)) for row in got]
    key = lambda row: (row[0] is not None, *map(str, row))
    for ours, theirs in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert ours[:5] == theirs[:5]
        assert ours[5:] == pytest.approx(theirs[5:], rel=1e-9, abs=1e-5)


def random_rows(n, kinds, longest):
    draw = random.Random(n)
    words = [f"W{i}" for i in range(kinds)]
    return [(i, " ".join(draw.choices(words, [1 / (1 + j) for j in range(kinds)], k=draw.randrange(longest)))) for i in range(n)]


def test_bigrams_beside_plain(spark, monkeypatch):
    rows = random_rows(120, 300, 60) + [(None, "W1 w2 new"), (None, None), (500, None), (501, ""), (502, " \n"), (503, "É é É"),
                                        (503, "É é É"), (504, "hot " * 900), (505, "hot w1 hot w2 " * 300)]
    check(spark, rows, 2, monkeypatch)


def test_trigrams_beside_plain(spark, monkeypatch):
    check(spark, random_rows(60, 25, 50), 3, monkeypatch)


def test_few_texts(spark, monkeypatch):
    check(spark, [(1, "a b a"), (2, "a b a")], 2, monkeypatch)
    check(spark, [(next(i for i in range(99) if held_out(i)), "a b")], 2, monkeypatch)
    assert katz.score(frame(spark, [])).collect() == []


def test_given_documents_beside_plain(spark, monkeypatch):
    rows = [tuple(row) for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 2, monkeypatch, 200_000, 150_000)


def test_probabilities_add_up():
    texts = [tokens_of(text) for _, text in random_rows(40, 12, 30)]
    plain = Plain(texts, 2)
    vocabulary = {token for tokens in texts for token in tokens}
    for history in (("w1",), ("w7",), ("<begin>",)):
        assert sum(plain.p(history, token, 2) for token in [*vocabulary, "unknown"]) == pytest.approx(1)


def test_packed_numbers_come_back():
    import numpy as np

    for values in ([], [0], [1, 255], [256, 3], [1 << 40, 0], [0.5, 0.0]):
        values = np.array(values, np.float64 if 0.5 in values else np.int64)
        assert katz.unpack(katz.pack(values)).tolist() == values.tolist()
