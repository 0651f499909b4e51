"""Periodic runs of words: maximal pairs from a bottom-up LCP-interval tree.

A run is a stretch of words that repeats with a smallest period q, at least LEAST_EXPONENT times,
and that no neighbouring word extends.  Two occurrences i < j of the same words, of which neither
the word before nor the word behind agrees, are a maximal pair; the stretch from i to the end of
the second occurrence then has period j - i and cannot grow, so a maximal pair of length l at a
distance of at most l / (LEAST_EXPONENT - 1) *is* a run, and all runs come from such pairs.

All texts of a slice are sorted as suffixes together, each in words of its own, by prefix doubling
in numpy.  Only suffixes that share LEAST_PAIR words with another one of their text can belong to
an interval that matters; the tree is built from these alone.  Every interval keeps its occurrences
in text order, each with its class, the word before it; when two children meet, the smaller is
merged into the larger, and only neighbours of different classes make a pair: between the first two
periods of a run lies no other occurrence.  A pair at a multiple of the period spans the same
stretch, and the least distance of a stretch is its period.

Nulls, empties and odd input: a null or empty text has no words and no runs; repeated rows, and
rows with the same or no doc_id, are looked at one by one; ties for the strongest run go to the
least start, then the least period; an empty table gives an empty table; of the input's columns
only doc_id and text are read.  A text is held whole in one task, in some 100 bytes for each word.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import slices

LEAST_LENGTH = 6
LEAST_EXPONENT = 4

#: A pair with distance q has max(LEAST_LENGTH - q, (LEAST_EXPONENT - 1) * q) words at least, and so five.
LEAST_PAIR = 5

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the first LEAST_PAIR words from every place: how many places come before; and who shares its rank."""
    size = len(codes)
    one = _dense(codes)

    def further(rank: np.ndarray, by: np.ndarray, step: int) -> np.ndarray:
        behind = np.zeros(size, np.int64)
        behind[:size - step] = by[step:]
        return _dense(rank * size + behind)

    two = further(one, one, 1)
    rank = further(further(two, two, 2), one, LEAST_PAIR - 1)
    counts = np.bincount(rank, minlength=size)
    return (np.cumsum(counts) - counts)[rank], np.flatnonzero(counts[rank] > 1)


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that share LEAST_PAIR codes with another, in suffix order, and how many codes each shares with the one before.

    ``codes`` must hold a code of its own at the end of each text.
    """
    if len(codes) <= LEAST_PAIR:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, tied = _ranks(codes)
    order, active, width = tied, tied, LEAST_PAIR
    levels = []
    while len(active):
        levels.append((width, rank.astype(np.int32) if len(codes) < 1 << 31 else rank.copy()))
        ends = rank[active + width]
        by = np.lexsort((ends, rank[active]))
        active, group, ends = active[by], rank[active[by]], ends[by]
        opens = np.append(True, group[1:] != group[:-1])
        splits = opens | np.append(True, ends[1:] != ends[:-1])
        at = np.arange(len(active))
        rank = rank.copy()
        rank[active] = group + np.maximum.accumulate(np.where(splits, at, 0)) - np.maximum.accumulate(np.where(opens, at, 0))
        alone = splits & np.append(splits[1:], True)
        active, width = active[~alone], width * 2
    order = order[np.argsort(rank[order], kind="stable")]
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b, size = order[:-1].copy(), order[1:].copy(), len(codes)
        got = np.zeros(len(a), np.int64)
        for width, level in reversed(levels):
            same = (a < size) & (b < size) & (level[np.minimum(a, size - 1)] == level[np.minimum(b, size - 1)])
            for value in (a, b, got):
                value += same * width
        same = np.ones(len(a), bool)
        for _ in range(LEAST_PAIR):
            same &= (a < size) & (b < size) & (codes[np.minimum(a, size - 1)] == codes[np.minimum(b, size - 1)])
            for value in (a, b, got):
                value += same
        shared[1:] = got
    return order, shared


def _merge(into: list[int], child: list[int], depth: int, left: list[int], found: list[tuple[int, int, int]]) -> list[int]:
    """The occurrences of both, in text order; neighbours that make a run of maximal pairs go to ``found``."""
    if len(child) > len(into):
        into, child = child, into
    most = depth // (LEAST_EXPONENT - 1)
    places = [bisect_left(into, x) for x in child]
    for x, at in zip(child, places, strict=True):
        if at and x - into[at - 1] <= most and left[into[at - 1]] != left[x]:
            found.append((into[at - 1], x - into[at - 1], depth))
        if at < len(into) and into[at] - x <= most and left[into[at]] != left[x]:
            found.append((x, into[at] - x, depth))
    if len(child) < 8:
        for x, at in zip(reversed(child), reversed(places), strict=True):
            into.insert(at, x)
    else:
        into += child
        into.sort()
    return into


def maximal_pairs(order: np.ndarray, shared: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, distance, length) of the maximal pairs that are runs, from the tree of LCP intervals, leaves first."""
    found: list[tuple[int, int, int]] = []
    classes = left.tolist()
    stack: list[tuple[int, list[int]]] = []
    child: list[int] = []
    for place, depth in zip(order.tolist(), shared.tolist(), strict=True):
        if depth < LEAST_PAIR:
            depth = 0
        while stack and stack[-1][0] > depth:
            top, into = stack.pop()
            child = _merge(into, child, top, classes, found)
        if stack and stack[-1][0] == depth:
            top, into = stack.pop()
            stack.append((top, _merge(into, child, top, classes, found)))
        elif depth:
            stack.append((depth, child))
        child = [place]
    while stack:
        top, into = stack.pop()
        child = _merge(into, child, top, classes, found)
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(words) for words in texts], np.int64)
    flat = np.fromiter((numbers[word] for words in texts for word in words), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    codes = np.full(int(ends[-1]) if len(ends) else 0, len(numbers), np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = False
    codes[inside] = flat
    codes += owner * (len(numbers) + 1)  # each text has words of its own, and an end of its own
    order, shared = suffix_order(codes)
    spans: dict[tuple[int, int], int] = {}
    for place, distance, length in maximal_pairs(order, shared, np.append(-1, codes[:-1])):
        span = (place, distance + length)
        if distance + length >= LEAST_LENGTH and distance < spans.get(span, distance + 1):
            spans[span] = distance
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = ends - sizes - 1
    for (place, length), period in spans.items():
        text = int(owner[place])
        out[text].append((place - int(starts[text]), length, period))
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of every whole text, and its words with each run cut to one period."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [(text or "").encode().split() for text in part.column("text").to_pylist()]
                runs = runs_of(texts)
                yield pa.record_batch([
                    part.column("doc_id"), pa.array([len(words) for words in texts], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), run, strict=True)) for run in one] for one in runs],
                             pa.list_(_RUN)),
                    pa.array([b" ".join(collapsed(words, one)).decode() for words, one in zip(texts, runs, strict=True)],
                             pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        look, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length / period, compared exactly; null without runs."""
    return F.expr(f"""
        reduce({runs}, CAST(NULL AS struct<start:long,length:long,period:long>), (best, run) ->
          CASE WHEN best IS NULL OR run.length * best.period > best.length * run.period
                 OR (run.length * best.period = best.length * run.period
                     AND (run.start < best.start OR (run.start = best.start AND run.period < best.period)))
               THEN run ELSE best END)""")


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the strongest one, and checksums of all runs and of the collapsed text."""
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = found.withColumn("best", strongest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """For a tenth of the ids: the words with a tail that repeats, start and period by the id; without an id unchanged."""
    number = zlib.crc32(str(doc_id).encode())
    if doc_id is None or number % 10 or not words:
        return words
    seed, size = number // 10, len(words)
    start = seed % size
    period = 1 + (size - start) // (3 + seed % 8)
    tail = words[start:start + period]
    return words[:start] + (tail * -(-(size - start) // period))[:size - start]


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of a tenth of the documents repeated by ``repeated_tail``."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                texts = [text if doc_id is None or not text or zlib.crc32(str(doc_id).encode()) % 10 else
                         b" ".join(repeated_tail(text.encode().split(), doc_id)).decode()
                         for doc_id, text in zip(ids, texts, strict=True)]
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(plant, "doc_id long, text string")
