"""Benchmark phrases found in documents through an FM-index of each shard.

A shard is a run of documents of one partition with about SHARD_WORDS words that any
phrase uses; words that no phrase uses, and document ends, part the text.  Its words are
numbers; the suffixes are sorted by doubling; the Burrows-Wheeler transform lies in a
wavelet matrix whose ranks answer all phrases of a block side by side, from the last
word to the first.  Rows of the suffix array at every SAMPLE-th position keep their
position; the other occurrences step back to one of these.  The spans of all
occurrences in a document are merged.

A phrase is a window of ``window`` words of an item, or a whole shorter item.  Phrases are
sent to the workers in blocks of at most BLOCK_BYTES of item text on average; one block's
spans are written before the next block is sent, and merged by document.

Nulls, empties and odd input: a null or empty text has no words; such items have no phrase;
an item without an id gives hits but no name; repeated items give the same spans; repeated
rows of ``docs`` are searched one by one and a doc_id with several rows gives a row for each;
empty tables give no hits; of the inputs' columns only doc_id, item_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import arrow_schema, kept_by_worker, slices, store, without_ids

#: Words that phrases use in one index.
SHARD_WORDS = 1 << 19

#: Positions of the suffix array from one kept row to the next.
SAMPLE = 8

#: Bytes of item text that are sent to the workers at a time, on average.
BLOCK_BYTES = 32 << 20

#: Bytes that are part of words, upper case folded; all others are spaces.
_WORD_BYTES = bytes(
    byte if byte >= 0x80 or 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A else byte + 32 if 0x41 <= byte <= 0x5A else 32
    for byte in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, a-z (A-Z folded) and anything beyond ASCII."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class Phrases:
    """The different windows of a block of items as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            words = [self.number.setdefault(word, len(self.number) + 1) for word in words_of(text)]
            for start in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[start:start + window]), set()).add(item_id)
        self.items = [sorted((str(item) for item in ids if item is not None)) for ids in owners.values()]
        self.lengths = np.array([len(phrase) for phrase in owners], np.int64)
        self.shortest = int(self.lengths.min()) if owners else 0
        self.words = np.zeros((len(owners), window), np.int64)
        for row, phrase in enumerate(owners):
            self.words[row, :len(phrase)] = phrase


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    head = np.append(True, rank[order][1:] != rank[order][:-1])
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = start
    step = 1
    while True:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        behind = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        again = np.lexsort((behind, start[tied]))
        order[tied] = at[again]
        behind, group = behind[again], start[tied]
        new = np.append(True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1]))
        head[tied] = new
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = start
        step *= 2


class WaveletMatrix:
    """Ranks and single symbols of a sequence of numbers, one row of bits for each binary digit."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.digits, self.n = digits, len(symbols)
        self.words, self.before, self.zeros = [], [], []
        current = symbols
        for digit in range(digits - 1, -1, -1):
            bit = ((current >> digit) & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(64 - self.n % 64, bool)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.zeros.append(self.n - int(bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[level][word] & ((np.uint64(1) << shift) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before its position ``at``."""
        low, high = np.zeros_like(at), at
        for level in range(self.digits):
            one = ((symbol >> (self.digits - 1 - level)) & 1).astype(bool)
            low_ones, high_ones = self._ones(level, low), self._ones(level, high)
            low = np.where(one, self.zeros[level] + low_ones, low - low_ones)
            high = np.where(one, self.zeros[level] + high_ones, high - high_ones)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros_like(at)
        for level in range(self.digits):
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            one = ((self.words[level][word] >> shift) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
            out = (out << 1) | one
        return out


class FMIndex:
    """Backward search over one sequence of word numbers; 0 parts it and is never searched."""

    def __init__(self, text: np.ndarray, largest: int):
        text = np.append(text, 0)  # the end sorts before all else: a tie with it is broken by what is missing behind
        order = suffix_array(text)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=largest + 1)))
        before = text[order - 1]
        self.last_column = WaveletMatrix(before, max(1, int(largest).bit_length()))
        # A run's begin keeps its row as well: a walk never steps over a parting 0.
        self.kept = (order % SAMPLE == 0) | (before == 0)
        self.kept_before = np.append(0, np.cumsum(self.kept))
        self.positions = order[self.kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows [low, high) whose suffixes begin with each phrase."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.last_column.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            symbol = phrases[live, lengths[live] - 1 - step]
            low[live] = self.first[symbol] + self.last_column.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.last_column.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        walking = np.flatnonzero(~self.kept[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.last_column.symbol(at)
            rows[walking] = self.first[symbol] + self.last_column.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.kept[rows[walking]]]
        return self.positions[self.kept_before[rows]] + steps


class Shard:
    """Documents gathered for one index: runs of phrase words, and where each run lies."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.doc_ids: list[int | None] = []
        self.keys: list[int] = []
        self.n_words: list[int] = []
        self.runs: list[np.ndarray] = []
        self.run_doc: list[np.ndarray] = []
        self.run_at: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = words_of(text)
        numbers = np.fromiter(map(self.phrases.number.get, words, [0] * len(words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(numbers != 0, prepend=False, append=False))
        begin, end = edges[::2], edges[1::2]
        long_enough = end - begin >= max(1, self.phrases.shortest)
        for a, b in zip(begin[long_enough].tolist(), end[long_enough].tolist(), strict=True):
            self.runs += [numbers[a:b], np.zeros(1, np.int64)]
            at = np.arange(a, b + 1)
            self.run_at.append(at)
            self.run_doc.append(np.full(len(at), len(self.doc_ids)))
            self.held += len(at)
        self.doc_ids.append(doc_id)
        self.keys.append(xxhash.xxh3_64_intdigest(text or "") - (1 << 63))
        self.n_words.append(len(words))

    def spans(self) -> Iterator[tuple[int | None, int, list[int], list[int], list[int]]]:
        """(doc_id, n_words, span starts, span ends, phrases) of each document, spans merged."""
        doc = begin = end = phrase = np.zeros(0, np.int64)
        if self.held and len(self.phrases.lengths):
            text = np.concatenate(self.runs)
            index = FMIndex(text, len(self.phrases.number))
            low, high = index.search(self.phrases.words, self.phrases.lengths)
            found = np.flatnonzero(high > low)
            phrase = np.repeat(found, (high - low)[found])
            first = np.cumsum((high - low)[found]) - (high - low)[found]
            rows = np.arange(len(phrase)) - np.repeat(first - low[found], (high - low)[found])
            at = index.locate(rows)
            doc = np.concatenate(self.run_doc)[at]
            begin = np.concatenate(self.run_at)[at]
            end = begin + self.phrases.lengths[phrase]
        order = np.lexsort((begin, doc))
        doc, begin, end, phrase = doc[order], begin[order], end[order], phrase[order]
        bounds = np.searchsorted(doc, np.arange(len(self.doc_ids) + 1))
        for i, (doc_id, n_words) in enumerate(zip(self.doc_ids, self.n_words, strict=True)):
            here = slice(bounds[i], bounds[i + 1])
            starts, ends = merged(begin[here], end[here])
            yield doc_id, n_words, starts.tolist(), ends.tolist(), np.unique(phrase[here]).tolist()


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their begin, overlapping and touching ones joined."""
    if not len(begin):
        return begin, end
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    return begin[new], reach[np.append(new[1:], len(reach)) - 1]


SPANS = "doc_id long, text_key long, n_words long, span_starts array<long>, span_ends array<long>, items array<string>, n_items long"


def _search_block(docs: DataFrame, items: list[tuple[int | None, str | None]], window: int) -> DataFrame:
    # Plain rows are sent, since a worker without this package cannot unpickle its classes.
    shared = docs.sparkSession.sparkContext.broadcast(items)
    name = f"phrases:{uuid.uuid4().hex}"
    schema = arrow_schema(SPANS)

    def rows(shard: Shard) -> pa.RecordBatch:
        out = []
        for (doc_id, n_words, starts, ends, phrases), key in zip(shard.spans(), shard.keys, strict=True):
            names = sorted({name for phrase in phrases for name in shard.phrases.items[phrase]})
            out.append((doc_id, key, n_words, starts, ends, names, len(names)))
        columns = zip(*out, strict=True)
        return pa.record_batch([pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)],
                               schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = kept_by_worker(name, lambda: Phrases(shared.value, window))
        shard = Shard(phrases)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    shard.add(doc_id, text)
                    if shard.held >= SHARD_WORDS:
                        yield rows(shard)
                        shard = Shard(phrases)
        if shard.doc_ids:
            yield rows(shard)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, SPANS)


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, n_words, span_starts, span_ends, items, n_items): where test phrases lie, in words from 0.

    ``items`` has the ids, sorted as strings.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = size // block_bytes + 1
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    if blocks == 1:
        return _search_block(docs, [tuple(row) for row in items.collect()], window)
    found = []
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        spans = _search_block(docs, [tuple(row) for row in part.collect()], window)
        found.append(store(spans.filter("n_items > 0 OR size(span_starts) > 0"), "benchmark-spans"))
    return _merge_blocks(docs, found)


def _merge_blocks(docs: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Spans of several blocks by document: few documents have any, and each has as many as its text allows."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    schema = arrow_schema(SPANS)

    def merge(group):
        rows = group.to_pylist()
        starts = np.array([x for row in rows for x in row["span_starts"]], np.int64)
        ends = np.array([x for row in rows for x in row["span_ends"]], np.int64)
        order = np.argsort(starts, kind="stable")
        begin, end = merged(starts[order], ends[order])
        names = sorted({name for row in rows for name in row["items"]})
        return pa.Table.from_pylist([{"doc_id": rows[0]["doc_id"], "text_key": rows[0]["text_key"], "n_words": rows[0]["n_words"],
                                      "span_starts": begin.tolist(), "span_ends": end.tolist(),
                                      "items": names, "n_items": len(names)}], schema=schema)

    hits = every.groupBy("doc_id", "text_key").applyInArrow(merge, SPANS)
    rows = _search_block(docs, [], 1).alias("d")
    same = F.expr("d.doc_id <=> h.doc_id AND d.text_key = h.text_key")
    return rows.join(hits.alias("h"), same, "left").select(
        "d.doc_id", "d.text_key", "d.n_words",
        *[F.coalesce(f"h.{name}", f"d.{name}").alias(name) for name in ("span_starts", "span_ends", "items", "n_items")])


def contamination(spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): at least 1 word in 20 lies in a test phrase."""
    hit = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: b - a), F.lit(0).cast("long"),
                      lambda total, length: total + length)
    return spans.select(
        "doc_id", "n_words", hit.alias("n_hit"), "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))



def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    found = contamination(find_spans(docs, benchmark, window))
    return without_ids(docs, found.filter("contaminated").select("doc_id"))
