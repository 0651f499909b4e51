"""Token counts of whole texts, by merging all pre-tokens of a batch side by side.

The pre-tokens that a worker has not met lately lie in one flat numpy array with the
bounds of each.  A round looks up the rank of every neighbouring pair, takes the lowest
rank of each pre-token and merges all its occurrences in all pre-tokens at once; those
without a pair left are done, and the symbols that survive are their tokens.

A pair's merge makes a symbol of its own, and all pairs with that symbol rank later,
so merging every occurrence at once gives what merging one at a time gives.  Of
overlapping occurrences (``aaa``) the earlier one is merged.

Nulls, empties and odd input: null and empty texts have no bytes and no tokens; repeated
rows are counted one by one; an empty table gives an empty table; a special string of
the vocabulary inside a text is one token, as in the library's default; of the input's
columns only doc_id and text are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import arrow_schema, kept_by_worker, slices
from panelspark.llm.tokens import BYTE_LEVEL_CUT, SPACE, read_vocabulary, segments

#: Cuts whose counts a worker keeps.
CACHE_ENTRIES = 1_000_000

#: Pre-tokens that are merged together.
MERGE_BATCH = 100_000

#: Fixed value: the byte-level pre-token pattern, its white space spelled out.
PRE_TOKEN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
             rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(256 + n): byte for n, byte in enumerate(hidden)}


class Merges:
    """The merge table of a byte-level vocabulary as sorted arrays."""

    def __init__(self, vocabulary: str):
        read = json.loads(vocabulary)
        ids = read["model"]["vocab"]
        self.size = np.int64(max(ids.values()) + 1)
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in byte_symbols().items():
            self.of_byte[byte] = ids[letter]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in read["model"]["merges"]]
        keys = np.array([ids[a] * int(self.size) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special = [token["content"] for token in read.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        counts = np.array([len(word) for word in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), counts)
        while len(symbols) > 1:
            inside = owner[1:] == owner[:-1]
            rank = np.where(inside, self.rank(symbols[:-1], symbols[1:]), NO_RANK)
            rank = np.append(rank, np.int32(NO_RANK))
            starts = np.flatnonzero(np.append(True, ~inside))
            lowest = np.minimum.reduceat(rank, starts)
            row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
            hit = (rank == lowest[row]) & (rank != NO_RANK)
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= (place - run) % 2 == 0
            first = np.flatnonzero(hit)
            symbols[first] = self.merged[rank[first]]
            counts -= np.bincount(owner[first], minlength=len(counts))
            stays = np.append(True, ~hit[:-1]) & (lowest[row] != NO_RANK)
            symbols, owner = symbols[stays], owner[stays]
        return counts


class Counter:
    """Counts of texts; a cut's count is kept, so a word is merged once a worker."""

    def __init__(self, vocabulary: str):
        import regex

        self.merges = Merges(vocabulary)
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.special = re.compile("|".join(map(re.escape, self.merges.special)) or r"(?!)")
        self.known: dict[str, int] = {}

    def _learn(self, cuts: list[str]) -> None:
        for start in range(0, len(cuts), MERGE_BATCH):
            part = cuts[start:start + MERGE_BATCH]
            pieces = [self.pre_tokens(cut) for cut in part]
            words = [piece.encode() for found in pieces for piece in found]
            sums = np.append(0, np.cumsum(self.merges.count(words)))
            ends = np.cumsum([len(found) for found in pieces])
            counts = np.diff(sums[np.append(0, ends)])
            self.known.update(zip(part, counts.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        special = [len(self.special.findall(text)) for text in texts]
        cuts = [[BYTE_LEVEL_CUT.findall(part) for plain in (self.special.split(text) if n else [text])
                 for part in segments(plain)] for text, n in zip(texts, special, strict=True)]
        every = {cut for text in cuts for part in text for cut in part}
        missing = every.difference(self.known)
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            self.known.clear()
            missing = every
        self._learn(list(missing))
        return [n + sum(sum(map(self.known.__getitem__, part)) for part in text)
                for n, text in zip(special, cuts, strict=True)]


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    name = f"token-counter:{vocabulary_path}"
    out = "doc_id long, n_bytes long, n_tokens long"
    schema = arrow_schema(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(name, lambda: Counter(vocabulary.value))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [text or "" for text in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"),
                                       pa.array([len(text.encode()) for text in texts], pa.int64()),
                                       pa.array(counter.count(texts), pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, out)


def over_limit(counted: DataFrame, limit: int) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
