"""A ledger of quality rules: measured once, judged as often as one likes.

``measure`` reads each whole text once and stores its measurements and one bit for each
rule it fails.  A policy is a mask of rules, so a new version of a policy, and how many
documents each of its rules removes alone or together with others, come from the bits
without another look at the texts.

Nulls, empties and odd input: a null or empty text measures 0 everywhere and fails the
rules on few words; repeated rows are judged one by one; an empty table gives an empty
ledger; of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import arrow_schema, kept_by_worker, slices

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

#: The order of the rules is the order of their bits; a rule is added at the end and never moved.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("word_length_low", "n_words > 0 AND word_chars < 2 * n_words"),
    ("word_length_high", "n_words > 0 AND word_chars > 20 * n_words"),
    ("symbols", "n_words > 0 AND 100 * n_symbols > 60 * n_words"),
    ("repeated_lines", "n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines"),
)

#: Rules of each policy version.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "word_length_low", "word_length_high", "symbols"),
    "v2": tuple(name for name, _ in RULES),
}

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: Words of a window.
WINDOW = 5

#: Words whose hashes a worker keeps.
CACHE_ENTRIES = 500_000


class WordHashes(dict):
    """64 well-mixed bits for each word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hash_array(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` words in a row."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size if len(out) else 0):
        out = (out ^ words[i:len(out) + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def repeated_words(words: np.ndarray, size: int = WINDOW) -> int:
    """Words that lie in a window which the text has twice or more."""
    windows = window_hashes(words, size)
    if len(windows) < 2:
        return 0
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[at] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure_text(text: str, hashes: WordHashes) -> tuple[int, int, int, int, int, int]:
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(hash_array(words, hashes)), len(lines))


def measure(docs: DataFrame) -> DataFrame:
    """The ledger: measurements and ``failed_bits`` of every whole text."""
    schema = arrow_schema(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept_by_worker("word-hashes", WordHashes)
        for batch in batches:
            for part in slices(batch, "text"):
                got = [measure_text(text or "", hashes) for text in part.column("text").to_pylist()]
                columns = [pa.array(column, pa.int64()) for column in zip(*got, strict=True)]
                yield pa.record_batch([part.column("doc_id"), *columns], schema=schema)

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEASURES)
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(0) for bit, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed_bits", failed.cast("long"))


def mask(rules: tuple[str, ...]) -> int:
    """The bits of ``rules``."""
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in rules)


def fails(policy: str) -> Column:
    """Whether a row of the ledger fails a rule of ``policy``."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """(rule, failed, only_this, kept_without): what each rule of ``policy`` does.

    The ledger shrinks to one row for each set of failed rules before the rules are compared.
    """
    rules = POLICIES[policy]
    sets = ledger.select(F.col("failed_bits").bitwiseAND(F.lit(mask(rules))).alias("bits")).groupBy("bits").agg(
        F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(mask((rule,))).cast("long").alias("bit"))
                               for rule in rules])).alias("r")
    rows = sets.select("bits", "n", each)
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) == 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(has & rest, F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("kept_without"))
