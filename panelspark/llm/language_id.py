"""Language of whole texts from word frequencies, backing off to character n-grams.

A word that the model knows counts with its log frequency in each language.  For any
other word the n-grams of the longest order of which the model knows one count, with the
mean of their log frequencies; a word without a known letter counts for nothing.

The model is fitted on a bounded sample of the labelled rows: LABELLED_ROWS in all, the same number of
each language, or all rows of a language that has fewer.  Which rows is decided by a hash of id and text.
All words and n-grams of the sampled texts are kept with their counts in every language, as 64-bit
hashes with some 14 bytes for each feature and language that has it; the size of the model so does not
depend on the size of the input.  It is sent to the workers as plain arrays.

Ties between languages go to the first by name.

Nulls, empties and odd input: a null text or one without letters is ``und`` with score 0;
texts without a label teach nothing; repeated rows count each time; without a labelled
text every document is ``und``; an empty table gives an empty table; of the input's columns only doc_id, text
and (to learn) lang are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import arrow_schema, kept_by_worker, slices, store

#: Longest n-gram.
ORDER = 3

#: Labelled rows that a model is fitted on, about (a row is taken if its hash lies below its language's share).
LABELLED_ROWS = 16_000

#: A text is of its language if so many of its words are known in it, or have half of their longest n-grams there.
LEAST_PLAUSIBLE = 0.5

#: And if so many of its characters, white space aside, are letters.
LEAST_LETTERS = 0.2

#: Words whose evidence a worker keeps.
CACHE_ENTRIES = 500_000

#: What a frequency starts from.
PRIOR = 0.5

UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+").findall
_ASCII_LETTERS = bytes(byte if chr(byte).isalpha() and byte < 128 else 32 for byte in range(256))


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    lowered = text.lower()
    if lowered.isascii():
        return lowered.encode().translate(_ASCII_LETTERS).decode().split()
    return _LETTERS(lowered)


def grams_of(word: str, order: int) -> list[str]:
    """``order`` characters in a row, with a mark before and after the word for orders over one."""
    marked = f"^{word}$" if order > 1 else word
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


def count_features(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, kind, feature, n): kind 0 counts words, kind k n-grams of k characters."""
    out = "lang string, kind int, feature string, n long"
    schema = arrow_schema(out)

    def batch_of(lang: str, kind: int, counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([lang] * len(counts), pa.string()), pa.array([kind] * len(counts), pa.int32()),
                                pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                               schema=schema)

    def flush(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in words.items():
            yield batch_of(lang, 0, counts)
            for k in range(1, order + 1):
                grams: Counter = Counter()
                for word, n in counts.items():
                    for gram in grams_of(word, k):
                        grams[gram] += n
                yield batch_of(lang, k, grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > CACHE_ENTRIES:
                yield from flush(words)
                words = {}
        yield from flush(words)

    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return labelled.mapInArrow(count, out).groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(lang, text) of about ``rows`` labelled rows, as many of each language; all of a language that has fewer."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    # One row for each language there is, as the model has; texts are not moved for it.
    share = counts.crossJoin(counts.agg(F.count("*").alias("_langs"))).select("lang", F.expr(f"{rows} / _langs / _n").alias("_share"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text")), F.lit(1 << 40)) / float(1 << 40)
    return labelled.select("lang", "text", draw.alias("_draw")).join(F.broadcast(share), "lang").filter("_draw < _share").select("lang", "text")


def hashes_of(features: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for each."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(feature.encode(), 42) for feature in features), np.uint64,
                       len(features)).view(np.int64)


class Model:
    """Log frequencies by language of all words and n-grams that were counted."""

    @classmethod
    def of(cls, state: dict) -> Model:
        """The model with these plain values."""
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def __init__(self, counts: pa.Table, totals: dict[tuple[str, int], tuple[int, int]], order: int):
        self.order = order
        self.langs = sorted({lang for lang, _ in totals})
        at = {lang: i for i, lang in enumerate(self.langs)}
        kinds, features, n = (counts.column(name).to_numpy() for name in ("kind", "feature", "n"))
        names = counts.column("lang").combine_chunks().dictionary_encode()
        place = np.array([at[name] for name in names.dictionary.to_pylist()], np.int32)
        langs = place[names.indices.to_numpy()] if len(place) else np.zeros(0, np.int32)
        self.keys, self.starts, self.lang, self.logs, self.absent = [], [], [], [], []
        for kind in range(order + 1):
            of_kind = np.flatnonzero(kinds == kind)
            of_kind = of_kind[np.argsort(features[of_kind], kind="stable")]
            keys, starts = np.unique(features[of_kind], return_index=True)
            whole = np.log(np.array([sum(totals.get((lang, kind), (0, 0))) + 1.0 for lang in self.langs]))
            self.keys.append(keys)
            self.starts.append(np.append(starts, len(of_kind)))
            self.lang.append(langs[of_kind].astype(np.uint16 if len(self.langs) < 1 << 16 else np.int32))
            self.logs.append((np.log(n[of_kind] + PRIOR) - whole[langs[of_kind]]).astype(np.float32))
            self.absent.append((np.log(PRIOR) - whole).astype(np.float32))

    def places(self, kind: int, features: list[str]) -> np.ndarray:
        """Where each feature lies; -1 if it was never counted."""
        keys, wanted = self.keys[kind], hashes_of(features)
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def rows(self, kind: int, places: np.ndarray) -> np.ndarray:
        """The log frequencies of features by their places, for every language."""
        out = np.tile(self.absent[kind], (len(places), 1))
        first = self.starts[kind][places]
        sizes = self.starts[kind][places + 1] - first
        entries = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        out[np.repeat(np.arange(len(places)), sizes), self.lang[kind][entries]] = self.logs[kind][entries]
        return out

    def known_in(self, kind: int, places: np.ndarray) -> np.ndarray:
        """For every language, whether each feature was counted in it; places of -1 are of no language."""
        out = np.zeros((len(places), len(self.langs)), bool)
        found = np.flatnonzero(places >= 0)
        first = self.starts[kind][places[found]]
        sizes = self.starts[kind][places[found] + 1] - first
        entries = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        out[np.repeat(found, sizes), self.lang[kind][entries]] = True
        return out

    def plausible(self, words: list[str]) -> np.ndarray:
        """For every language, whether each word is known in it, or at least half of its longest n-grams are."""
        out = self.known_in(0, self.places(0, words))
        left = np.flatnonzero(~out.all(axis=1))
        if len(left):
            grams = [grams_of(words[i], self.order) for i in left.tolist()]
            sizes = np.array([len(one) for one in grams])
            known = self.known_in(self.order, self.places(self.order, list(chain.from_iterable(grams))))
            owner = np.repeat(np.arange(len(left)), sizes)
            share = np.zeros((len(left), len(self.langs)))
            np.add.at(share, owner, known)
            out[left] |= 2 * share >= np.maximum(1, sizes)[:, None]
        return out

    def evidence(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log frequencies, or the mean of those of its n-grams."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        found = self.places(0, words)
        known = np.flatnonzero(found >= 0)
        out[known] = self.rows(0, found[known])
        left = np.flatnonzero(found < 0)
        for k in range(self.order, 0, -1):
            if not len(left):
                break
            grams = [grams_of(words[i], k) for i in left.tolist()]
            found = self.places(k, list(chain.from_iterable(grams)))
            owner = np.repeat(np.arange(len(left)), [len(one) for one in grams])[found >= 0]
            sums = np.zeros((len(left), len(self.langs)), np.float32)
            np.add.at(sums, owner, self.rows(k, found[found >= 0]))
            n = np.bincount(owner, minlength=len(left))
            out[left[n > 0]] = sums[n > 0] / n[n > 0, None]
            left = left[n == 0]
        return out


class Scorer:
    """A model with the evidence of the words a worker has met, and whether they are plausible if that is asked for."""

    def __init__(self, model: Model, judges: bool = False):
        self.model, self.judges = model, judges
        self.at: dict[str, int] = {}
        self.table = np.zeros((1 << 12, max(1, len(model.langs))), np.float32)
        self.fits = np.zeros(self.table.shape, bool)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Where each word lies in the table."""
        if len(self.at) > CACHE_ENTRIES:
            self.at.clear()
        if new := list(set(words).difference(self.at)):
            first = len(self.at)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.fits = np.concatenate([self.fits, np.zeros_like(self.fits)])
            self.table[first:first + len(new)] = self.model.evidence(new)
            if self.judges:
                self.fits[first:first + len(new)] = self.model.plausible(new)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def _best(self, rows: np.ndarray) -> tuple[int, float]:
        total = self.table[rows].sum(axis=0, dtype=np.float64)
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return best, float(share[best] / share.sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the probability."""
        words = words_of(text or "")
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        best, share = self._best(self._rows(words))
        return self.model.langs[best], share

    def identified(self, text: str | None) -> bool:
        """Whether the text is in one of the languages: mostly plausible words of it, and letters enough."""
        words = words_of(text or "")
        if not words or not self.model.langs:
            return False
        if sum(map(len, words)) < LEAST_LETTERS * len("".join((text or "").split())):
            return False
        rows = self._rows(words)
        return bool(self.fits[rows, self._best(rows)[0]].mean() >= LEAST_PLAUSIBLE)


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Learn from a bounded sample of the rows of ``docs`` with a text and a lang."""
    counts = store(count_features(sample(docs), order).select("lang", "kind", F.xxhash64("feature").alias("feature"), "n"),
                   "language-counts")
    totals = {(row["lang"], row["kind"]): (row["tokens"], row["types"]) for row in counts.groupBy("lang", "kind").agg(
        F.sum("n").alias("tokens"), F.count("*").alias("types")).collect()}
    return Model(counts.toArrow(), totals, order)


def predict_with(docs: DataFrame, model: Model, judges: bool = False):
    """A function for tasks that gives the worker's scorer; plain arrays are sent, of bounded size."""
    import uuid

    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))
    name = f"language-scorer:{uuid.uuid4().hex}"
    return lambda: kept_by_worker(name, lambda: Scorer(Model.of(shared.value), judges))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    scorer_of = predict_with(docs, model)
    out = "doc_id long, lang_pred string, score double"
    schema = arrow_schema(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of()
        for batch in batches:
            for part in slices(batch, "text"):
                got = [scorer.predict(text) for text in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array([lang for lang, _ in got], pa.string()),
                                       pa.array([share for _, share in got], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, out)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, unchanged, that are in one of the model's languages."""
    scorer_of = predict_with(docs, model, judges=True)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of()
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array([scorer.identified(text) for text in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0; so is one without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
