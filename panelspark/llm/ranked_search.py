"""Ranked search by pipelined term partitioning: bundles of items travel from term owner to term owner.

Every term belongs to one owner, by the share of documents that hold it; the rarest terms come
first, so that bundles are light for most of their way.  The documents are dealt into shards of
about SHARD_DOCS.  A bundle of items starts, for each shard, with its terms and empty accumulators.
At each owner it meets the postings of its terms in that shard (a cogroup by bundle and shard), adds
their integer contributions to its sparse accumulators, one for each item and document with a term
so far, and goes on.  The last owner selects the best of each shard; one more ranking over these
gives the result.  Scores are sums of 64-bit integers, so neither order nor dealing changes them.

A group holds one shard's postings of at most BUNDLE_ITEMS items' terms from one owner, whatever the
number of documents; a term that every document holds is spread over all shards.  Which terms are
wanted, and their weights, come by joins that Spark plans by size.

Nulls, empties and odd input: a null or empty text has no terms; an item without terms, or of whose
terms no document has one, has no row; rows that repeat a doc_id are documents of their own, as are
repeated items; ties go by ascending doc_id, those without one last; without documents or items
the result is empty; of the inputs' columns only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelspark.llm.common import slices, store

#: Documents of a shard, about; items of a bundle.
SHARD_DOCS = 1024
BUNDLE_ITEMS = 256

#: An owner has the terms in one of so many documents or fewer that no owner before it has; the last has the rest.
OWNERS = (64, 8, 2)

#: A weight is this times the logarithm; a contribution has so many parts for a frequency without end.
WEIGHT_UNIT, PARTS = 1000, 1_000_000_000

#: Per cent of the length normalisation, and the saturation of a term's frequency (1.2 in tenths of m / 1000).
LENGTH_PERCENT, SATURATION = 75, 8

STATE = ("bundle long, shard int, items array<long>, terms array<long>, repeats array<long>, doc_ids array<long>, "
         "copies array<long>, acc_item array<int>, acc_doc array<int>, acc_score array<long>")

#: What ends a term: ASCII but letters and digits; A-Z are folded.
_FOLD = bytes(byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or chr(byte).isalnum() else 32 for byte in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def term_counts(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, n, term, tf): one row for each different term of each text; n counts all its terms."""
    schema = pa.schema([("row", pa.int64()), ("name", to_arrow_type(rows.schema[name].dataType)),
                        ("n", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = [Counter(terms_of(text)) for text in part.column("text").to_pylist()]
                sizes = [len(one) for one in counts]
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                lengths = np.repeat([one.total() for one in counts], sizes).astype(np.int64)
                yield pa.record_batch([
                    part.column("row").take(at), part.column("name").take(at), pa.array(lengths),
                    pa.array([term for one in counts for term in one], pa.binary()).cast(pa.string()),
                    pa.array([tf for one in counts for tf in one.values()], pa.int64())], schema=schema)

    kind = dict(rows.dtypes)[name]
    return rows.select(F.col(key).alias("row"), F.col(name).alias("name"), "text").mapInArrow(
        split, f"row long, name {kind}, n long, term string, tf long").withColumnsRenamed({"row": key, "name": name})


def lengths(docs: DataFrame) -> DataFrame:
    """One row: N, the documents with a term, and L, all their terms."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes = np.array([len(terms_of(text)) for text in part.column("text").to_pylist()], np.int64)
                yield pa.record_batch([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], names=["n", "l"])

    return docs.select("text").mapInArrow(measure, "n long, l long").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("l"), F.lit(0)).alias("n_terms"))


def owned_postings(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, int]:
    """(owner, shard, term, doc_id, copy, impact) of the ``wanted`` terms (term, number), and the number of shards.

    impact is w * ((PARTS * tf) div (1000 * tf + SATURATION * m)); w and m are the weight of the term and the
    relative length of the document.  75 * n * N must stay below 2^63.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("copy"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = store(term_counts(numbered, "copy", "doc_id").join(wanted, "term").drop("term"), "postings")
    size = lengths(docs).first()  # one row
    n_docs, n_terms = size["n_docs"], max(1, size["n_terms"])
    shards = max(1, -(-n_docs // SHARD_DOCS))
    df = F.col("df")
    owner = F.when(df * OWNERS[0] <= n_docs, 0)
    for i, share in enumerate(OWNERS[1:], 1):
        owner = owner.when(df * share <= n_docs, i)
    weights = store(found.groupBy("number").agg(F.count("*").alias("df")).select(
        "number", owner.otherwise(len(OWNERS)).alias("owner"),
        F.floor(WEIGHT_UNIT * F.log((2.0 * n_docs + 2) / (2 * df + 1))).cast("long").alias("w")), "term-weights")
    m = F.expr(f"100 - {LENGTH_PERCENT} + (({LENGTH_PERCENT}L * n * {n_docs}L) div {n_terms}L)")
    placed = found.join(weights, "number").withColumn("m", m).select(
        "owner", F.pmod(F.xxhash64("copy"), F.lit(shards)).cast("int").alias("shard"), F.col("number").alias("term"),
        "doc_id", "copy", F.expr(f"w * (({PARTS}L * tf) div (1000L * tf + {SATURATION}L * m))").alias("impact"))
    return store(placed, "owned"), shards


def bundles(item_terms: DataFrame, shards: int) -> DataFrame:
    """STATE before the first owner: the terms of each bundle, for each shard, without accumulators."""
    one = item_terms.withColumn("bundle", F.expr(f"item div {BUNDLE_ITEMS}")).groupBy("bundle").agg(
        F.array_sort(F.collect_list(F.struct("item", "number", "repeats"))).alias("t"))
    none = {name: F.array().cast(kind) for name, kind in (
        ("doc_ids", "array<long>"), ("copies", "array<long>"), ("acc_item", "array<int>"), ("acc_doc", "array<int>"),
        ("acc_score", "array<long>"))}
    return one.select("bundle", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                      F.col("t.item").alias("items"), F.col("t.number").alias("terms"),
                      F.col("t.repeats").alias("repeats"), *[column.alias(name) for name, column in none.items()])


def _list(table: pa.Table, name: str) -> np.ndarray:
    values = table.column(name).combine_chunks().values
    return values.to_numpy(zero_copy_only=False)


class _Groups:
    """The accumulators of one bundle and shard, laid out densely by item and document while postings are added."""

    def __init__(self, state: pa.Table, postings: pa.Table):
        import pyarrow.compute as pc

        self.state = state
        items, terms, repeats = (_list(state, name) for name in ("items", "terms", "repeats"))
        self.items, item_at = np.unique(items, return_inverse=True)
        copies = postings.column("copy").to_numpy()
        before = _list(state, "copies").astype(np.int64)
        self.copies = np.union1d(before, copies)
        # Ids go with their documents as Arrow values, so that those without one stay so.
        ids = pa.chunked_array([state.column("doc_ids").combine_chunks().values, *postings.column("doc_id").chunks], pa.int64())
        first = np.unique(np.concatenate([before, copies]), return_index=True)[1]
        self.doc_ids = pc.take(ids, pa.array(first)).combine_chunks()
        self.scores = np.zeros((len(self.items), len(self.copies)), np.int64)
        doc_at = np.searchsorted(self.copies, before)[_list(state, "acc_doc")] if len(before) else np.zeros(0, np.int64)
        self.scores[_list(state, "acc_item"), doc_at] = _list(state, "acc_score")

        term = postings.column("term").to_numpy()
        by = np.argsort(term, kind="stable")
        term, impact, at = term[by], postings.column("impact").to_numpy()[by], np.searchsorted(self.copies, copies)[by]
        low, high = np.searchsorted(term, terms, "left"), np.searchsorted(term, terms, "right")
        for i in np.flatnonzero(high > low).tolist():  # a document is once among the postings of a term
            self.scores[item_at[i], at[low[i]:high[i]]] += repeats[i] * impact[low[i]:high[i]]

    def carried(self) -> pa.Table:
        item, doc = np.nonzero(self.scores)
        values = {"doc_ids": self.doc_ids, "copies": pa.array(self.copies), "acc_item": pa.array(item.astype(np.int32)),
                  "acc_doc": pa.array(doc.astype(np.int32)), "acc_score": pa.array(self.scores[item, doc])}
        table = self.state
        for name, array in values.items():
            place = table.schema.get_field_index(name)
            column = pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
            table = table.set_column(place, name, column)
        return table

    def best(self, top: int) -> pa.Table:
        empty = self.doc_ids.is_null().to_numpy(zero_copy_only=False)
        ids = self.doc_ids.fill_null(0).to_numpy()
        item, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, scores in enumerate(self.scores):
            some = np.flatnonzero(scores > 0)
            if len(some) > top:
                some = some[scores[some] >= np.partition(scores[some], -top)[-top]]
            some = some[np.lexsort((self.copies[some], ids[some], empty[some], -scores[some]))][:top]
            item.append(np.full(len(some), i))
            doc.append(some)
        item, doc = np.concatenate(item), np.concatenate(doc)
        return pa.table({"item": self.items[item], "doc_id": self.doc_ids.take(pa.array(doc)), "copy": self.copies[doc],
                         "score": self.scores[item, doc]})


def search(docs: DataFrame, benchmark: DataFrame, top: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0."""
    items = store(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    spelt = store(term_counts(items, "item", "item_id").withColumnRenamed("tf", "repeats"), "item-terms")
    wanted = store(spelt.select("term").distinct().select("term", F.monotonically_increasing_id().alias("number")), "wanted")
    item_terms = store(spelt.join(wanted, "term").select("item", "number", "repeats"), "item-numbers")
    owned, shards = owned_postings(docs, wanted)
    state = bundles(item_terms, shards)
    of_bundle = item_terms.select(F.expr(f"item div {BUNDLE_ITEMS}").alias("bundle"), F.col("number").alias("term")).distinct()

    def carry(state: pa.Table, postings: pa.Table) -> pa.Table:
        if not state.num_rows or not postings.num_rows:
            return state
        return _Groups(state, postings).carried()

    def select(state: pa.Table, postings: pa.Table) -> pa.Table:
        return _Groups(state, postings).best(top)

    for owner in range(len(OWNERS) + 1):
        met = owned.filter(F.col("owner") == owner).drop("owner").join(of_bundle, "term")
        pair = state.groupBy("bundle", "shard").cogroup(met.groupBy("bundle", "shard"))
        state = pair.applyInArrow(*((carry, STATE) if owner < len(OWNERS) else
                                    (select, "item long, doc_id long, copy long, score long")))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "copy")
    ranked = state.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
