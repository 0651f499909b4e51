"""Near-duplicate documents by MinHash with tensored banding.

Two collections of SUBKEYS short keys of ROWS minhashes each are computed; the table keys
are all SUBKEYS squared pairs of one key of each collection, so 60 minhashes give 100
tables of six.  Texts with equal shingle sets are one class from the start; classes that
share a table key are candidates.  A candidate is turned away only where its full sets cannot
be alike: by their sizes, or by bitmaps of BITS bits.  (Two sets share at most as many shingles as
their bitmaps share bits, and those that share a bit with another one of their own set.)  All others
are compared on their full sets, and linked classes form components.

At a similarity of exactly 0.75 a pair shares a key with probability 0.992, at 0.8 0.998, at
0.85 0.9999.

Nulls, empties and odd input: a null text or one without words has an empty set and is
linked with nothing; fewer words than a shingle make one shingle; repeated rows are one
class, and rows with the same doc_id one node; a row without a doc_id takes part in its
class, is never its representative unless all ids of the class are null, and then stays
alone with a null component; an empty table gives an empty table; of the input's columns
only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import BROADCAST_IDS, arrow_schema, kept_by_worker, slices, store, without_ids
from panelspark.llm.linking import linked_groups, shared_keys
from panelspark.llm.quality_rules import WordHashes, hash_array, window_hashes

SHINGLE = 5

#: Keys of each collection, and minhashes of each key.
SUBKEYS, ROWS = 10, 3
HASHES = 2 * SUBKEYS * ROWS

#: Bits of a class's bitmap; sets much larger than this are told apart by their full sets alone.
BITS = 2048

_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 512


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted different hashes of the text's shingles; A-Z is folded."""
    words = hash_array((text or "").encode().lower().split(), hashes)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(SHINGLE, len(words))))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima over a non-empty set, the upper half of each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _BLOCK):
        least = np.minimum(least, (shingles[None, start:start + _BLOCK] * _MULTIPLIERS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def subkeys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each ROWS minhashes in a row."""
    parts = signature.reshape(-1, ROWS).astype(np.uint64)
    out = np.zeros(len(parts), np.uint64)
    for column in parts.T:
        out = (out ^ column) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITS bits as longs: one is set for each shingle, by its upper bits."""
    out = np.zeros(BITS, np.uint8)
    out[(shingles >> np.uint64(65 - BITS.bit_length())).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def set_hash(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


SKETCH = "doc_id long, n_shingles long, set_hash binary, subkeys array<long>, bits array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    """Size, hash, short keys and bitmap of each document's shingle set."""
    schema = arrow_schema(SKETCH)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept_by_worker("word-hashes", WordHashes)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    shingles = shingle_set(text, hashes)
                    rows.append((len(shingles), set_hash(shingles), subkeys(minhashes(shingles)), bitmap(shingles))
                                if len(shingles) else (0, None, None, None))
                columns = zip(*rows, strict=True)
                yield pa.record_batch([part.column("doc_id"), *(pa.array(list(column), field.type) for column, field in
                                                                zip(columns, list(schema)[1:], strict=True))],
                                      schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, SKETCH)


def table_keys(items: DataFrame) -> DataFrame:
    """(key, slot, id): each pair of a key of the first collection and one of the second."""
    one = items.select("id", F.posexplode(F.slice("subkeys", 1, SUBKEYS)).alias("i", "x"), "subkeys")
    two = one.select("id", "i", "x", F.posexplode(F.slice("subkeys", SUBKEYS + 1, SUBKEYS)).alias("j", "y"))
    slot = F.col("i") * SUBKEYS + F.col("j")
    return two.select(F.xxhash64(slot, "x", "y").alias("key"), slot.cast("int").alias("slot"), "id")


def near(l: str, r: str) -> Column:
    """Sizes and bitmaps that allow 100 * intersection >= 75 * union; false only where sets cannot be linked."""
    sizes = F.expr(f"100 * least({l}.n, {r}.n) >= 75 * greatest({l}.n, {r}.n)")
    common = f"aggregate(zip_with({l}.bits, {r}.bits, (x, y) -> bit_count(x & y)), 0, (a, c) -> a + c)"
    return sizes & F.expr(f"7 * ({common} + least({l}.n - {l}.ones, {r}.n - {r}.ones)) >= 3 * ({l}.n + {r}.n)")


def meets(l: str, r: str, slot: Column) -> Column:
    """Whether ``slot`` pairs the first equal keys of both collections."""
    first = [F.expr(f"array_position(zip_with(slice({l}.subkeys, {start}, {SUBKEYS}), slice({r}.subkeys, {start}, "
                    f"{SUBKEYS}), (x, y) -> x = y), true) - 1") for start in (1, SUBKEYS + 1)]
    return slot == first[0] * SUBKEYS + first[1]


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with 100 * intersection >= 75 * union of the full shingle sets."""
    ids = store(pairs.selectExpr("a AS doc_id").union(pairs.selectExpr("b")).distinct(), "compared")
    few = ids.count() <= BROADCAST_IDS
    schema = arrow_schema("id long, shingles binary")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept_by_worker("word-hashes", WordHashes)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(text, hashes).tobytes() for text in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(sets, pa.binary())], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = store(texts.mapInArrow(sets_of, "id long, shingles binary"), "shingle-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(sets.selectExpr("id AS a", "shingles AS x"), "a").join(
        sets.selectExpr("id AS b", "shingles AS y"), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id that a document is linked with, itself included."""
    sketched = store(sketches(docs), "sketches")
    classes = store(sketched.filter("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("id")), "classes")
    ones = F.expr("aggregate(bits, 0, (a, x) -> a + bit_count(x))")
    items = store(classes.filter("id IS NOT NULL").join(
        sketched.select(F.col("doc_id").alias("id"), "set_hash", F.col("n_shingles").alias("n"), ones.alias("ones"), "subkeys", "bits"),
        ["id", "set_hash"]).dropDuplicates(["id", "set_hash"]).drop("set_hash"), "classes")
    groups, _ = linked_groups(items, shared_keys(table_keys(items)), near, meets, lambda pairs: verified(pairs, docs))
    placed = classes.join(groups, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    return sketched.select("doc_id", "n_shingles", "set_hash").join(placed, "set_hash", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def kept(duplicates: DataFrame) -> DataFrame:
    return duplicates.withColumn("kept", F.expr("doc_id <=> component_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component; of rows with equal doc_id and text one."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not ids.isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    return without_ids(docs, kept(near_duplicates(docs)).filter("NOT kept").select("doc_id"))
