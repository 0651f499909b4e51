"""Token ids in files of canonical, length-limited Huffman codes.

``encode_documents`` gives each document its ids, ``write`` codes them and ``read``
decodes them.  The format is two Parquet tables: ``codebook`` (id, bits) and ``blocks``.
A block holds whole documents in ascending order, decodes by itself and has a bit
offset for every INTERVAL ids, so that a reader may start at any of these and numpy
may decode all of them side by side.

Nulls, empties and odd input: a null or empty text gives the end id alone; repeated
rows and rows with the same doc_id are coded one by one (equal rows in any order);
null doc_ids come first; an empty table gives empty tables; of the input's columns
only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm.common import arrow_schema, kept_by_worker, shared_folder, slices, store
from panelspark.llm.tokens import shared_encoder

#: No code is longer; fits any vocabulary of up to 2**MAX_BITS ids.
MAX_BITS = 18

#: Ids from one bit offset to the next.
INTERVAL = 256

#: Ids that a block has at least, and that are coded or decoded at a time.
BLOCK_IDS = 1 << 18

#: ``ids`` are little-endian, ``width`` bytes each: two if the vocabulary allows, else four.
IDS = "doc_id long, n_tokens long, width int, ids binary"
BLOCKS = ("part int, block int, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, "
          "bits binary, offsets binary")


def encode_documents(docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, width, ids): the ids of the whole text and ``end_id``."""
    encoder_of = shared_encoder(docs.sparkSession, vocabulary_path)
    schema = arrow_schema(IDS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of()
        dtype = encoder.dtype if end_id < 1 << 8 * encoder.dtype.itemsize else np.dtype("<u4")
        end, width = np.array([end_id], dtype).tobytes(), dtype.itemsize
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.frombuffer(raw, encoder.dtype).astype(dtype, copy=False).tobytes() + end
                       for raw in encoder.encode([text or "" for text in part.column("text").to_pylist()])]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(x) // width for x in ids], pa.int64()),
                                       pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, IDS)


def flat_ids(rows: pa.Array, width: int) -> np.ndarray:
    """The ids of all rows in a row, read from the column's own bytes."""
    low, high = rows.offset, rows.offset + len(rows)
    bounds = np.frombuffer(rows.buffers()[1], "<i4")
    return np.frombuffer(rows.buffers()[2] or b"", f"<u{width}")[bounds[low] // width:bounds[high] // width]


def count_ids(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task sends one row for each different id at most."""
    schema = arrow_schema("id long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width in set(batch.column("width").to_pylist()):
                rows = batch.filter(pc.equal(batch.column("width"), width)).column("ids")
                got = np.bincount(flat_ids(rows, width))
                if len(got) > len(total):
                    total, got = got, total
                total[:len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], schema=schema)

    return encoded.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Bits of each id's code: Huffman's lengths, then made to fit ``limit`` by Kraft's sum.

    Over-long codes are cut to ``limit``; the space this takes comes back by
    lengthening the rarest codes that still can grow.
    """
    if len(counts) > 1 << limit:
        raise ValueError(f"{len(counts)} ids do not fit codes of {limit} bits")
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    heap = [(n, i, i) for i, n in counts.items()]
    heapq.heapify(heap)
    parent: dict[int, int] = {}
    node = max(counts) + 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]] = parent[b[2]] = node
        heapq.heappush(heap, (a[0] + b[0], node, node))
        node += 1
    depth = {node - 1: 0}
    for inner in range(node - 2, max(counts), -1):
        depth[inner] = depth[parent[inner]] + 1
    bits = {i: min(limit, depth[parent[i]] + 1) for i in counts}
    over = sum(1 << (limit - b) for b in bits.values()) - (1 << limit)
    for i in sorted(counts, key=lambda i: (counts[i], i)):
        while over > 0 and bits[i] < limit:
            bits[i] += 1
            over -= 1 << (limit - bits[i])
    for i in sorted(counts, key=lambda i: (-counts[i], i)):
        while bits[i] > 1 and over + (1 << (limit - bits[i])) <= 0:
            over += 1 << (limit - bits[i])
            bits[i] -= 1
    return bits


class Codebook:
    """Canonical codes: by length, then id."""

    def __init__(self, bits: dict[int, int]):
        order = sorted(bits, key=lambda i: (bits[i], i))
        size = max(order, default=-1) + 1
        self.bits = np.zeros(size, np.uint8)
        self.codes = np.zeros(size, np.uint64)
        self.limit = max(bits.values(), default=1)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.length = np.zeros(1 << self.limit, np.uint8)
        code = last = 0
        for i in order:
            code <<= bits[i] - last
            last = bits[i]
            self.bits[i], self.codes[i] = last, code
            low = code << (self.limit - last)
            self.symbol[low:low + (1 << (self.limit - last))] = i
            self.length[low:low + (1 << (self.limit - last))] = last
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Big-endian 32-bit words of codes, and the bit offset of every INTERVAL-th id."""
        length = self.bits[ids].astype(np.int64)
        ends = np.cumsum(length)
        at = ends - length
        n_words = int(ends[-1] + 31) // 32 if len(ids) else 0
        word = at >> 5
        placed = self.codes[ids] << (64 - length - (at & 31)).astype(np.uint64)
        words = np.zeros(n_words + 1, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] += np.add.reduceat(placed >> np.uint64(32), first) if len(ids) else 0
        words[word[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first) if len(ids) else 0
        return words[:n_words].astype(">u4").tobytes(), at[::INTERVAL]

    def decode(self, raw: bytes, offsets: np.ndarray, n_ids: int) -> np.ndarray:
        """All lanes advance together, one id a step, by a table of ``limit`` bits."""
        words = np.append(np.frombuffer(raw, ">u4").astype(np.uint64), np.zeros(2, np.uint64))
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        lanes = len(offsets)
        out = np.zeros((INTERVAL, lanes), np.uint32)
        at = offsets.astype(np.int64)
        down, mask = np.uint64(64 - self.limit), np.uint64((1 << self.limit) - 1)
        end = (len(words) - 2) * 32
        for step in range(min(INTERVAL, n_ids)):
            peek = (pairs[at >> 5] >> (down - (at & 31).astype(np.uint64))) & mask
            out[step] = self.symbol[peek]
            at = np.minimum(at + self.length[peek], end)
        return out.T.reshape(-1)[:n_ids]


def shared_book(spark: SparkSession, bits: dict[int, int]) -> Callable[[], Codebook]:
    """A function that gives a worker's codebook; only the code lengths are sent, one for each id of the vocabulary."""
    shared = spark.sparkContext.broadcast(bits)
    name = f"codebook:{uuid.uuid4().hex}"
    return lambda: kept_by_worker(name, lambda: Codebook(shared.value))


def write(encoded: DataFrame, path: str) -> None:
    """Code ``encoded`` (a stored table of ``encode_documents``) in ascending doc_id order below ``path``."""
    counts = {row["id"]: row["n"] for row in count_ids(encoded).collect()}  # as many as the vocabulary has ids
    bits = code_lengths(counts)
    spark = encoded.sparkSession
    spark.createDataFrame(sorted(bits.items()), "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    book_of = shared_book(spark, bits)
    schema = arrow_schema(BLOCKS)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        block = first = held = 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        held_ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            book, ids = book_of(), np.concatenate(held_ids)
            coded, offsets, base = [], [], 0
            for start in range(0, len(ids), BLOCK_IDS):
                raw, at = book.encode(ids[start:start + BLOCK_IDS])
                coded.append(raw)
                offsets.append(at + base)
                base += len(raw) * 8
            return pa.record_batch([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(coded)], pa.binary()),
                pa.array([np.concatenate(offsets).astype("<i8").tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for doc_id, size, width, raw in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "n_tokens", "width")),
                                                batch.column("ids"), strict=True):
                doc_ids.append(doc_id)
                sizes.append(size)
                held_ids.append(np.frombuffer(raw.as_buffer(), f"<u{width}").copy())
                held += size
                if held >= BLOCK_IDS:
                    yield flush()
                    block, first, held = block + 1, first + held, 0
                    doc_ids, sizes, held_ids = [], [], []
        if doc_ids:
            yield flush()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(code, BLOCKS).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files at ``path``; ``start`` counts the ids of all documents before."""
    bits = {row["id"]: row["bits"] for row in spark.read.parquet(f"{path}/codebook").collect()}
    book_of = shared_book(spark, bits)
    out = "doc_id long, start long, n_tokens long, ids binary"
    schema = arrow_schema(out)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n_ids, before = batch.column("n_ids")[i].as_py(), batch.column("before")[i].as_py()
                bits = batch.column("bits")[i].as_buffer()
                offsets = np.frombuffer(batch.column("offsets")[i].as_buffer(), "<i8")
                sizes = batch.column("doc_tokens")[i].values.to_numpy()
                decoded = []
                for start in range(0, n_ids, BLOCK_IDS):
                    lanes = offsets[start // INTERVAL:(start + BLOCK_IDS) // INTERVAL]
                    more = (start + BLOCK_IDS) // INTERVAL
                    low = int(lanes[0]) // 8
                    high = int(offsets[more]) // 8 if more < len(offsets) else len(bits)
                    decoded.append(book_of().decode(bits[low:high], lanes - lanes[0], min(BLOCK_IDS, n_ids - start)))
                ids = np.concatenate(decoded).astype("<u4")
                ends = np.cumsum(sizes)
                bounds = np.append(0, ends * 4)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
                    None, pa.py_buffer(bounds.astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.record_batch([batch.column("doc_ids")[i].values, pa.array(ends - sizes + before),
                                       pa.array(sizes), raw], schema=schema)

    blocks = spark.read.parquet(f"{path}/blocks")
    # One row for each part of the files; a block knows what comes before it in its part.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = sizes.selectExpr("part", "sum(ids) OVER (ORDER BY part) - ids AS part_before")
    placed = blocks.join(F.broadcast(earlier), "part").withColumn("before", F.col("part_before") + F.col("first"))
    return placed.select("n_ids", "doc_ids", "doc_tokens", "bits", "offsets", "before").mapInArrow(decode, out)


def coded_files(docs: DataFrame, vocabulary_path: str, end_id: int) -> str:
    """Encode ``docs``, write the files into the shared folder and give their path."""
    path = f"{shared_folder(docs.sparkSession)}/huffman-{uuid.uuid4().hex}"
    write(store(encode_documents(docs, vocabulary_path, end_id), "token-ids"), path)
    return path


def checksums(decoded: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read`` gives."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

