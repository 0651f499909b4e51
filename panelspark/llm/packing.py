"""Documents packed into sequences of several lengths, without padding.

Every sequence is as long as a tier of TIERS, or another power of two at the end of a
partition.  A document of more than the longest tier gives full sequences of its own; its
rest, like every shorter document, goes to the shortest tier that holds it.  Each tier is
packed from the longest document on, and the gap behind a document is filled with whole
documents of shorter tiers, largest first, and at last with a cut of one, whose rest goes
back to its tier.  Sequences of one tier are then dealt into step groups of equal tokens.

A partition is packed by itself, a window of WINDOW_TOKENS at a time: nothing is shuffled,
and a lost task packs again what it packed before.

Nulls, empties and odd input: a null or empty text gives the end id alone; repeated rows
are packed one by one; an empty table gives an empty table; of the input's columns only
doc_id and text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import arrow_schema, slices
from panelspark.llm.tokens import shared_encoder

TIERS = (256, 512, 1024, 2048)

#: Tokens that are packed together.
WINDOW_TOKENS = 1 << 21

#: Tokens of a step group.
STEP_TOKENS = 1 << 14

#: Sequence ids of a partition start at its number times this.
SEQUENCES_A_PART = 1 << 32

OUT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
       "sequence_length long, step_group long")

Piece = tuple[int, int, int]  # length, document, start


class Packer:
    """Packs (length, document, start) pieces; ``full`` takes each finished sequence with its length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.waiting: dict[int, list[Piece]] = {tier: [] for tier in tiers}
        self.done: list[tuple[int, list[Piece]]] = []

    def add(self, document: int, length: int) -> None:
        longest = self.tiers[-1]
        start = 0
        while length - start >= longest:
            self.done.append((longest, [(longest, document, start)]))
            start += longest
        self._route((length - start, document, start))

    def _route(self, piece: Piece) -> None:
        if piece[0]:
            tier = next(tier for tier in self.tiers if piece[0] <= tier)
            insort(self.waiting[tier], piece)

    def _fill(self, gap: int, below: tuple[int, ...]) -> list[Piece]:
        """Whole pieces of the tiers ``below``, then a cut; may leave a gap if they run dry."""
        got: list[Piece] = []
        for tier in reversed(below):
            waiting = self.waiting[tier]
            while gap and (at := bisect_right(waiting, (gap, 1 << 62, 0))):
                got.append(waiting.pop(at - 1))
                gap -= got[-1][0]
        for tier in below:
            if gap and (waiting := self.waiting[tier]):
                length, document, start = waiting.pop()
                got.append((gap, document, start))
                self._route((length - gap, document, start + gap))
                return got
        return got

    def pack(self) -> None:
        """Turn what waits into full sequences; the rest, shorter than a tier each, waits on."""
        for n in range(len(self.tiers) - 1, -1, -1):
            tier, waiting = self.tiers[n], self.waiting[self.tiers[n]]
            while waiting:
                first = waiting.pop()
                row = [first, *self._fill(tier - first[0], self.tiers[:n + 1])]
                if sum(piece[0] for piece in row) < tier:
                    for piece in row:
                        insort(waiting, piece)
                    break
                self.done.append((tier, row))

    def finish(self) -> None:
        """All that waits in a row, cut into powers of two from the longest tier down."""
        self.pack()
        rest = [piece for tier in reversed(self.tiers) for piece in self.waiting[tier]]
        left = sum(piece[0] for piece in rest)
        rest.reverse()
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            row, gap = [], size
            while gap:
                length, document, start = rest.pop()
                row.append((min(length, gap), document, start))
                if length > gap:
                    rest.append((length - gap, document, start + gap))
                gap -= row[-1][0]
            self.done.append((size, row))
            left -= size
        self.waiting = {tier: [] for tier in self.tiers}

    def take(self) -> list[tuple[int, list[Piece]]]:
        taken, self.done = self.done, []
        return taken


class Steps:
    """Step groups of one partition: a group takes sequences of one tier until its tokens are full."""

    def __init__(self, tokens: int):
        self.tokens, self.next, self.open = tokens, 0, {}

    def place(self, length: int) -> int:
        group, held = self.open.get(length, (None, 0))
        if group is None:
            group, self.next = self.next, self.next + 1
        held += length
        self.open[length] = (None, 0) if held >= self.tokens else (group, held)
        return group


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int, tiers: tuple[int, ...] = TIERS,
                   window_tokens: int = WINDOW_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""
    encoder_of = shared_encoder(docs.sparkSession, vocabulary_path)
    schema = arrow_schema(OUT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of()
        base = TaskContext.get().partitionId() * SEQUENCES_A_PART
        packer, steps = Packer(tiers), Steps(step_tokens)
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        n_docs = n_sequences = new_tokens = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal n_sequences, held
            out: list[tuple] = []
            for length, row in packer.take():
                offset, group = 0, base + steps.place(length)
                for size, document, start in row:
                    doc_id, ids = held[document]
                    crc = zlib.crc32(ids[start:start + size].astype("<u4").tobytes())
                    out.append((doc_id, start, size, crc, len(ids), base + n_sequences, offset, length, group))
                    offset += size
                n_sequences += 1
            waits = {piece[1] for waiting in packer.waiting.values() for piece in waiting}
            held = {document: held[document] for document in waits}
            if out:
                columns = zip(*out, strict=True)
                yield pa.record_batch([pa.array(column, field.type) for column, field in
                                       zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in slices(batch, "text"):
                texts = [text or "" for text in part.column("text").to_pylist()]
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids = np.append(np.frombuffer(raw, encoder.dtype), encoder.dtype.type(end_id))
                    held[n_docs] = (doc_id, ids)
                    packer.add(n_docs, len(ids))
                    n_docs += 1
                    new_tokens += len(ids)
                if new_tokens >= window_tokens:
                    packer.pack()
                    yield from rows()
                    new_tokens = 0
        packer.finish()
        yield from rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, OUT)
