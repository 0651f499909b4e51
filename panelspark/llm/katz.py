"""Katz back-off language model: counted, discounted and evaluated in partitioned tables.

The texts are cut into blocks of about BLOCK_BYTES and stored once as token numbers.  For each
order a block asks for its different n-grams, packed into one row for each part of the order's
table, so that counting and looking up are one shuffle there and one back: a part adds up the
training counts of all blocks, numbers its n-grams, sums up its contexts, and answers each block in
the order in which it asked.  The answers are stored by order and part.  Evaluating a token goes
from the unigram up: where its n-gram was seen the discounted relative frequency holds, where only
its context was seen the probability one order lower times the context's back-off weight, and
otherwise the probability one order lower itself.

Good-Turing: counts up to CUTOFF are discounted by the numbers of n-grams with each count; where these
give no ratio between 0 and 1 for every count, the discount is half a count.  A context without
a discounted count gives away one count more than it has.  The back-off weight is what the seen words
leave, over what the order below leaves for the others, summed over all seen words of the context: the
probabilities of all words known and of the one unknown word add up to 1 after any context.

Contexts that hold more than a fair share of the training tokens are dealt over several parts by the
word behind them, and their sums come from all of these.  Every n-gram counts; none is cut off.
Words are known by a 64-bit hash, n-grams by exact numbers.

Nulls, empties and odd input: a null or empty text is its end alone; rows without a doc_id are held
out; repeated rows count and are scored one by one; without training documents the one unknown word
has probability 1; an empty table gives an empty table; of the input's columns only doc_id and
text are read.  A text is held whole in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import slices, store

ORDER = 2

#: Counts from here on are taken as they are.
CUTOFF = 5

#: Text of a block, and of a part of the tables, about.
BLOCK_BYTES = 6 << 20
PART_BYTES = 12 << 20

#: One document in so many is held out.
HELD_OUT = 10

#: Numbers of n-grams: 0 was never seen in training, 1 is the begin of a text.
UNSEEN, BEGIN, FIRST = 0, 1, 2

BLOCKS = ("block long, doc_ids array<long>, held array<boolean>, sizes array<long>, tokens binary, places binary, "
          "part_sizes binary, words binary, word_counts binary")
ASKED = "part int, block long, contexts binary, sizes binary, words binary, lower binary, grams binary, counts binary"
ANSWERS = "order int, part int, block long, ids binary, counts binary, contexts binary, hist array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on, or doubles, in few bytes."""
    import zstandard

    kind = "f8" if values.dtype.kind == "f" else f"u{next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)}"
    planes = np.ascontiguousarray(values.astype(f"<{kind}")).view(np.uint8).reshape(-1, int(kind[1])).T
    return kind.encode() + zstandard.compress(planes.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    """What ``pack`` was given, as int64 or float64."""
    import zstandard

    kind = raw[:2].decode()
    planes = np.frombuffer(zstandard.decompress(raw[2:]), np.uint8).reshape(int(kind[1]), -1)
    values = np.ascontiguousarray(planes.T).view(f"<{kind}").reshape(-1)
    return values if kind == "f8" else values.astype(np.int64)


def pack_rising(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def mixed(values: np.ndarray) -> np.ndarray:
    """Numbers without order from numbers in a row."""
    out = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (out ^ (out >> np.uint64(29))) >> np.uint64(8)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % HELD_OUT == 0


def discounts(hist: list[int]) -> np.ndarray:
    """The share of a count that stays, for counts 0 to CUTOFF and those above; ``hist``: n-grams with counts 1 to CUTOFF + 1."""
    out = np.ones(CUTOFF + 2)
    r = np.arange(1, CUTOFF + 1)
    out[r] = (r - 0.5) / r
    if all(n > 0 for n in hist):
        n = np.array(hist, np.float64)
        last = (CUTOFF + 1) * n[CUTOFF] / n[0]
        if last < 1:
            got = ((r + 1) * n[1:] / n[:-1] / r - last) / (1 - last)
            if ((got > 0) & (got < 1)).all():
                out[r] = got
    return out


def left_over(discount: np.ndarray, totals: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts are divided by, and the share for what was not seen; ``few``: n-grams with counts 1 to CUTOFF."""
    mass = few @ ((1 - discount[1:CUTOFF + 1]) * np.arange(1, CUTOFF + 1))
    none = mass <= 0
    totals = totals + none
    return totals, np.where(none, 1.0, mass) / totals


def encode_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """BLOCKS: the token numbers of whole documents, and the block's words by their part."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                        ("sizes", pa.list_(pa.int64())), *[(name, pa.binary()) for name in (
                            "tokens", "places", "part_sizes", "words", "word_counts")]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33

        def flush(number: int, ids: list, texts: list[np.ndarray], words: list[bytes]) -> pa.RecordBatch:
            held = np.array([is_held_out(doc_id) for doc_id in ids], bool)
            sizes = np.array([len(one) for one in texts], np.int64)
            tokens = np.concatenate(texts)
            train = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
            keys = np.fromiter((xxhash.xxh64_intdigest(word) or 1 for word in words), np.uint64, len(words))
            keys[0] = 0  # the end
            part = (keys % np.uint64(parts)).astype(np.int64)
            by = np.lexsort((keys, part))
            often = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
            rank, place = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            rank[often], place[by] = np.arange(len(words)), np.arange(len(words))
            bounds = np.searchsorted(part[by], np.arange(parts + 1))
            packed = b"".join(len(raw).to_bytes(4, "little") + raw for raw in (
                pack_rising(keys[by][low:high]) for low, high in zip(bounds[:-1], bounds[1:], strict=True)))
            return pa.record_batch([[first + number], [ids], [held.tolist()], [sizes.tolist()], [pack(rank[tokens])],
                                    [pack(place[often])], [pack(np.diff(bounds))], [packed], [pack(train[by])]], schema=schema)

        def fresh() -> tuple[list, list, dict, int]:
            words: dict[bytes | None, int] = defaultdict(count().__next__)
            words[None]  # noqa: B018  the end has number 0
            return [], [], words, 0

        number = 0
        ids, texts, words, held_bytes = fresh()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    spelt = raw.lower().split()
                    numbers = np.zeros(len(spelt) + 1, np.int32)
                    numbers[:-1] = np.fromiter(map(words.__getitem__, spelt), np.int32, len(spelt))
                    ids.append(doc_id)
                    texts.append(numbers)
                    held_bytes += len(raw)
                    if held_bytes >= BLOCK_BYTES:
                        yield flush(number, ids, texts, [b"", *list(words)[1:]])
                        number += 1
                        ids, texts, words, held_bytes = fresh()
        if ids:
            yield flush(number, ids, texts, [b"", *list(words)[1:]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, BLOCKS)


def _each(table: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(table.column(name).to_pylist() for name in names), strict=True))


_ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), *[(name, pa.binary()) for name in (
    "contexts", "sizes", "words", "lower", "grams", "counts")]])


def ask_words(blocks: DataFrame) -> DataFrame:
    """ASKED of order 1: the block's words of each part, with their training counts."""
    schema = _ASKED

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, words, counts in _each(batch, "block", "part_sizes", "words", "word_counts"):
                sizes, counts = unpack(sizes), unpack(counts)
                rows, at, done = [], 0, 0
                for part, size in enumerate(sizes.tolist()):
                    width = int.from_bytes(words[at:at + 4], "little")
                    if size:
                        rows.append((part, words[at + 4:at + 4 + width], pack(counts[done:done + size])))
                    at, done = at + 4 + width, done + size
                yield pa.RecordBatch.from_pylist([{"part": part, "block": block, "words": words, "counts": counts}
                                                  for part, words, counts in rows], schema=schema)

    return blocks.select("block", "part_sizes", "words", "word_counts").mapInArrow(ask, ASKED)


_ANSWERS = pa.schema([("order", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()),
                      ("counts", pa.binary()), ("contexts", pa.binary()), ("hist", pa.list_(pa.int64()))])


def _numbers(totals: np.ndarray, part: int, parts: int) -> np.ndarray:
    """A number for each seen n-gram of a part, small for frequent ones."""
    rank = np.empty(len(totals), np.int64)
    rank[np.argsort(-totals, kind="stable")] = np.arange(len(totals))
    return np.where(totals > 0, rank * parts + part + FIRST, UNSEEN)


def _histogram(totals: np.ndarray) -> list[int]:
    """N-grams with counts 1 to CUTOFF + 1, all of them, and their counts."""
    return [*np.bincount(np.minimum(totals, CUTOFF + 2), minlength=CUTOFF + 3)[1:CUTOFF + 2].tolist(),
            int((totals > 0).sum()), int(totals.sum())]


def answer_words(asked: DataFrame, parts: int) -> DataFrame:
    """ANSWERS of order 1, and one row without a block for each part."""
    def answer(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        blocks, words, counts = zip(*_each(table, "block", "words", "counts"), strict=True)
        keys = [unpack_rising(raw).view(np.uint64) for raw in words]
        sizes = [len(one) for one in keys]
        at = np.unique(np.concatenate(keys), return_inverse=True)[1]
        totals = np.bincount(at, np.concatenate([unpack(raw) for raw in counts])).astype(np.int64)
        ids, ends = _numbers(totals, part, parts), np.cumsum(sizes)[:-1]
        rows = [(1, part, block, pack(ids[one]), pack(totals[one]), None, None)
                for block, one in zip(blocks, np.split(at, ends), strict=True)]
        rows.append((1, part, None, None, None, None, _histogram(totals)))
        return pa.table([list(column) for column in zip(*rows, strict=True)], schema=_ANSWERS)

    return asked.groupBy("part").applyInArrow(answer, ANSWERS)


def seen_share(hist: list[int], counts: np.ndarray) -> np.ndarray:
    """The unigram probability of words with these training counts, above 0."""
    discount = discounts(hist[:CUTOFF + 1])
    total, _ = left_over(discount, np.array([hist[-1]]), np.array([hist[:CUTOFF]], np.float64))
    return discount[np.minimum(counts, CUTOFF + 1)] * counts / total[0]


def answer_grams(asked: DataFrame, order: int, parts: int, last: bool, words_hist: list[int]) -> DataFrame:
    """ANSWERS of a higher order; ``contexts`` has the sums of each context that was asked for."""
    def answer(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = _each(table, "block", "contexts", "sizes", "words", "lower", "grams", "counts")
        contexts = [unpack_rising(row[1]) for row in rows]
        sizes = [unpack(row[2]) for row in rows]
        every, where = np.unique(np.concatenate(contexts), return_inverse=True)
        owner = np.repeat(where, np.concatenate(sizes))
        grams = [unpack(row[5]) for row in rows]
        words = np.concatenate([unpack_rising(row[3])[at] for row, at in zip(rows, grams, strict=True)])
        lower = np.concatenate([unpack(row[4])[at] for row, at in zip(rows, grams, strict=True)])
        counts = np.concatenate([unpack(row[6]) for row in rows])
        if order == 2:  # words come with their counts, which take less room than their probabilities
            lower = seen_share(words_hist, lower)
        by = np.lexsort((words, owner))
        new = np.append(True, (owner[by][1:] != owner[by][:-1]) | (words[by][1:] != words[by][:-1])) if len(by) else by > 0
        at = np.empty(len(by), np.int64)
        at[by] = np.cumsum(new) - 1
        totals = np.bincount(at, counts).astype(np.int64) if len(by) else np.zeros(0, np.int64)
        owner, lower = owner[by][new], lower[by][new] * (totals > 0)
        sums = [np.bincount(owner, totals, len(every)).astype(np.int64)]
        sums += [np.bincount(owner, totals == r, len(every)).astype(np.int64) for r in range(1, CUTOFF + 1)]
        sums.append(np.bincount(owner, lower, len(every)))
        ids = np.zeros(len(totals), np.int64) if last else _numbers(totals, part, parts)
        out, done, seen = [], 0, 0
        for row, context, size in zip(rows, contexts, sizes, strict=True):
            own, seen = at[seen:seen + int(size.sum())], seen + int(size.sum())
            mine, done = where[done:done + len(context)], done + len(context)
            packed = b"".join(len(raw).to_bytes(4, "little") + raw for raw in (pack(one[mine]) for one in sums))
            out.append((order, part, row[0], pack(ids[own]), pack(totals[own]), packed, None))
        out.append((order, part, None, None, None, None, _histogram(totals)))
        return pa.table([list(column) for column in zip(*out, strict=True)], schema=_ANSWERS)

    return asked.groupBy("part").applyInArrow(answer, ANSWERS)


def _unpack_sums(raw: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(raw):
        width = int.from_bytes(raw[at:at + 4], "little")
        out.append(unpack(raw[at + 4:at + 4 + width]).astype(np.float64))
        at += 4 + width
    return np.array(out)


class _Asked:
    """The n-grams of a block of one order, in the order in which the parts are asked for them."""

    def __init__(self, level: _Level, local: np.ndarray, width: int, train: np.ndarray, parts: int, n_train: int):
        known = level.context != UNSEEN
        self.contexts, first, of_known = np.unique(level.context[known], return_index=True, return_inverse=True)
        times = level.context_count[known][first]
        salts = np.where(times * parts <= n_train, 1, np.minimum(parts, -(-2 * times * parts // max(1, n_train))))
        base = (mixed(self.contexts) % np.uint64(parts)).astype(np.int64)
        self.of_token = np.full(len(local), -1)
        self.of_token[known] = of_known

        self.asked = known & (level.number != UNSEEN)
        key = self.of_token[self.asked] * width + local[self.asked]
        _, first, gram = np.unique(key, return_index=True, return_inverse=True)
        context, words = self.of_token[self.asked][first], level.number[self.asked][first]
        counts = np.bincount(gram, train[self.asked]).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        part = (base[context] + (mixed(words) % salts[context].astype(np.uint64)).astype(np.int64)) % parts
        by = np.lexsort((words, context, part))
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.arange(len(by))
        self.place = self.place[gram]
        self.words, self.counts, self.lower = words[by], counts[by], level.sent[self.asked][first][by]

        entry = np.repeat(np.arange(len(self.contexts)), salts)
        nth = np.arange(len(entry)) - np.repeat(np.cumsum(salts) - salts, salts)
        entry_part = (base[entry] + nth) % parts
        order = np.lexsort((entry, entry_part))
        self.entry, self.entry_part = entry[order], entry_part[order]
        n = max(1, len(self.contexts))
        at = np.searchsorted(self.entry_part * n + self.entry, part[by] * n + context[by])
        self.sizes = np.bincount(at, minlength=len(self.entry))

    def rows(self, block: int) -> list[tuple]:
        ends = np.cumsum(self.sizes)
        out = []
        starts = np.flatnonzero(np.diff(self.entry_part, prepend=-1))
        for low, high in zip(starts, np.append(starts[1:], len(self.entry)), strict=True):
            a, b = (ends[low - 1] if low else 0), ends[high - 1]
            words, first, grams = np.unique(self.words[a:b], return_index=True, return_inverse=True)
            out.append((int(self.entry_part[low]), block, pack_rising(self.contexts[self.entry[low:high]]),
                        pack(self.sizes[low:high]), pack_rising(words), pack(self.lower[a:b][first]), pack(grams),
                        pack(self.counts[a:b])))
        return out


class _Level:
    """What is known of each token at one order: probability, number, and the context for the next order.

    ``sent`` is what the next order's parts work the probability out from.
    """

    def __init__(self, p: np.ndarray, sent: np.ndarray, number: np.ndarray, times: np.ndarray, starts: np.ndarray, n_docs: int):
        self.p, self.sent, self.number = p, sent, number
        self.context = np.append(BEGIN, number[:-1])
        self.context_count = np.append(n_docs, times[:-1])
        # A text begins behind the begin; at higher orders too, as nothing is seen before it.
        self.context[starts] = BEGIN
        self.context_count[starts] = n_docs


class _Block:
    """A block's tokens, taken through the orders that have been answered."""

    def __init__(self, row: dict, answers: pa.Table, model: dict):
        self.row, self.model = row, model
        by_order: dict[int, list[dict]] = defaultdict(list)
        for answer in sorted(answers.to_pylist(), key=lambda answer: answer["part"]):
            by_order[answer["order"]].append(answer)
        local = unpack(row["tokens"])
        ids = np.concatenate([unpack(one["ids"]) for one in by_order[1]])
        counts = np.concatenate([unpack(one["counts"]) for one in by_order[1]])
        places = unpack(row["places"])
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held = np.array(row["held"], bool)
        self.train = np.repeat(~self.held, self.sizes)
        self.word, self.count = ids[places][local], counts[places][local]
        self.local, self.width = local, len(places)
        hist = model["hist"][1]
        self.n_train, self.n_types = hist[-1], hist[-2]
        unknown = left_over(discounts(hist[:CUTOFF + 1]), np.array([self.n_train]), np.array([hist[:CUTOFF]], np.float64))[1]
        p = np.where(self.count > 0, seen_share(hist, self.count), unknown[0])
        self.level = _Level(p, self.count, self.word, self.count, self.starts, model["n_docs"])
        for order in range(2, model["answered"] + 1):
            self.level = self._next(self.asked(), by_order[order], discounts(model["hist"][order][:CUTOFF + 1]))

    def asked(self) -> _Asked:
        return _Asked(self.level, self.local, self.width, self.train, self.model["parts"], self.n_train)

    def _next(self, asked: _Asked, answers: list[dict], discount: np.ndarray) -> _Level:
        low, size = self.level.p, len(self.word)
        number, times = np.zeros(size, np.int64), np.zeros(size, np.int64)
        p = low.copy()
        if len(asked.contexts):
            number[asked.asked] = np.concatenate([unpack(one["ids"]) for one in answers])[asked.place]
            times[asked.asked] = np.concatenate([unpack(one["counts"]) for one in answers])[asked.place]
            each = np.concatenate([_unpack_sums(one["contexts"]) for one in answers], axis=1)
            sums = np.array([np.bincount(asked.entry, row, len(asked.contexts)) for row in each])
            total, free = left_over(discount, sums[0], sums[1:CUTOFF + 1].T)
            weight = free / np.maximum(1 - sums[-1], np.finfo(np.float64).tiny)
            known = asked.of_token >= 0
            context, n = asked.of_token[known], times[known]
            p[known] = np.where(n > 0, discount[np.minimum(n, CUTOFF + 1)] * n / total[context], weight[context] * low[known])
        return _Level(p, p, number, times, self.starts, self.model["n_docs"])

    def scores(self) -> pa.Table:
        base = np.log10((self.count + 0.1) / (self.n_train + 0.1 * (self.n_types + 1)))
        add = lambda values: np.add.reduceat(values, self.starts)
        return pa.table([pa.array(self.row["doc_ids"], pa.int64()), pa.array(self.held), pa.array(self.sizes),
                         pa.array(add((self.count > 0).astype(np.int64))),
                         pa.array(np.full(len(self.sizes), self.n_train, np.int64)), pa.array(add(base)),
                         pa.array(add(np.log10(self.level.p)))], names=[part.split()[0] for part in SCORES.split(", ")])


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """SCORES of every whole text by the model of all documents that are not held out."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    blocks = store(encode_blocks(docs, parts), "blocks")
    held = F.expr("aggregate(held, 0L, (n, x) -> n + if(x, 0L, 1L))")
    model = {"parts": parts, "n_docs": blocks.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0], "hist": {}, "answered": 0}
    answers: DataFrame | None = None
    tokens = blocks.drop("words", "word_counts", "part_sizes")

    def met(function, schema: str) -> DataFrame:
        """``function`` of each block and all its answers so far."""
        known = dict(model, hist=dict(model["hist"]))

        def call(row: pa.Table, got: pa.Table) -> pa.Table:
            return function(_Block(row.to_pylist()[0], got, known))

        return tokens.groupBy("block").cogroup(
            answers.filter("block IS NOT NULL").drop("hist").groupBy("block")).applyInArrow(call, schema)

    for k in range(1, order + 1):
        if k == 1:
            got = answer_words(ask_words(blocks), parts)
        else:

            def ask(block: _Block) -> pa.Table:
                rows = block.asked().rows(block.row["block"])
                return pa.Table.from_pylist([dict(zip(_ASKED.names, row, strict=True)) for row in rows], schema=_ASKED)

            got = answer_grams(met(ask, ASKED), k, parts, k == order, model["hist"][1])
        got = store(got, f"ngrams-{k}")
        hist = [F.coalesce(F.sum(F.col("hist")[i]), F.lit(0)).alias(f"h{i}") for i in range(CUTOFF + 3)]
        model["hist"][k] = list(got.filter("block IS NULL").agg(*hist).first())  # one row
        model["answered"] = k
        answers = got if answers is None else answers.unionByName(got)
    return met(lambda block: block.scores(), SCORES)
