"""The corpus operators beside brute force, and on nulls, empties, repeats, ties and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelspark.llm import (
    fm_index, huffman, language_id, line_dedup, linking, near_duplicates, packing, quality_rules, queries, sharding,
    token_counts, tokens, tool_calls,
)

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, id string, shard int, score double"
BASE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeats and columns with the operators' own names."""
    long_text = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000)) + "\n" + BASE
    rows = [(1, BASE, "en", "a"), (2, BASE, "en", None), (3, BASE.replace("word59", "other"), None, "a"), (4, None, "de", "b"),
            (5, "", "de", "b"), (6, " \n\t ", None, None), (7, "a\nb\nb\n", "en", "a"), (None, BASE, "en", "a"),
            (None, None, None, None), (8, long_text, "en", "a"), (8, long_text, "en", "a"), (9, "a <|endoftext|>  b", "en", "b")]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 1, "x", 2, 0.5) for i, t, la, s in rows], COLUMNS).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def texts_of(df):
    return [(row["doc_id"], row["text"]) for row in df.collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_strings(n):
    draw = random.Random(7)
    letters = [*" \n\t ab'sZ9.,!_a", "é", "é", "ß", "²", "\x1c", "\x85", "\xa0", " ", "İ", "Σ",
               "한", "\U0001f600", "'ll", " 's", "<|endoftext|>", "<|startoftext|>", "<|", "aaaa"]
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cut_texts_have_the_librarys_ids(path):
    library, encoder = Tokenizer.from_file(path), tokens.Encoder(tokens.read_vocabulary(path))
    for text, raw in zip(texts := odd_strings(3000), encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    monkeypatch.setattr(tokens, "LONG_TEXT", 50)
    text = "some words, in  a row\nand more " * 20
    encoder = tokens.Encoder(tokens.read_vocabulary(BYTE))
    ids = np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist()
    assert ids == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("table", ["given", "odd", "empty"])
def test_sharding(table, request):
    df = request.getfixturevalue(table)
    got = sharding.interleave(df, 24, 0, bucket_rows=7).collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    assert len(got) == len(rows)
    counts = collections.Counter(r["shard"] for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert not rows or max(counts.values()) - min(counts[i] for i in range(24)) <= 1
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    if table == "given":
        ranks = collections.defaultdict(list)
        for i, _, source in rows:
            ranks["s" + source].append((hashlib.md5(f"0:{i}".encode()).hexdigest(), i))
        along = sorted(((k + 0.5) / len(group), name, order, i) for name, group in ranks.items()
                       for k, (order, i) in enumerate(sorted(group)))
        assert {r["doc_id"]: r["shard"] for r in got} == {row[3]: k * 24 // len(along) for k, row in enumerate(along)}


@pytest.mark.parametrize("table", ["given", "odd", "empty"])
def test_coded_ids_come_back(spark, table, request):
    df, library, start = request.getfixturevalue(table), Tokenizer.from_file(BYTE), 0
    got = huffman.checksums(huffman.read(spark, huffman.coded_files(df, BYTE, 2))).orderBy("start").collect()
    rows = sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    want = collections.Counter()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want[i, len(ids), crc(ids)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


@pytest.mark.parametrize("ids", [[7] * 1000, [3, 9], [0], np.repeat(np.arange(28), [int(1.6 ** i) for i in range(28)])])
def test_code_lengths_fit(ids):
    ids = np.array(ids)
    counts = dict(zip(*(part.tolist() for part in np.unique(ids, return_counts=True)), strict=True))
    bits = huffman.code_lengths(counts, limit=10)
    assert sum(2.0 ** -b for b in bits.values()) <= 1 and max(bits.values()) <= 10
    book = huffman.Codebook(bits)
    raw, offsets = book.encode(ids[:5000])
    assert (book.decode(raw, offsets, len(ids[:5000])) == ids[:5000]).all()


def test_rules_and_ablations(odd, empty):
    ledger = quality_rules.measure(odd)
    words = re.compile(r"[^\x20\x09-\x0D]+")
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                              for r in ledger.collect())
    want = collections.Counter()
    for i, text in texts_of(odd):
        found = words.findall(text or "")
        windows = collections.Counter(tuple(found[k:k + 5]) for k in range(len(found) - 4))
        covered = {k + j for k in range(len(found) - 4) if windows[tuple(found[k:k + 5])] > 1 for j in range(5)}
        lines = [line for line in (text or "").split("\n") if words.search(line)]
        want[i, len(found), sum(map(len, found)), sum((text or "").count(c) for c in "#*$%&|<>"),
             len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want
    rows = {r["rule"]: r for r in quality_rules.ablations(ledger, "v2").collect()}
    bits = [r["failed_bits"] for r in ledger.collect()]
    for n, (rule, _) in enumerate(quality_rules.RULES):
        assert rows[rule]["failed"] == sum(b >> n & 1 for b in bits)
        assert rows[rule]["kept_without"] == sum(b & ~(1 << n) == 0 for b in bits)
        assert rows[rule]["only_this"] == sum(b == 1 << n for b in bits)
    assert quality_rules.measure(empty).count() == 0


def test_tool_calls(spark):
    def say(*calls):
        return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), call, strict=False)) for call in calls]})

    def answer(name, content):
        return json.dumps({"tool_call_id": name, "content": content})

    rows = [(1, 1, "assistant", say(("a", "f", {"y": 2, "x": "s"}), ("b", "f", {"x": 3, "z": 1}, ["a"]))),
            (1, 0, "tool", answer("a", "early")), (1, 2, "tool", answer("b", "late")), (1, 3, "tool", answer("q", "lost")),
            (2, 0, "assistant", say(("a", "g", "no", ["b"]), ("b", "f", {}, ["a"]))), (2, 1, "tool", answer("a", "1")),
            (2, 1, "tool", answer("b", "2")), (None, None, None, None), (3, 1, "assistant", "{bad"),
            (3, 2, "assistant", say(("a", "f", {"x": "1"}), ("a", "f", {"x": "1"})))]
    table = spark.createDataFrame([(*row, "clash") for row in rows], "conv_id long, turn long, role string, text string, status string")
    got = tool_calls.link(table, {"f": {"x": ("string", True), "y": ("integer", False)}}).collect()
    assert len(got) == 13
    by = {(r["conv_id"], r["kind"], r["call_id"], r["pos"]): r for r in got}
    order = [(r["kind"], r["call_id"]) for r in sorted((r for r in got if r["conv_id"] == 1),
                                                       key=lambda r: (r["ready"], r["level"], r["turn"], r["pos"]))]
    assert order == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("result", "q")]
    assert by[1, "call", "a", 0]["json"] == '{"arguments":{"x":"s","y":2},"id":"a","name":"f"}'
    assert by[1, "call", "b", 1]["errors"] == ["type of x", "unknown z"]
    assert by[2, "call", "b", 1]["errors"] == ["missing x"] and by[2, "call", "a", 0]["errors"] == ["not JSON"]
    assert {r["status"] for r in got if r["conv_id"] == 2} == {"cyclic"}
    assert by[1, "result", "q", 0]["status"] == "orphan"
    assert (by[3, "call", "a", 0]["status"], by[3, "call", "a", 1]["status"]) == ("no_result", "repeated")
    assert tool_calls.link_conversations(table.limit(0)).count() == 0


def find(parent, x):
    parent.setdefault(x, x)
    while parent[x] != x:
        x = parent[x]
    return x


def join(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}
    for a, b in links:
        join(parent, a, b)
    got = {r["id"]: r["component"] for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for a, b in links if a != b for x in (a, b)}


def test_groups_of_large_and_small_keys(spark):
    """Every near pair that the check accepts is linked, in keys of more and of fewer items than FEW."""
    draw, rows = random.Random(5), []
    for size in (3, linking.FEW, 2 * linking.FEW, 5 * linking.FEW):
        base = draw.getrandbits(64)
        rows += [base ^ sum(1 << bit for bit in draw.sample(range(64), draw.randint(0, 3))) for _ in range(size)]
    signed = [value - (1 << 64) if value >> 63 else value for value in rows]
    items = spark.createDataFrame([(i, s, 100 if i % 5 else 105) for i, s in enumerate(signed)],
                                  "id long, simhash long, length int")
    got = {r["id"]: r["component"] for r in linking.linked_by_carried(
        line_dedup.block_keys(items), line_dedup.near, line_dedup.meets, lambda pairs: pairs.filter("(a * b) % 7 = 3")).collect()}
    parent: dict = {}
    for b in range(len(rows)):
        for a in range(b):
            if (rows[a] ^ rows[b]).bit_count() <= line_dedup.DISTANCE and a * b % 7 == 3:
                join(parent, b, a)
    groups = collections.defaultdict(set)
    for i in list(parent):
        groups[find(parent, i)].add(i)
    assert got == {i: min(group) for group in groups.values() if len(group) > 1 for i in group}
    assert len(got) > linking.FEW


def test_near_duplicates(spark, odd, empty):
    draw = random.Random(5)
    words = [f"t{i}" for i in range(200)]
    rows = texts_of(odd)
    for i in range(40):  # a group of near copies, each with one stretch of its own
        own = words[:]
        own[(at := draw.randrange(190)):at + draw.randrange(12)] = [f"n{i}"]
        rows.append((100 + i, " ".join(own)))
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component long")
    sets = [(i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else None)
            for i, t in rows]
    parent = {}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                join(parent, i, j)
    got = near_duplicates.kept(near_duplicates.near_duplicates(table)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == find(parent, r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    assert sorted(r["component_id"] or 0 for r in got if r["doc_id"] is None) == [0, 1]
    left = texts_of(near_duplicates.without_near_duplicates(odd))
    assert sorted(i for i, _ in left if i) == [1, 4, 5, 6, 7, 8, 9]
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_bitmaps_turn_no_linked_sets_away(spark):
    """Whatever the sets, linked ones pass; sets that share half of theirs mostly do not."""
    draw = np.random.default_rng(3)
    rows, linked = [], []
    for i in range(2000):
        both = draw.integers(0, 1 << 63, draw.integers(1, 400), np.uint64) * np.uint64(2)
        own = len(both) // 2 if i % 2 else len(both) // 6
        x, y = (np.unique(np.append(both, draw.integers(0, 1 << 63, draw.integers(0, own + 1), np.uint64) * np.uint64(2))) for _ in "xy")
        shared = len(np.intersect1d(x, y))
        linked.append(100 * shared >= 75 * (len(x) + len(y) - shared))
        maps = [near_duplicates.bitmap(one) for one in (x, y)]
        rows.append((i, *((len(one), int(np.bitwise_count(bits.view(np.uint64)).sum()), bits.tolist()) for one, bits in zip((x, y), maps, strict=True))))
    side = "struct<n: long, ones: long, bits: array<long>>"
    pairs = spark.createDataFrame(rows, f"i long, l {side}, r {side}")
    passed = {row["i"] for row in pairs.filter(near_duplicates.near("l", "r")).collect()}
    assert {i for i, one in enumerate(linked) if one} <= passed
    assert sum(linked) > 300 and len(passed) < sum(linked) + 300


@pytest.mark.parametrize("table", ["given", "odd", "empty"])
def test_packing(table, request):
    df, library = request.getfixturevalue(table), Tokenizer.from_file(WORD)
    got = packing.pack_documents(df, WORD, 1, window_tokens=20_000).collect()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == rows[0]["sequence_length"] <= 2048 and at & (at - 1) == 0
    want = collections.Counter()
    for i, text in texts_of(df):
        want[i] += len(library.encode(text or "", add_special_tokens=False).ids) + 1
    total = collections.Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == want
    if table == "given":
        for i, text in texts_of(df):
            ids = library.encode(text, add_special_tokens=False).ids + [1]
            for r in (r for r in got if r["doc_id"] == i):
                assert r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]]) and r["doc_tokens"] == len(ids)


def test_fm_index_finds_every_place():
    draw = np.random.default_rng(0)
    for n, k in ((1, 3), (60, 2), (900, 4)):
        text = draw.integers(0, k + 1, n)
        text[n // 2:] = text[:n - n // 2]
        index = fm_index.FMIndex(text, k)
        for size in (1, 2, 4):
            phrase = draw.integers(1, k + 1, size)
            low, high = index.search(phrase[None, :], np.array([size]))
            want = [i for i in range(n - size + 1) if (text[i:i + size] == phrase).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


@pytest.mark.parametrize("block_bytes", [fm_index.BLOCK_BYTES, 5_000])
def test_contamination(spark, given, odd, block_bytes):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(1000, "Word3 WORD4"), (1001, None), (1002, " ."), (None, "word7")]
    items = spark.createDataFrame([(*row, "x") for row in bench], "item_id long, text string, doc_id string")
    docs = given.select("doc_id", "text").union(odd.select("doc_id", "text"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda text: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    windows = collections.defaultdict(set)
    for item, text in bench:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k:k + 13])].add(item)
    sizes = {len(window) for window in windows}
    want = collections.Counter()
    for i, text in texts_of(docs):
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (owners := windows.get(tuple(w[k:k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= {str(item) for item in owners if item is not None}
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
             0 < len(hit) and 20 * len(hit) >= len(w)] += 1
    got = fm_index.contamination(fm_index.find_spans(docs.dropDuplicates(), items, 13, block_bytes)).collect()
    assert {tuple(r) for r in got} == set(want)


@pytest.mark.parametrize("table", ["given", "odd", "empty"])
def test_token_counts(table, request):
    df, library = request.getfixturevalue(table), Tokenizer.from_file(BYTE)
    got = token_counts.over_limit(token_counts.count_tokens(df, BYTE), 512).collect()
    want = collections.Counter()
    for i, text in texts_of(df):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 512] += 1
    assert collections.Counter(tuple(r) for r in got) == want


def test_merged_counts_are_the_librarys():
    library, counter = Tokenizer.from_file(BYTE), token_counts.Counter(tokens.read_vocabulary(BYTE))
    for text, n in zip(texts := odd_strings(3000), counter.count(texts), strict=True):
        assert n == len(library.encode(text, add_special_tokens=False).ids), text


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in scored if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in scored)
    model = language_id.fit(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, model).collect()}
    assert got[4] == got[5] == got[6] == "und" and got[1] == "en"
    assert language_id.fit(empty).langs == [] and language_id.predict(empty, model).count() == 0
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and {4, 5, 6}.isdisjoint(i for i, _ in texts_of(kept))


def test_language_keeps_every_count(spark):
    """More different words than any cap had left; counts of both languages, hapaxes included."""
    rare = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}q" for i in range(60_000)]
    rows = [(1, " ".join(rare), "en"), (2, "same " * 3 + " ".join(w[::-1] for w in rare[:200]), "fr"), (3, "same " * 7 + "zweié", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    counts = {lang: collections.Counter(language_id.words_of(" ".join(t for _, t, la in rows if la == lang))) for lang in ("en", "fr")}
    words = [*rare, *(w[::-1] for w in rare[:200]), "same", "zweié"]
    whole = {lang: sum(found.values()) + len(found) + 1 for lang, found in counts.items()}
    want = [[np.log((counts[lang][word] + 0.5) / whole[lang]) for lang in ("en", "fr")] for word in words]
    assert np.allclose(model.evidence(words), want, atol=1e-4)
    assert (model.places(0, ["never"]) == -1).all() and model.evidence(["\u4e2d"]).tolist() == [[0, 0]]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark, odd, empty):
    draw = random.Random(2)
    for _ in range(500):
        a, b = ("".join(draw.choice("abé") for _ in range(draw.randint(0, 9))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain_distance(a, b)
    body = " ".join(f"tok{i}" for i in range(80))
    lines = [body, body.upper() + " .", body.replace("tok40", "tak40"), "quite another line of text", "ab cd", "ab cd"]
    rows = texts_of(odd) + [(50 + i, f"head {i} of this text\n{line}") for i, line in enumerate(lines)]
    table = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, line int")
    places = collections.defaultdict(list)
    for i, text in rows:
        for n, found in enumerate(line_dedup.normal_lines(text or "")):
            if i is not None and len(found) >= line_dedup.LEAST_WORDS:
                places[b" ".join(found).decode()].append((i, n))
    normal, hashes, parent = list(places), quality_rules.WordHashes(), {}
    bits = line_dedup.simhashes([x.encode().split() for x in normal], hashes)
    for k, x in enumerate(normal):
        for j, y in enumerate(normal[:k]):
            if (min(len(x.split()), len(y.split())) >= line_dedup.FUZZY_WORDS and max(len(x), len(y)) < 2000
                    and int(bits[k] ^ bits[j]).bit_count() <= 3 and 100 * plain_distance(x, y) <= 10 * max(len(x), len(y))):
                join(parent, k, j)
    groups = collections.defaultdict(set)
    for k, x in enumerate(normal):
        groups[find(parent, k)].update(places[x])
    gone = collections.defaultdict(set)
    for group in groups.values():
        for i, n in sorted(group)[1:]:
            gone[i].add(n)
    got = line_dedup.removals(table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert set(r["removed"]) == (gone[r["doc_id"]] if r["doc_id"] is not None else set()), r["doc_id"]
    left = line_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.filter("doc_id = 2").count() == 0 and left.filter("doc_id IS NULL").count() == 2
    assert line_dedup.removals(empty).count() == 0


def test_line_dedup_folds_unicode_and_takes_15_percent(spark):
    text = "\u201cIt\u2019s here\u201d \u2014 at\u00a0last, \u0663 times\u2026 \u00c9t\u00e9 \u00b2"
    plain = [re.sub(r"[\W_]+", " ", re.sub(r"\d", "0", line.lower())).encode().split() for line in (text, "a_b \u0660")]
    assert line_dedup.normal_lines(text + "\na_b \u0660") == plain
    short = ["we\u2019re all here \u2013 now", "We're all here - now"]
    body = " ".join(f"tok{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)) + " " + "w" * 60
    far = body.replace("w" * 60, "z" * 60)  # one long word of 81, so that few bits of the SimHash differ
    assert 10 < 100 * plain_distance(body, far) / len(body) <= 15
    rows = list(enumerate([*short, body, far]))
    got = {r["doc_id"]: r["removed"] for r in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [], 1: [0], 2: [], 3: [0]}


def test_line_dedup_recall_without_a_gate(spark):
    """Lines with scattered typos and their originals, beside plain edit similarity of all pairs."""
    draw, lines = random.Random(11), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    for i in range(240):
        words = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 8))) for _ in range((8, 14, 25, 50)[i % 4])]
        line = list(" ".join(words))
        lines.append("".join(line))
        for _ in range(1 + (i % 3) * len(line) // 100):
            at = draw.choice([k for k, char in enumerate(line) if char != " "])
            line[at:at + 1] = draw.choice(("", draw.choice(letters), line[at] + draw.choice(letters)))
        lines.append("".join(line))
    near = {(a, b) for b in range(len(lines)) for a in range(b)
            if abs(len(lines[a]) - len(lines[b])) <= 0.15 * len(lines[b]) and (a // 2 == b // 2 or len(lines[b]) < 40)
            and len(lines[b].split()) >= line_dedup.FUZZY_WORDS
            and 100 * plain_distance(lines[a], lines[b]) <= 15 * max(len(lines[a]), len(lines[b]))}
    got = {r["doc_id"] for r in line_dedup.removals(spark.createDataFrame(
        list(enumerate(lines)), "doc_id long, text string")).collect() if r["n_removed"]}
    want = {b for _, b in near}
    assert len(want) > 200 and got <= want
    assert len(got) >= 0.98 * len(want), (len(got), len(want))


def test_pipeline(spark, odd, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0
