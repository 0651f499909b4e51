"""Operators on workers that have no copy of the package, and a language model of bounded size."""

from __future__ import annotations

import os
import subprocess
import sys
import weakref

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import common, fm_index, language_id, tokens

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.append({repo!r})  # the driver's alone: workers start elsewhere and are not told
from panelspark.testing import local_session
from panelspark.llm import queries
spark = local_session(cores="2", memory="2g")

def seen(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("panelspark") is not None]}})

assert not spark.range(1).mapInArrow(seen, "found boolean").first()["found"]
for name in {names!r}:
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("names", [["op2_huffman_ids", "op7_decontamination"], ["op9_language_id", "op12_periodic_runs"]])
def test_workers_without_the_package(tmp_path, names):
    script = SCRIPT.format(repo=REPO, names=names)
    env = {key: value for key, value in os.environ.items() if key != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split() for line in done.stdout.splitlines()] == [[name, "200"] for name in names]


@pytest.fixture(scope="module")
def spoken(spark):
    lines = {"en": "the house and the garden of the old town", "fr": "la maison et le jardin de la vieille ville"}
    rows = [(i, f"{line} {i % 7}", lang, "x") for i in range(60) for lang, line in lines.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_junk_is_rejected_and_texts_stay(spark, spoken):
    rows = [(1, "zzqx wvkj qqqq xjxj"), (2, "123 456 q"), (3, "The garden"), (4, "the hquxz"), (5, None), (6, ""), (7, "la ville"),
            (7, "la ville"), (None, "the town"), (None, "##### 12")]
    docs = spark.createDataFrame([(i, text, None, "x") for i, text in rows], spoken.schema)
    kept = language_id.keep_identified(docs, language_id.fit(spoken))
    assert sorted((row["doc_id"] or 0, row["text"]) for row in kept.collect()) == [
        (0, "the town"), (3, "The garden"), (4, "the hquxz"), (7, "la ville"), (7, "la ville")]
    assert kept.columns == docs.columns


def test_sample_is_bounded_and_even(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"),
        F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 2 == 0, "a").when(F.col("id") % 2 == 1, "b").alias("lang"))
    drawn = {row["lang"]: row["count"] for row in language_id.sample(docs, 3000).groupBy("lang").count().collect()}
    assert drawn["rare"] == 200 and all(850 < drawn[lang] < 1150 for lang in "ab")
    again = language_id.sample(docs.repartition(3), 3000)
    assert again.count() == sum(drawn.values())


def test_ties_between_languages_go_by_name(spark):
    docs = spark.createDataFrame([(1, "x y", "b"), (2, "x y", "a")], "doc_id long, text string, lang string")
    got = language_id.predict(docs, language_id.fit(docs)).collect()
    assert [(row["lang_pred"], row["score"]) for row in got] == [("a", 0.5), ("a", 0.5)]


def test_item_ids_with_commas_over_several_blocks(spark):
    docs = spark.createDataFrame([(1, "p q r s"), (1, "p q r s"), (2, "u v"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a,b", "q r s"), ("c", "u v"), ("d,", "q r")], "item_id string, text string")
    want = {(1, 4, 3, 2), (2, 2, 2, 1), (3, 0, 0, 0)}
    digests = set()
    for block_bytes in (1 << 20, 4):
        spans = fm_index.find_spans(docs, items, 3, block_bytes)
        got = [tuple(row) for row in fm_index.contamination(spans).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect()]
        assert len(got) == 4 and {row[:4] for row in got} == want
        digests.add(frozenset(row[4] for row in got))
    assert len(digests) == 1


def test_a_worker_keeps_one_thing():
    """Before, the scorers of earlier runs and the encoders of other steps stayed in a worker for good."""
    class Thing:
        pass

    first = common.kept_by_worker("first", Thing)
    assert common.kept_by_worker("first", Thing) is first
    gone = weakref.ref(first)
    del first
    common.kept_by_worker("second", Thing)
    assert gone() is None
    common.kept_by_worker("none", lambda: None)


def test_words_met_again_stay_known(monkeypatch):
    """Before, a full table was cleared, and the most frequent words went to the library again."""
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 40)
    vocabulary = tokens.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, library = tokens.Encoder(vocabulary), Tokenizer.from_str(vocabulary)
    asked = []
    plain = encoder._library
    encoder._library = lambda texts: asked.extend(texts) or plain(texts)
    for i in range(60):
        texts = [f"a frequent word, {i}abc{i} x{i}\nnew, and{i}  two\t", "", " ", "\n", "a \n b", "its frequent\0word<|endoftext|> x", "\n\nword\n"]
        for text, raw in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(raw, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(" frequent" in text and "endoftext" not in text for text in asked) == 1
