"""The registered queries of this package: each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import (
    fm_index, huffman, katz, language_id, line_dedup, near_duplicates, packing, periodic_runs, quality_rules, ranked_search,
    sharding, token_counts, tool_calls,
)
from panelspark.llm.common import table

SHARDS = 24
SHUFFLE_SEED = 0
TOKEN_LIMIT = 512
TOP = 10


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.interleave(docs, SHARDS, SHUFFLE_SEED).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = huffman.coded_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return huffman.checksums(huffman.read(spark, path))


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.measure(table(spark, sf_dir, "documents"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.fails("base").alias("base_failed"), (~quality_rules.fails("v2")).alias("kept"),
        "n_lines", "failed_bits")


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_conversations(table(spark, sf_dir, "conversations"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.kept(near_duplicates.near_duplicates(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return fm_index.contamination(fm_index.find_spans(docs, benchmark, window=13))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.over_limit(counted, TOKEN_LIMIT)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.predict(docs, model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removals(table(spark, sf_dir, "documents"))


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_repeated_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.find_runs(docs))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked_search.search(docs, benchmark, TOP)


#: ``[^ \t-\r]+`` as words; windows are compared as joined words.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lines.n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND word_chars > 20 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND 100 * n_symbols > 60 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END) AS bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed,
       bits = 0 AS kept, n_lines, bits::BIGINT AS failed_bits
FROM b
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), q AS (
  SELECT item, item_id, term, count(*) AS repeats FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
  GROUP BY item, item_id, term
), size AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d
), p AS (
  SELECT doc_id, doc, n, term, count(*) AS tf FROM (
    SELECT doc_id, doc, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, doc, n, term
), w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, size GROUP BY term, n_docs
), s AS (
  SELECT item, item_id, doc_id, doc, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (
           100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), size GROUP BY item, item_id, doc_id, doc
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 10
"""

QUERIES = {query.__name__: query for query in (
    op1_sharding, op2_huffman_ids, op3_rule_ledger, op4_tool_calls, op5_near_duplicates, op6_packing,
    op7_decontamination, op8_token_counts, op9_language_id, op10_line_dedup, op11_katz, op12_periodic_runs,
    op13_ranked_search)}

ORACLES = {"op3_rule_ledger": OP3_SQL, "op13_ranked_search": OP13_SQL}
