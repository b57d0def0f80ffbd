"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import arrowfile, decontam, hamming, lattice, lexical, packing, quality, repair, secrets, sharding, simhash, suffixes, toxicity

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), 24)


def op2_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    leaks = decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.drop("text_key")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents")).drop("text_key")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return arrowfile.token_files(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, folder, "labels")))


def op9_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(table(spark, folder, "embeddings"), 0.93)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), width=4, distance=4)


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


def op12_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return hamming.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_shards, op2_benchmark_leaks, op3_toxicity, op4_suffixes, op5_secrets, op6_token_files, op7_packing]
    found += [op8_quality, op9_lattice, op10_simhash, op11_repair, op12_nearest, op13_ranked_search]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


_RANKED_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM held),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
norm AS (SELECT r, doc_id, 100 - 50 + ((50 * n * docs) // length) AS m FROM held, total),
impact AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS gain FROM tf JOIN weight USING (term) JOIN norm USING (r)),
asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
scored AS (SELECT i, item_id, r, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_ranked_search": _RANKED_SEARCH}
