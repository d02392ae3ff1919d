"""The queries of the text operators over the tables, with their production parameters."""

from __future__ import annotations

import secrets as random
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, decontaminate, language, licenses, minhash, pii, secrets, simhash, token_counts, toxicity

def tokenizer_path(name: str) -> str:
    return str(public_tokenizers.path(name))


def surrogate_key(spark: SparkSession) -> str:
    """The key that the session names in ``spark.tidewater.pii.key``; a session that names none
    gets one of its own, which nobody can compute."""
    key = spark.conf.get("spark.tidewater.pii.key", None)
    if not key:
        key = random.token_hex(32)
        spark.conf.set("spark.tidewater.pii.key", key)
    return key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op5_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_report(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache that outlives the query if ``spark.tidewater.tokens.cache`` names its folder."""
    cache = spark.conf.get("spark.tidewater.tokens.cache", None)
    return token_counts.report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), cache_path=cache)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), surrogate_key(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_bpe_roundtrip,
        op2_simhash_near_dedup,
        op3_license_scan,
        op4_language_id,
        op5_minhash_fingerprints,
        op6_secret_scan,
        op7_toxicity,
        op8_token_counts,
        op9_decontamination,
        op10_pii_surrogates,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Windows of items and of documents as joined words; a short item is held against runs of its own length.
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT item, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS s
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
x AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT DISTINCT x.doc_id, x.k, x.n, p.item FROM x JOIN p ON p.s = x.s AND p.n = x.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": OP9_SQL}
