"""The queries of the training-data operators, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.bpe import round_trip
from galley.llm.decontamination import contaminations
from galley.llm.lm import score_documents
from galley.llm.packing import pack
from galley.llm.prefix_trie import conversation_trie
from galley.llm.quality import QUALITY_SQL, quality
from galley.llm.simhash import simhash_groups
from galley.llm.spelling import spelling_variants
from galley.llm.substring import kept_digest, remove_repeats
from galley.llm.token_counts import token_counts
from galley.llm.toxicity import toxicity
from galley.llm.url_filters import judge_urls
from galley.llm.warc import read_archives, write_archives

BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"
TOXIC_FROM = 0.3
#: (host, path, verdict)
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=1, capacity=2048)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary(PIECE_BPE), limit=4096)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(_table(spark, sf_dir, "pages"))
    return read_archives(manifest, with_payload=False).drop("url")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=TOXIC_FROM)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(_table(spark, sf_dir, "documents"), length=20)
    return cleaned.select("doc_id", "n_words", "n_removed", kept_digest(F.col("kept_text")).alias("kept_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), held_out=2, parts=7)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return contaminations(documents, benchmark, seed=5, threshold=0.6)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), one_in=97, least_letters=5, least_n=3, ratio=2)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"), group=20, heads=4)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_url_filters": op7_url_filters,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

_HOST = r"CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = r"CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END"
URL_SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(rule) for rule in URL_RULES)}),
p AS (SELECT row_number() OVER () AS r, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
fit AS (SELECT r, rule_host || rule_path AS rule, verdict FROM p JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fit GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (r)"""

#: The others have no SQL: tokenizers, compressed archives, learned models and iterations are not SQL.
ORACLE = {"op5_quality_rules": QUALITY_SQL, "op7_url_filters": URL_SQL}

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, body, CASE WHEN strlen(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS keeper FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM g"""
ORACLE["op4_warc"] = WARC_SQL
