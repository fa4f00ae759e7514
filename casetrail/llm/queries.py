"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.llm import (
    bpe,
    contamination,
    conversations,
    fim,
    langid,
    licenses,
    ngram_join,
    ppm,
    quality,
    sharding,
    token_counts,
    toxicity,
    url_filter,
)
from casetrail.llm.common import fold, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# Fixed values of the URL contract.
RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    found = toxicity.score_toxicity(docs, docs, labels, ~held_out, keep={"held_out": held_out})
    return found.select("doc_id", "held_out", "score", "predicted")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    host, path = url_filter.host_and_path(F.col("url"))
    files = pages.select("page_id", F.concat(host, path).alias("path"), "html")
    found = licenses.scan_licenses(files, "page_id", "path", "html")
    return found.withColumnRenamed("doc_id", "page_id")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    found = langid.identify(docs, docs.filter(~held_out), keep={"held_out": held_out})
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digest(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_ids=False))


def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm.score_texts(docs, fold(F.col("doc_id"), 7) == 2, order=5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, TOKENIZER, public_tokenizers.PATTERN)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination.digest(contamination.decontaminate(docs, items))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_bytes(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair(rows, F.col("live"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_licenses, op3_ngram_join, op4_byte_bpe, op5_quality_rules, op6_ppm_scores,
    op7_language_id, op8_token_counts, op9_decontamination, op10_url_filter,
    op11_sharding, op12_fill_in_middle, op13_conversation_repair,
)}
ORACLES: dict[str, str] = {
    "op3_ngram_join": ngram_join.SQL,
    "op5_quality_rules": quality.SQL,
    "op9_decontamination": contamination.SQL,
    "op11_sharding": sharding.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_conversation_repair": conversations.SQL,
}
