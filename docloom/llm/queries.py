"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, decontam, pii_mask, quality_rules, secret_scan, simhash_dedup, token_count, token_store, toxicity, url_filter
from .common import scratch, table

#: A deployment passes its own; pseudonyms differ with it.
PII_KEY = "docloom-demonstration-key"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("_row", "spans"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.block_list(spark))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents"))))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_mask.digests(pii_mask.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digests(simhash_dedup.classes(table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.digests(quality_rules.judge(docs, rules, "doc_id"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), where)
    return token_store.digests(token_store.read(spark, where))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = toxicity.word_sets(table(spark, sf_dir, "documents"))
    return toxicity.score_sets(sets, toxicity.fit_sets(sets, table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_url_filter, op3_decontamination, op4_bpe_codec, op5_pii, op6_simhash, op7_quality_rules, op8_token_store, op9_token_counts, op10_toxicity, pipeline)
}
