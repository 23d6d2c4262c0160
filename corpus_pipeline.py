"""From raw documents to token ids: quality rules, near-duplicates, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the
shared folder and reads it again as the next one's docs. All but the last return docs' columns.

In every stage: a null text counts as empty and comes out null; texts of any length are read whole; rows
that are equal share a decision; further columns, whatever their names, are returned as they are; an
empty table gives an empty table with the same columns. doc_id must be a number or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe_codec, decontam, quality_rules, secret_scan, simhash_dedup
from docloom.llm.common import clear, discard, mark, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep; null and empty texts have too few words. Repeated rows all stay or all go."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked fingerprints (4-word shingles, 4 bits, as in op6): that with the smallest doc_id.

    Of rows that are equal one stays; null ids come last, and among them the smallest hash of the text stays; empty texts are one class."""
    return simhash_dedup.first_of_class(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: less than one word in 20 is in an item's window. Texts without words stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with a placeholder for every secret (one for overlapping ones), and n_chars counted anew."""
    return secret_scan.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, repeated ones too; an empty text has no ids and decodes to no bytes."""
    return bpe_codec.digests(bpe_codec.encode_decode(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("secrets", secrets), ("encoding", encoding)]

#: The learned rules, fingerprints and merges can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = mark()
        after = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, since, [after])  # what the stage alone has stored
        if name != STAGES[0][0]:
            discard(docs)  # the stage before is read no more
        docs = after
    return docs
