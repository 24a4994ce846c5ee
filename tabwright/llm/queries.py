"""Registered queries of the operators, one each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import (
    infill,
    ledger,
    mixing,
    neighbours,
    packing,
    rules,
    sharding,
    simhash,
    tokenfile,
    toxicity,
    urls,
    warc,
    whitening,
)
from tabwright.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest_rows(sharding.sharded(table(spark, sf_dir, "documents")))


def mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest_rows(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.digest_rows(packing.pack(documents, tokenizer_path("word_bpe_49k.json")))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    read = tokenfile.written_and_read(documents, tokenizer_path("byte_bpe_50k.json"))
    return tokenfile.digest_rows(read)


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return ledger.digest_rows(ledger.scan_corpus(documents.select("doc_id", "text")))


def infilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest_rows(infill.fill_in_middle(table(spark, sf_dir, "documents")))


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest_rows(warc.archived(table(spark, sf_dir, "pages")))


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


#: Name to (query, SQL); SQL can express none of them.
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_quality_rules": (quality_rules, None),
    "op2_nearest_neighbours": (nearest_neighbours, None),
    "op3_shards": (shards, None),
    "op4_mixing_rates": (mixing_rates, None),
    "op5_near_duplicates": (near_duplicates, None),
    "op6_packed_documents": (packed_documents, None),
    "op7_token_files": (token_files, None),
    "op8_url_verdicts": (url_verdicts, None),
    "op9_toxicity_scores": (toxicity_scores, None),
    "op10_secret_scan": (secret_scan, None),
    "op11_fill_in_middle": (infilled, None),
    "op12_web_archives": (archived_pages, None),
    "op13_whitened_embeddings": (whitened_embeddings, None),
}
