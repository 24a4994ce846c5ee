"""A corpus from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import ledger, mixing, packing, simhash, toxicity
from tabwright.llm.common import saved, table
from tabwright.llm.queries import tokenizer_path

#: Near copies share this much of their different shingles of five words.
WIDTH, SIMILARITY = 5, 0.8
#: Clean documents are wanted this many times over; those most likely clean have a rate
#: of one at least.
CLEAN_TIMES = 1.1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    labels = table(spark, sf_dir, "labels")
    characters, model = toxicity.train(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    scored = toxicity.score(rows, characters, model)
    return scored.where(F.col("score") < 0.5).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies exactly one row, of the smallest id. Copies are linked
    by their SimHash fingerprints under covering masks, each link checked on the texts'
    shingles, and then by rare shingles where fingerprints are further apart."""
    return simhash.distinct_documents(docs, WIDTH, SIMILARITY)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret replaced by a mark."""
    return ledger.redacted(ledger.scan_corpus(docs)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    return mixing.resampled(docs, table(spark, sf_dir, "labels"), first_times=CLEAN_TIMES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix),
    ("packing", pack),
]
#: No stage can be expressed in SQL as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
