"""From raw documents to training tokens in five stages, each on all rows the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a table; `run` writes each as Parquet to the shared folder and reads it
back, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskgrid.llm import bpe, langid, mixing, quality, simhash
from riskgrid.llm.common import read_table
from riskgrid.llm.queries import tokenizer_path
from riskgrid.session import materialize, ship_package

KEPT_RUNS = 150_000  # encodings at hand; fewer than op 9 has, since executors come to its stage with grown heaps


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    ship_package(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known, and not surely another than the stated one."""
    ship_package(spark)
    return langid.keep_known(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles 0.8 alike): the smallest doc_id, then a row hash."""
    ship_package(spark)
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    ship_package(spark)
    return mixing.draw(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and decoded of each document of the mix."""
    ship_package(spark)
    return bpe.encode_decode(docs, tokenizer_path(), KEPT_RUNS)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("SimHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

# The classifiers are fitted in numpy and the fingerprints are XXH64: SQL can not say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
