"""A corpus from raw documents: language, near-duplicates, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkframe.llm import language, mixing, packing, simhash
from inkframe.llm.common import new_folder

#: Least mean probability of the language named; below it a document is in none of the learned ones.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; without letters, or too uncertain, they go. Null ids are judged by text alone.

    A document is named by id and text, so rows of equal id but other text are judged apart.
    """
    net = language.fit(docs)
    return language.keep_known(docs, net, LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: that of the smallest id; rows of equal id but other text are judged apart."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated or left out so that sources have their target weights, in globally random order.

    A null source is a source; rows of one id get the same number of copies each, and those without an id one common draw. Texts
    aren't looked at. No documents give none.
    """
    return mixing.mix_sources(docs).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, copies included, packed into sequences of 2048 tokens. A null or empty text is the end id alone; a text of any
    length is cut into pieces; rows without an id are documents too. No documents give no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", identify_language), ("simhash", drop_near_copies), ("mix", mix), ("pack", pack)]

#: Language, fingerprints and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
