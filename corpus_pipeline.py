"""From raw documents to packed training sequences: five operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result to the shared folder and reads it back as the next one's docs.

Defined cases: a null text is an empty one; texts without a letter are of no known
language, so they go in the second stage; rows without an id are no copies of each
other; equal rows stay or go together, but near-dedup keeps one of them; texts of
any length are read whole; empty tables pass through; columns beside those of
documents are left behind, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefold.llm import langid, mixing, packing, simhash, toxicity
from rolefold.llm.common import crc_mod, saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score puts at one half or above go; all rows with their id go with them."""
    lexicon, model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.keep(docs, lexicon, model).select(*COLUMNS)


def unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go."""
    model = langid.fit(docs, crc_mod("doc_id", 5) != 0)
    return langid.keep(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles alike by 0.8 or more) stays, the one with the smallest id."""
    return simhash.keep_one_similar(docs).select(*COLUMNS)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' blocks as often as the mixture takes them; n_chars follows the text."""
    mixed = mixing.mix_documents(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("language_id", unknown_languages),
    ("near_dedup", near_duplicates),
    ("source_mixing", source_mixture),
    ("packing", packed_sequences),
]

#: The stages learn models, so their rows have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
