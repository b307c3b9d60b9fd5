"""The corpus pipeline: STAGES applied to ``documents`` in order, each stage's result written
as Parquet and read again as the next one's input.

1. language ID: documents without a language (null text, no letter) go;
2. n-gram Jaccard join: of each class of near duplicates the first document stays;
3. suffix-array dedup: bytes of 100-byte strings that also start earlier are cut out;
4. secret scans: secrets are replaced by a mark;
5. best-fit packing: the result's rows (see ``packing.pack``).

Stages 1 to 4 return the columns of ``documents``.  No part of this is SQL: the language model,
the chosen paths and the tokeniser are tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbflow.llm import jaccard, langid, packing, secrets, substrings
from ebbflow.llm.common import is_remainder, stored, table
from ebbflow.llm.vocab import public_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learned from the labelled documents outside the held-out fold."""
    return langid.keep_identified(docs, langid.fit(docs.filter(~is_remainder("doc_id", 4, 2))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
