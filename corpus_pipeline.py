"""Documents to packed training sequences, in five stages that each keep or arrange rows of the one before.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fixity_spark.llm import exact, langid, mixing, ngram_join, packing
from fixity_spark.llm.common import Scratch

#: A text whose language is hardly likelier than any other is rejected, as is one of no language: the share that its
#: score has above chance, whatever the number of languages. Even short clean texts have more.
LEAST_MARGIN = 1 / 15


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the labels name; texts without letters and texts of no clear language go.

    Each row is judged alone, whether or not its id is null or repeated. Where no language is known, all go.
    """
    return langid.keep_clear(docs, ~langid.held_out(), LEAST_MARGIN)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8: the one with the smallest doc_id."""
    return ngram_join.keep_one_of_each(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix of sources takes them, up to three times."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the bin and the place in it that each is packed to."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mix_sources", mix_to_weights),
    ("pack_best_fit", pack_sequences),
]

#: Language and packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.tidy()
    return STAGES[-1][1](spark, docs, sf_dir)
