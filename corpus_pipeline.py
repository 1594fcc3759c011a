"""The corpus pipeline: documents in, packed training sequences out.

Every stage reads all rows of its input and takes any extra columns along,
whatever their names. Null and empty texts, repeated rows, ties and empty
tables are defined in the docstrings of the operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import exact_dedup, langid, mixing, packing, simhash
from heddle.llm.catalog import vocabulary
from heddle.llm.common import discard, scratch, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; null texts, texts without letters or without a leading language go. Repeated rows stay or go together."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id, null ids last."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the smallest id, null ids last. Texts without words are one component."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: documents left out go, repeated ones come twice, the second time with an id of their own. Null is a source."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces; a null or empty text is a piece of the end id alone."""
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mix_sources", mix), ("best_fit_packing", pack)]

#: SQL can express neither the language model nor the near-duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES in turn to ``documents``; each reads the Parquet files that the one before it wrote."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:  # what the stage stored on its way goes with it
            after = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(after)
        if last is not None:
            discard(last)
        docs = last = after
    return STAGES[-1][1](spark, docs, sf_dir)
