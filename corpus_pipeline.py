"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all
but the last return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet in the shared folder and reads it again, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import linededup, mixing, packing, quality, simhash
from quern.llm._shared import drop_shared, write_shared


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go.

    Every row is scored by itself, repeats alike; null and empty texts by the model's constant.
    Columns of any name stay as they are; an empty table gives an empty one, and without labels all stays.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the document of the largest id only.

    ``n_chars``, where there is one, follows a text that loses lines.  Null and empty texts, rows
    without an id and all other columns, whatever their names, stay as they are; an empty table gives an empty one.
    """
    return linededup.keep_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (Jaccard similarity of 0.8 of their 5-word shingles) that of the smallest id stays.

    Null, empty and blank texts are copies of each other; rows that repeat an id are one
    document; rows without an id stay; an empty table gives an empty one.
    """
    return simhash.keep_one(docs, find=simhash.similar_documents)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut, or repeated, to their target weights.

    Texts without words (null, empty or blank) go, as they can't add to a target; a null source is a
    source; rows that repeat an id are taken alike; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document with their ids, packed into sequences of 2048.

    Null and empty texts are the id 0 alone; longer texts are cut; repeated rows are packed
    each; an empty table gives an empty one.
    """
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("near-duplicate dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express a trained classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            drop_shared(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
