"""From raw documents to packed training sequences: every stage reads the table that the one before has written.

The result is not expressible in SQL: the first stage fits a network. tests/llm holds the stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import shared_dir, table
from tidewire.llm.line_dedup import dedup_rows
from tidewire.llm.mixing import mix_rows
from tidewire.llm.packing import pack_documents
from tidewire.llm.quality import THRESHOLD, fit_quality
from tidewire.llm.queries import tokenizer_path
from tidewire.llm.simhash import near_rows

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts are scored as empty; rows that repeat an id are scored each."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.score_column(F.col("text").cast("string"), spark) >= THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that came earlier in the corpus, copies or near copies; a text may become empty, a null one stays null.

    Rows that repeat an id (or have none) are documents of their own. n_chars is counted anew.
    """
    rows = dedup_rows(docs).withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*[(F.col(c) if c in ("text", "n_chars") else F.col("doc")[c]).alias(c) for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, one with the smallest id. Texts without words are one group; a row with a
    repeated id goes only if its own text is a near copy."""
    return near_rows(docs).where("first").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose token shares follow the target weights; every row is drawn for itself by its own cell."""
    return mix_rows(docs).where("kept").select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence. Null and empty texts are one piece with the end token."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. An empty table of documents gives an empty result."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
