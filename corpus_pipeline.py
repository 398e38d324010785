"""From raw documents to a training mix: toxic texts, repeated lines, near copies and benchmark passages go, then sources are mixed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatekit.llm import toxicity
from gatekit.llm.common import shared_folder, table
from gatekit.llm.decontam import bounded, without_leaks
from gatekit.llm.line_dedup import dedup_lines
from gatekit.llm.mixing import taken_words
from gatekit.llm.near_dup import near_duplicates

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC. Null and empty texts have no terms and stay, null ids too."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, machine, docs.columns, name="__score")
    return scored.where(F.col("__score") < TOXIC).drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat; n_chars follows the text. A null text becomes empty."""
    kept = dedup_lines(docs).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies. Null ids and empty texts are nobody's copy and stay."""
    copies = near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(bounded(copies, otherwise="shuffle_hash"), docs["doc_id"] == F.col("__copy"), "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes from each document that is left."""
    return taken_words(docs.select("doc_id", "text", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
]

#: The learned stage has no SQL; the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. Between stages the documents are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
