"""Queries that learn models: toxicity, language, language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .langid import languages
from .ngram_lm import lm_scores
from .queries import query
from .toxicity import toxicity_scores


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op10_lm_scores")
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
