"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept, and returns the columns of documents; the last adds what the mix
takes of each document.  Rows with null or empty texts go with the language stage, which finds no language in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, langid, mixing, pii, similar
from lodestone.llm.common import packed, saved, unpacked

#: Documents that fit the languages they are labelled with less than this are rejected.
MIN_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a word in a learned script, or unlike all learned languages, go."""
    model = langid.train(langid.training_rows(docs))
    found = packed(docs, langid.language(model, F.col("text"), docs).alias("__language"))
    return unpacked(found.filter((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= MIN_LANGUAGE_SCORE)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return similar.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; of the others, the passages that benchmark items hold go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; every document stays."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that stays: documents of which it takes nothing go."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mix", mix),
]

#: Language models, groups of near duplicates and sampling keys are not expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
