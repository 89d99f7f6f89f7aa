"""Corpus pipeline: quality rules, language, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each as Parquet to a new folder in the shared
space and hands it, read again, to the next. All stages but the last return the columns of ``docs`` as they came.

* ``quality`` drops documents that fail the base rules or are outliers among those of their language and source.
* ``language`` drops documents whose language can't be told (no letters) and sets ``lang`` to the one found.
* ``near_duplicates`` keeps one document of each group, the one with the smallest id, and one row of each id.
* ``personal_data`` puts marks in place of personal data in ``text`` and counts ``n_chars`` anew.
* ``packing`` returns the pieces of the packed windows.

Null ids: such documents are judged by quality, language and personal data like all others and link with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import langid, neardup, packing, pii, quality
from mailsieve.llm.queries import VOCABULARY
from mailsieve.llm.tokens import vocabulary_path
from mailsieve.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs, keep=tuple(docs.columns))
    return judged.filter("kept").select(*(F.col(f"k_{c}").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.label(docs, langid.fit(docs)).filter(F.col("lang") != langid.UNKNOWN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.mask(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Outlier estimates, language model, random field and packing have no SQL form; tests hold the stages to their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
