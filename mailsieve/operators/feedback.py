"""Reviewer verdicts: validation, enrichment, reading back, training candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.functions import text as X

FEATURES_KEPT = [
    "detected_language", "url_count_extracted", "has_url", "has_defanged_url", "suspicious_keyword_count",
    "email_entropy", "clean_email_text",
]


def rejection_reason(blank: Column | None = None) -> Column:
    """Null for acceptable verdicts. The status is case sensitive. ``blank`` tells of an empty e-mail; by default its texts do."""
    if blank is None:
        blank = X.is_blank(F.col("subject")) & X.is_blank(F.col("body"))
    status, category = F.col("feedback_status"), F.col("correct_category")
    return (
        F.when(
            ~F.coalesce(status.isin("Correct", "Wrong"), F.lit(False)), F.lit("status must be Correct or Wrong")
        )
        .when(~F.coalesce(category.isin(V.CLASSES), F.lit(False)), F.lit("unknown category"))
        .when(blank, F.lit("empty e-mail"))
    )


def validate(verdicts: DataFrame) -> DataFrame:
    """Add ``rejected`` with the reason, null for accepted rows."""
    return verdicts.withColumn("rejected", rejection_reason())


def accepted(verdicts: DataFrame, blank: Column | None = None) -> DataFrame:
    return verdicts.filter(rejection_reason(blank).isNull())


def judged_verdicts(verdicts: DataFrame, scored: DataFrame, key="email_id", blank: Column | None = None) -> DataFrame:
    """Every verdict with the prediction and features of its e-mail, and ``rejected``: why it can't be used, else null.

    A verdict whose e-mail has no score is rejected too. ``scored`` has one row per e-mail, so the verdict side may be
    skewed without multiplying rows; adaptive execution splits a hot key. With a flag ``blank`` the verdicts need no
    texts, and no second pass over them.
    """
    kept = scored.select(
        key,
        F.lit(True).alias("_scored"),
        F.col("prediction").alias("predicted_category"),
        F.col("confidence").alias("prediction_confidence"),
        F.col("branch_prediction").alias("xgboost_prediction"),
        F.col("branch_confidence").alias("xgboost_confidence"),
        *FEATURES_KEPT,
    )
    reason = F.coalesce(F.col("_reason"), F.when(F.col("_scored").isNull(), F.lit("unknown e-mail")))
    joined = verdicts.withColumn("_reason", rejection_reason(blank)).join(kept, key, "left")
    return joined.withColumn("rejected", reason).drop("_reason", "_scored")


def enrich(verdicts: DataFrame, scored: DataFrame, key="email_id", blank: Column | None = None) -> DataFrame:
    """The accepted ones of ``judged_verdicts``."""
    return judged_verdicts(verdicts, scored, key, blank).filter(F.col("rejected").isNull()).drop("rejected")


def for_export(stored: DataFrame) -> DataFrame:
    """Newest first; null texts become empty."""
    texts = [f.name for f in stored.schema.fields if f.dataType.simpleString() == "string"]
    return stored.na.fill("", texts).orderBy(F.desc("id"))


def training_candidates(stored: DataFrame) -> DataFrame:
    """(clean_email_text, category): the verdict's class, else the prediction; the latest verdict per text wins.

    Digests of the texts are aggregated with map-side combine, so a text reviewed very often is no hot spot; the text
    itself is fetched for the latest ids, which are unique.
    """
    category = F.coalesce(F.col("correct_category"), F.col("predicted_category"))
    digest = F.sha2(F.coalesce(F.concat(F.lit("="), F.col("clean_email_text")), F.lit("null")), 256)
    latest = stored.groupBy(digest.alias("_k")).agg(F.max("id").alias("id")).select("id")
    return stored.join(latest, "id", "left_semi").select("clean_email_text", category.alias("category"))
