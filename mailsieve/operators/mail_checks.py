"""Header, authentication and attachment checks over tables of parsed mail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.functions import headers as H


def parse_addresses(df: DataFrame) -> DataFrame:
    """Add address, display name and domain columns for From, Reply-To, Return-Path and Message-ID."""
    named = df.withColumns(
        {
            "from_address": H.address_of(F.col("from_header")),
            "from_display_name": H.display_name_of(F.col("from_header")),
            "reply_to_address": H.address_of(F.col("reply_to_header")),
            "return_path_address": H.address_of(F.col("return_path_header")),
        }
    )
    return named.withColumns(
        {
            "from_domain": H.domain_of_address(F.col("from_address")),
            "reply_to_domain": H.domain_of_address(F.col("reply_to_address")),
            "return_path_domain": H.domain_of_address(F.col("return_path_address")),
            "message_id_domain": H.domain_of_message_id(F.col("message_id")),
        }
    )


def domain_mismatches(df: DataFrame) -> DataFrame:
    """0/1 columns; run after ``parse_addresses``."""
    own = F.col("from_domain")
    return df.withColumns(
        {
            "from_replyto_mismatch": H.differs(own, F.col("reply_to_domain")),
            "from_returnpath_mismatch": H.differs(own, F.col("return_path_domain")),
            "message_id_domain_mismatch": H.differs(own, F.col("message_id_domain")),
        }
    )


def authentication(df: DataFrame) -> DataFrame:
    auth = F.col("authentication_results")
    return df.withColumns(
        {
            "spf": H.spf_result(auth, F.col("received_spf")),
            "dkim": H.auth_result(auth, "dkim"),
            "dmarc": H.auth_result(auth, "dmarc"),
        }
    )


def assess_attachments(attachments: DataFrame) -> DataFrame:
    """One row per attachment with extension, risk and warnings."""
    name = F.coalesce(F.col("filename"), F.lit(""))
    return attachments.withColumns(
        {
            "extension": H.file_extension(name),
            "risk": H.attachment_risk(name),
            "warnings": H.attachment_warnings(name),
            "filename": F.when(name == "", F.lit("unnamed_attachment")).otherwise(name),
        }
    )


def attachment_summary(attachments: DataFrame, key="email_id") -> DataFrame:
    """Count, points and flags per e-mail; partial sums are taken before the shuffle."""
    extension = H.file_extension(F.col("filename"))
    rated = attachments.select(
        key,
        H.attachment_points(H.attachment_risk(F.col("filename"))).alias("points"),
        extension.isin(V.EXECUTABLE_EXTENSIONS).cast("int").alias("executable"),
        extension.isin(V.MACRO_EXTENSIONS).cast("int").alias("macro"),
    )
    return rated.groupBy(key).agg(
        F.count(F.lit(1)).alias("attachment_count"),
        F.sum("points").alias("attachment_points"),
        F.max("executable").alias("has_executable_attachment"),
        F.max("macro").alias("has_macro_attachment"),
    )


def security_features(headers: DataFrame, attachments: DataFrame, key="email_id") -> DataFrame:
    """Mismatch flags, attachment count and flags of each e-mail."""
    checked = domain_mismatches(parse_addresses(headers)).select(
        key, "from_replyto_mismatch", "from_returnpath_mismatch", "message_id_domain_mismatch"
    )
    joined = checked.join(attachment_summary(attachments, key).drop("attachment_points"), key, "left")
    return joined.na.fill(
        0, ["attachment_count", "has_executable_attachment", "has_macro_attachment"]
    )


def add_header_risk(checked: DataFrame) -> DataFrame:
    """Add score, level and warnings to rows with mismatch flags, authentication and attachment points.

    Points and sentences are fixed values.
    """
    c = F.col
    rules = [
        (c("from_replyto_mismatch") == 1, 1, F.lit("The From and Reply-To domains do not match.")),
        (c("from_returnpath_mismatch") == 1, 1, F.lit("The From and Return-Path domains do not match.")),
        (c("message_id_domain_mismatch") == 1, 1, F.lit("The Message-ID domain does not match the From domain.")),
        (H.spf_bad(c("spf")), 2, F.concat(F.lit("SPF authentication result is "), c("spf"), F.lit("."))),
        (H.signature_bad(c("dkim")), 2, F.concat(F.lit("DKIM authentication result is "), c("dkim"), F.lit("."))),
        (H.signature_bad(c("dmarc")), 2, F.concat(F.lit("DMARC authentication result is "), c("dmarc"), F.lit("."))),
        (
            (F.coalesce(c("authentication_results"), F.lit("")) == "")
            & (F.coalesce(c("received_spf"), F.lit("")) == ""),
            0,
            F.lit("No SPF, DKIM, or DMARC result was found in the visible headers."),
        ),
    ]
    points = [F.when(test, F.lit(p)).otherwise(F.lit(0)) for test, p, _ in rules if p]
    scored = checked.withColumns(
        {
            "header_risk_score": (reduce(lambda a, b: a + b, points) + c("attachment_points")).cast("int"),
            "warnings": F.array_compact(F.array(*[F.when(test, text) for test, _, text in rules])),
        }
    )
    return scored.withColumn("header_risk", H.header_risk_level(c("header_risk_score")))


def header_risk(headers: DataFrame, attachments: DataFrame, key="email_id") -> DataFrame:
    """Risk of each e-mail from its headers and its attachment table."""
    checked = authentication(domain_mismatches(parse_addresses(headers)))
    joined = checked.join(attachment_summary(attachments, key), key, "left").na.fill(
        0,
        ["attachment_count", "attachment_points", "has_executable_attachment", "has_macro_attachment"],
    )
    return add_header_risk(joined)
