"""Feature columns of an e-mail and their assembler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.functions import text as X


def extract_urls(c: Column, rules: X.TextRules = X.TRAINING, lowered: Column | None = None) -> Column:
    """All URLs of a text, punctuation stripped at both ends."""
    found = F.transform(
        F.regexp_extract_all(c, F.lit(rules.url_pattern), F.lit(0)),
        lambda u: F.btrim(u, F.lit(V.URL_EDGE_CHARS)),
    )
    return F.when(X.may_hold_url(c, lowered), found).otherwise(F.array().cast("array<string>"))


def has_defanged_url(c: Column, lowered: Column | None = None) -> Column:
    """One of the marks ``hxxp`` in any letter case, ``[.]`` or ``(.)``."""
    low = F.lower(c) if lowered is None else lowered
    marks = F.contains(low, F.lit("hxxp")) | F.contains(low, F.lit("[.]")) | F.contains(low, F.lit("(.)"))
    return marks.cast("int")


def word_count(c: Column) -> Column:
    """Words of a text with any white space."""
    return F.size(F.filter(F.split(c, f"[{V.WS}]+"), lambda w: w != ""))


def squeezed_word_count(c: Column) -> Column:
    """Words of an already squeezed text: its blanks plus one, without splitting."""
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(c == "", F.lit(0)).otherwise(blanks + 1).cast("int")


def keyword_count(lowered: Column, keywords=V.TRAINING_KEYWORDS) -> Column:
    """How many distinct words of the list occur as substrings of a lower-case text."""
    total = F.lit(0)
    for word in keywords:
        total = total + F.contains(lowered, F.lit(word)).cast("int")
    return total


def detected_keywords(lowered: Column, keywords=V.SERVING_KEYWORDS) -> Column:
    words = F.array(*[F.lit(w) for w in sorted(keywords)])
    return F.filter(words, lambda w: F.contains(lowered, w))


# Frequent characters of mail text, most frequent first. The order only affects speed.
_FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


def entropy(c: Column, digits: int | None = 4) -> Column:
    """Shannon entropy in bits over the characters of a text.

    H = log2(n) - sum(k * log2 k) / n over the counts k of the distinct characters. The frequent letters are removed in
    turn and the bytes lost give their counts; what little they leave is sorted and its runs are counted, so any
    alphabet takes n log n. Rows need no shuffle.
    """
    n = F.length(c).cast("double")

    def weight(acc: Column) -> Column:
        """k * log2(k) of the character removed last."""
        k = (acc["bytes"] - F.octet_length(acc["rest"])) / acc["width"]
        return k * F.log2(F.greatest(k, F.lit(1.0)))

    def remove(acc: Column, ch: Column) -> Column:
        return F.struct(
            F.replace(acc["rest"], ch, F.lit("")).alias("rest"),
            F.octet_length(acc["rest"]).alias("bytes"),
            F.octet_length(ch).alias("width"),
            (acc["total"] + weight(acc)).alias("total"),
        )

    start = F.struct(
        c.alias("rest"), F.octet_length(c).alias("bytes"), F.lit(1).alias("width"), F.lit(0.0).alias("total")
    )
    frequent = F.aggregate(F.array(*[F.lit(ch) for ch in _FREQUENT]), start, remove)

    def run_weight(acc: Column) -> Column:
        return acc["n"] * F.log2(F.greatest(acc["n"], F.lit(1.0)))

    def count(acc: Column, ch: Column) -> Column:
        same = acc["ch"] == ch
        return F.struct(
            ch.alias("ch"), F.when(same, acc["n"] + 1).otherwise(F.lit(1.0)).alias("n"),
            F.when(same, acc["total"]).otherwise(acc["total"] + run_weight(acc)).alias("total"),
        )

    def remaining(acc: Column) -> Column:
        left = F.array_sort(F.filter(F.split(acc["rest"], ""), lambda ch: ch != ""))
        before = F.struct(F.lit("").alias("ch"), F.lit(0.0).alias("n"), (acc["total"] + weight(acc)).alias("total"))
        return F.aggregate(left, before, count, lambda end: end["total"] + run_weight(end))

    bits = F.log2(n) - F.transform(F.array(frequent), remaining)[0] / n
    if digits is not None:
        bits = X.round_even(bits, digits)
    # Rounding errors must not give a negative number or minus zero for one distinct character.
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.greatest(bits, F.lit(0.0)) + F.lit(0.0))


def detect_language(c: Column) -> Column:
    """Language tag by the scripts that occur; texts of plain ASCII need one test only."""
    sinhala, tamil, latin = (F.rlike(c, F.lit(p)) for p in (V.SINHALA, V.TAMIL, V.LATIN))
    return (
        F.when((F.octet_length(c) == F.length(c)) & latin, F.lit("English"))
        .when(sinhala & latin, F.lit("CodeMixed_Sinhala_English"))
        .when(tamil & latin, F.lit("CodeMixed_Tamil_English"))
        .when(sinhala, F.lit("Sinhala"))
        .when(tamil, F.lit("Tamil"))
        .when(latin, F.lit("English"))
        .otherwise(F.lit("Unknown"))
    )


# What counts as a number in text. A cast alone would also take ``NaN``, ``12d`` and ``1.5F``.
_NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def _number(c: Column) -> Column:
    return F.when(F.rlike(c.cast("string"), F.lit(_NUMBER)), c.cast("string").try_cast("double"))


def coerce_double(c: Column) -> Column:
    """The number in a text or number column; what is none, ``NaN`` included, becomes 0."""
    return F.coalesce(_number(c), F.lit(0.0))


def coerce_int(c: Column) -> Column:
    """``'3.0'`` and ``'3.7'`` become 3, unreadable text becomes 0."""
    return F.coalesce(_number(c).try_cast("int"), F.lit(0))


def build_features(df: DataFrame, rules: X.TextRules = X.TRAINING) -> DataFrame:
    """(subject, body) -> cleaned text, URL list and the ten structured features.

    Rows whose subject and body are both blank are dropped. Only stateless column expressions are
    used, so the same function serves batches and streams. Each ``withColumns`` is one projection:
    later steps refer to the columns of earlier ones instead of repeating their work.
    """
    c = F.col
    blank = X.is_blank(c("subject")) & X.is_blank(c("body"))
    masked = (
        df.filter(~blank)
        .withColumns({"subject": X.clean_html(c("subject")), "body": X.clean_html(c("body"))})
        .withColumn("email_text", X.join_text(c("subject"), c("body")))
        .withColumn("_lower", F.lower("email_text"))
        # Subject and body are clean; only a tag that spans both can be left.
        .withColumn(
            "_m1", F.when(F.contains("_lower", F.lit("<")), X.squeeze(X.drop_tags(c("_lower")))).otherwise(c("_lower"))
        )
        .withColumn("_m2", X.mask_addresses(c("_m1")))
        .withColumn("_m3", X.mask_urls(c("_m2"), rules, c("_m2")))
    )
    # These stay in compiled code together; array functions are interpreted and follow in a projection of their own.
    compiled = masked.withColumns(
        {
            # Marks bring blanks, so only marked texts need another squeeze.
            "clean_email_text": F.when(F.contains("_m3", F.lit("<")), X.squeeze(c("_m3"))).otherwise(F.trim("_m3")),
            "has_defanged_url": has_defanged_url(c("email_text"), c("_lower")),
            "text_char_count": F.length("email_text"),
            "text_word_count": squeezed_word_count(c("email_text")),
            "subject_char_count": F.length("subject"),
            "body_char_count": F.length("body"),
            "suspicious_keyword_count": keyword_count(c("_lower"), rules.keywords),
            "detected_language": detect_language(c("email_text")),
        }
    )
    arrays = compiled.withColumns(
        {
            "extracted_urls": extract_urls(c("email_text"), rules, c("_lower")),
            "email_entropy": entropy(c("clean_email_text")),
        }
    )
    return arrays.withColumns(
        {
            "url_count_extracted": F.size("extracted_urls"),
            "has_url": (F.size("extracted_urls") > 0).cast("int"),
        }
    ).drop("_lower", "_m1", "_m2", "_m3")
