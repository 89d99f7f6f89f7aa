"""Unify corpora: standard columns, filters, de-duplication, running ids, unions and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.functions import features as E
from mailsieve.functions import text as X
from mailsieve.session import materialize

OPTIONAL_COLUMNS = ["sender", "receiver", "date", "urls"]


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(key: Column, mapping: dict) -> Column:
    """Value of a small fixed table; unmatched keys give null."""
    return F.try_element_at(literal_map(mapping), key)


def add_missing_columns(df: DataFrame, columns=OPTIONAL_COLUMNS, default: str = "") -> DataFrame:
    return df.withColumns({c: F.lit(default) for c in columns if c not in df.columns})


def standardize_corpus(
    df: DataFrame, source_dataset: str | Column, category: Column, keep: list[str] = ()
) -> DataFrame:
    """One raw corpus -> the common columns. ``category`` is computed from the raw row (often its label)."""
    source = F.lit(source_dataset) if isinstance(source_dataset, str) else source_dataset
    df = add_missing_columns(df)
    cleaned = df.select(
        *keep,
        source.alias("source_dataset"),
        *[X.clean_basic(F.col(c)).alias(c) for c in ("sender", "receiver", "date", "subject", "body")],
        F.coalesce(F.col("urls").cast("string"), F.lit("0")).alias("urls"),
        F.col("label").cast("string").alias("original_label"),
        category.alias("category"),
    )
    return cleaned.withColumns(
        {
            "email_text": X.join_text(F.col("subject"), F.col("body")),
            "label": lookup(F.col("category"), V.CATEGORY_LABELS),
            "language": F.lit("English"),
        }
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """Nulls of the text and metadata columns get their stand-ins; ``urls`` becomes a number."""
    stand_ins = {
        "subject": "", "body": "",
        "sender": "unknown_sender", "receiver": "unknown_receiver", "date": "unknown_date",
    }
    fills = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in stand_ins.items() if c in df.columns}
    if "urls" in df.columns:
        fills["urls"] = E.coerce_int(F.col("urls"))
    return df.withColumns(fills)


def missing_flags(df: DataFrame) -> DataFrame:
    """0/1 columns that tell which metadata was missing; run after ``fill_missing``."""
    return df.withColumns(
        {f"{c}_missing": (F.col(c) == f"unknown_{c}").cast("int") for c in ("sender", "receiver", "date")}
    )


def repair_features(df: DataFrame, numeric=V.NUMERIC_FEATURES, categorical=V.CATEGORICAL_FEATURES) -> DataFrame:
    """Repair a feature table read from text: absent columns, bad numbers, null class and text."""
    fixes = {c: E.coerce_double(F.col(c)) if c in df.columns else F.lit(0.0) for c in numeric}
    for c in categorical:
        fixes[c] = F.coalesce(F.col(c), F.lit("Unknown")) if c in df.columns else F.lit("Unknown")
    fixes[V.TARGET_COLUMN] = F.coalesce(F.col(V.TARGET_COLUMN), F.lit("Unknown"))
    if V.TEXT_COLUMN in df.columns:
        fixes[V.TEXT_COLUMN] = F.coalesce(F.col(V.TEXT_COLUMN), F.lit(""))
    return df.withColumns(fixes)


# --- filters -------------------------------------------------------------


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.filter(
        ~X.is_blank(F.col("body"))
        & ~X.is_blank(F.col("email_text"))
        & F.col("category").isNotNull()
        & F.col("label").isNotNull()
    )


def drop_service_mail(df: DataFrame, source_dataset: str, phrase: str) -> DataFrame:
    """Rows of one corpus whose subject holds a phrase, in any letter case, are service mail."""
    service = (F.col("source_dataset") == source_dataset) & F.contains(
        F.lower(F.coalesce(F.col("subject"), F.lit(""))), F.lit(phrase.lower())
    )
    return df.filter(~F.coalesce(service, F.lit(False)))


def drop_both_blank(df: DataFrame) -> DataFrame:
    return df.filter(~(X.is_blank(F.col("subject")) & X.is_blank(F.col("body"))))


def only_languages(df: DataFrame, tags=V.CODE_MIXED) -> DataFrame:
    return df.filter(F.col("detected_language").isin(list(tags)))


def with_category(df: DataFrame) -> DataFrame:
    return df.filter(F.col("category").isNotNull())


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first in the given order, whose columns together tell the rows apart.

    Only a digest of the key and the order columns are aggregated, each map task handing on at most one row per key, so
    a text that fills a third of the table is no hot spot. The rows chosen are then picked by their order columns.
    """
    digest = F.sha2(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")), 256)
    first = df.select(digest.alias("_k"), F.struct(*order).alias("_o")).groupBy("_k").agg(F.min("_o").alias("_o"))
    chosen = first.select(*[F.col(f"_o.{c}").alias(f"_{c}") for c in order])
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(chosen[f"_{c}"]) for c in order])
    return df.join(chosen, same, "left_semi")


def duplicate_counts(df: DataFrame, subsets: list[list[str]]) -> DataFrame:
    """(columns, duplicates): rows beyond the first for each set of columns.

    Each row is reduced to one digest per set; counts are combined before the shuffle.
    """

    def digest(cols: list[str]) -> Column:
        # The length in front of each value keeps neighbouring columns apart.
        parts = [
            F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null"))
            for c in cols
        ]
        return F.sha2(F.concat_ws(",", *parts), 256)

    pairs = F.array(
        *[F.struct(F.lit("+".join(cols)).alias("columns"), digest(cols).alias("digest")) for cols in subsets]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("columns", "digest")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("columns")
        .agg(F.sum(F.col("n") - 1).alias("duplicates"))
    )


def add_running_id(
    df: DataFrame, order: list[str], id_column: str = "email_id"
) -> DataFrame:
    """1..n in the order of the given columns, nulls first; every row keeps its place, also where orders repeat.

    Rows are dealt to tasks by ranges, sorted there and written with the number of their task and their place in it; to
    that the counts of all earlier tasks are added. Rows of equal order are dealt by where they lay, so many of them,
    or many nulls, fill several tasks. No task sees the whole table, nothing is joined back, and rows move once.
    """
    rows = df.drop(id_column) if id_column not in order else df
    marked = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = marked.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = materialize(ranged.withColumn("_m", F.monotonically_increasing_id()), "running-ids")
    task, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    # One row for each task.
    counts = dict(placed.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for t in sorted(counts):
        before[t], total = total, total + counts[t]
    offsets = df.sparkSession.createDataFrame(list(before.items()), "_t long, _before long")
    numbered = placed.join(F.broadcast(offsets), task == F.col("_t"))
    return numbered.select(
        (F.col("_before") + place + 1).cast("long").alias(id_column), *[c for c in df.columns if c != id_column]
    )


# --- unions and joins ----------------------------------------------------


def union_aligned(*tables: DataFrame) -> DataFrame:
    """Union by name over the sorted union of all columns; absent ones are null."""
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return joined.select(*sorted(joined.columns))


def with_class_risk(df: DataFrame, category: str = "category") -> DataFrame:
    return df.withColumn("risk", F.coalesce(lookup(F.col(category), V.CLASS_RISK), F.lit(V.DEFAULT_RISK)))


def fuse_branches(embeddings: DataFrame, probabilities: DataFrame, structured: DataFrame, key="email_id") -> DataFrame:
    """(key, embedding), (key, probabilities), (key, structured) -> (key, fusion): arrays one after the other.

    A key that a branch lacks is an error, as it would be for branches of different lengths.
    """
    parts = ("embedding", "probabilities", "structured")
    joined = embeddings.join(probabilities, key, "full_outer").join(structured, key, "full_outer")
    message = F.concat(
        F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" is missing in: "),
        F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in parts]),
    )
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in parts])
    fusion = F.concat(*[F.col(c).cast("array<double>") for c in parts])
    return joined.select(key, F.when(whole, fusion).otherwise(F.raise_error(message).cast("array<double>")).alias("fusion"))


def check_alignment(left: DataFrame, right: DataFrame, key="email_id", value="label") -> DataFrame:
    """One row of counts: matches, differing values, keys missing on either side."""
    both = left.select(key, F.col(value).alias("_l"), F.lit(1).alias("_in_l")).join(
        right.select(key, F.col(value).alias("_r"), F.lit(1).alias("_in_r")), key, "full_outer"
    )
    matched = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    same = F.col("_l").eqNullSafe(F.col("_r"))
    return both.agg(
        F.count_if(matched & same).alias("matching"),
        F.count_if(matched & ~same).alias("different"),
        F.count_if(F.col("_in_l").isNull()).alias("missing_left"),
        F.count_if(F.col("_in_r").isNull()).alias("missing_right"),
    )


def split_summary(df: DataFrame, splits=("train", "validation", "test")) -> DataFrame:
    """Rows of each class in each split, gaps as zero, and the total."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in splits]
    out = df.groupBy("category").agg(*counts)
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(s) for s in splits]))


def split_shares(summary: DataFrame, splits=("train", "validation", "test")) -> DataFrame:
    return summary.select(
        "category", *[X.round_even(F.col(s) / F.col("total") * F.lit(100.0), 2).alias(s) for s in splits]
    )


def remainder(df: DataFrame, taken: DataFrame, key="email_id") -> DataFrame:
    return df.join(taken.select(key), key, "left_anti")
