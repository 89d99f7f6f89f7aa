"""Data profiles: counts, shares, missing values and distributions by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.text import round_even
from mailsieve.operators.bounded import broadcast_bounded
from mailsieve.session import materialize

PROFILED = [
    "url_count_extracted", "has_url", "has_defanged_url", "text_char_count", "text_word_count",
    "suspicious_keyword_count", "email_entropy",
]


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def class_distribution(df: DataFrame, column: str = "category") -> DataFrame:
    """Count and percentage per value."""
    counts = value_counts(df, column)
    # One row per class, so the window is small.
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percentage", round_even(F.col("count") / total * F.lit(100.0), 2))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) for columns with nulls, most first; one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    return (
        counts.select(F.inline(pairs)).filter("nulls > 0").orderBy(F.desc("nulls"), "column")
    )


def _histogram(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(group, column, value, rows) of all columns in one pass.

    Statistics then work on distinct values, not on rows, and large groups shrink before the shuffle.
    Rows without a group are left out.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return (
        df.select(by, F.inline(pairs))
        .filter(F.col("value").isNotNull() & F.col(by).isNotNull())
        .groupBy(by, "column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


#: Cells between the smallest and largest value of a group; the values of one cell are sorted together.
CELLS = 4096


def _quantiles(histogram: DataFrame, by: str, shares: dict[str, float]) -> DataFrame:
    """(group, column, one column per share): exact linear quantiles of a histogram.

    A group is no unit of work: its values fall into cells between minimum and maximum, running counts over the cells
    tell which cells hold the wanted ranks, and only the values of those are put in order, each cell by itself.
    """
    place = [by, "column"]
    limits = histogram.groupBy(*place).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.sum("rows").alias("_n"))
    limits = broadcast_bounded(limits)  # one row for each class and column
    share = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    cell = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1))
    celled = histogram.join(limits, place).select(*place, "value", "rows", "_n", cell.alias("_cell"))
    counts = celled.groupBy(*place, "_n", "_cell").agg(F.sum("rows").alias("_rows"))
    upto = Window.partitionBy(*place).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # CELLS rows at most
    position = lambda p: F.lit(p) * (F.col("_n") - 1)
    ranks = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(side).alias("side"), cut(position(p)).cast("long").alias("rank"), (position(p) - F.floor(position(p))).alias("part"))
            for n, p in shares.items() for side, cut in (("low", F.floor), ("high", F.ceil))
        ]
    )
    wanted = (
        counts.withColumn("_before", F.sum("_rows").over(upto) - F.col("_rows")).select("*", F.explode(ranks).alias("r"))
        .filter((F.col("_before") <= F.col("r.rank")) & (F.col("r.rank") < F.col("_before") + F.col("_rows")))
        .select(*place, "_cell", F.col("r.name").alias("_name"), F.col("r.side").alias("_side"), F.col("r.part").alias("_part"), (F.col("r.rank") - F.col("_before")).alias("_rank"))
    )
    wanted = broadcast_bounded(wanted)  # two rows for each class, column and share
    within = Window.partitionBy(*place, "_cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ordered = celled.join(wanted.select(*place, "_cell").distinct(), [*place, "_cell"], "left_semi").withColumn("_upto", F.sum("rows").over(within))
    found = ordered.join(wanted, [*place, "_cell"]).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("rows")))

    def value(name: str) -> Column:
        low, high = (F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col("value"))) for side in ("low", "high"))
        part = F.max(F.when(F.col("_name") == name, F.col("_part")))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return found.groupBy(*place).agg(*[value(n).alias(n) for n in shares])


def describe_by(df: DataFrame, columns: list[str], by: str = "category") -> DataFrame:
    """(group, column, count, mean, std, min, q25, q50, q75, max), two digits; std of a sample."""
    histogram, place = materialize(_histogram(df, by, columns), "histogram"), [by, "column"]
    total = F.sum("rows")
    sums = histogram.groupBy(*place).agg(
        total.alias("count"), (F.sum(F.col("value") * F.col("rows")) / total).alias("_mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    sums = broadcast_bounded(sums)  # one row for each class and column
    # Distances from the mean are squared in a second step: sums of squares would lose digits.
    squares = histogram.join(sums.select(*place, "_mean"), place).groupBy(*place).agg(
        F.sum(F.col("rows") * F.pow(F.col("value") - F.col("_mean"), F.lit(2))).alias("_squares")
    )
    quantiles = _quantiles(histogram, by, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return squares.join(sums, place).join(quantiles, place).select(
        *place, "count", round_even(F.col("_mean"), 2).alias("mean"),
        round_even(F.when(F.col("count") > 1, F.sqrt(F.col("_squares") / (F.col("count") - 1))), 2).alias("std"),
        "min", *[round_even(F.col(q), 2).alias(q) for q in ("q25", "q50", "q75")], "max",
    )


def mean_by(df: DataFrame, columns: list[str] = PROFILED, by: str = "category", digits: int = 2) -> DataFrame:
    return df.groupBy(by).agg(*[round_even(F.avg(c), digits).alias(c) for c in columns])


def box_plot_stats(df: DataFrame, column: str = "text_word_count", by: str = "category") -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 interquartile ranges) and the count of outliers."""
    histogram = materialize(_histogram(df, by, [column]), "histogram")
    quartiles = broadcast_bounded(_quantiles(histogram, by, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("column"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return histogram.join(quartiles, by).groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("rows"))), F.lit(0)).alias("outliers"),
    )


def compare_versions(**versions: DataFrame) -> DataFrame:
    """Rows, distinct classes and distinct languages of each named table."""
    out = None
    for name, df in versions.items():
        row = df.agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_distinct("category").alias("categories"),
            F.count_distinct("detected_language").alias("languages"),
        ).select(F.lit(name).alias("version"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def label_map(df: DataFrame) -> DataFrame:
    return df.select("category", "label").distinct().orderBy("label", "category")


def missing_totals(df: DataFrame) -> DataFrame:
    """Sums of the missing-value flags."""
    return df.agg(*[F.sum(f"{c}_missing").alias(f"{c}_missing") for c in ("sender", "receiver", "date")])


def mean_confidence(df: DataFrame, image: str, confidence: str) -> DataFrame:
    """Mean recognition confidence of each image: unreadable and negative values are skipped, none gives 0."""
    number = F.col(confidence).try_cast("double")
    return df.groupBy(image).agg(
        F.coalesce(round_even(F.avg(F.when(number >= 0, number)) / F.lit(100.0), 4), F.lit(0.0)).alias(
            "ocr_confidence"
        )
    )

