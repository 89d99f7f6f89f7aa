"""The most frequent keys of a count table, as many as a model holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, limit: int, count_column: str = "n") -> DataFrame:
    """Rows with the largest counts, ``limit`` at most; of equal counts all or none.

    The smallest count that leaves at most ``limit`` rows follows from the number of rows of each count, so no task
    sorts or passes on more than that. ``counts`` is read twice: write a computed table first.
    """
    sizes = counts.groupBy(count_column).agg(F.count(F.lit(1)).alias("rows"))
    # One row for each count that occurs: about the square root of all occurrences at most.
    upto = Window.orderBy(F.desc(count_column)).rowsBetween(Window.unboundedPreceding, 0)
    fitting = sizes.withColumn("upto", F.sum("rows").over(upto)).filter(F.col("upto") <= limit)
    least = fitting.agg(F.min(count_column)).first()[0]
    return counts.filter(F.lit(False) if least is None else F.col(count_column) >= least)
