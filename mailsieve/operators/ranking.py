"""Per-e-mail rankings on arrays, and small report heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.text import display_name, round_even


def _by_value_desc(a: Column, b: Column) -> Column:
    """Larger value first, then the smaller position."""
    return (
        F.when(a["value"] > b["value"], F.lit(-1))
        .when(a["value"] < b["value"], F.lit(1))
        .when(a["pos"] < b["pos"], F.lit(-1))
        .when(a["pos"] > b["pos"], F.lit(1))
        .otherwise(F.lit(0))
    )


def ranked(values: Column, names: Column) -> Column:
    """Array of struct(pos, name, value), largest value first. Bounded per row, so no window is needed."""
    items = F.transform(
        values,
        lambda v, i: F.struct(i.alias("pos"), F.element_at(names, i + 1).alias("name"), v.alias("value")),
    )
    return F.array_sort(items, _by_value_desc)


def probability_ranking(df: DataFrame, probabilities: str, classes: list[str], key="email_id") -> DataFrame:
    """One row per e-mail and class, most probable first, in percent."""
    order = ranked(F.col(probabilities), F.array(*[F.lit(c) for c in classes]))
    return df.select(key, F.posexplode(order).alias("p", "r")).select(
        key,
        (F.col("p") + 1).alias("rank"),
        display_name(F.col("r.name")).alias("class"),
        round_even(F.col("r.value") * F.lit(100.0), 2).alias("percent"),
    )


def arg_max(probabilities: Column) -> Column:
    """Zero-based position of the largest value, the first on a tie."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def with_winner(df: DataFrame, probabilities: str, classes: list[str]) -> DataFrame:
    p = F.col(probabilities)
    return df.withColumns(
        {
            "prediction": F.element_at(F.array(*[F.lit(c) for c in classes]), arg_max(p) + 1),
            "confidence": F.array_max(p),
        }
    )


def top_drops(drops: Column, n: int = 5) -> Column:
    """The n largest positive values of an array of struct(pos, name, value)."""
    return F.slice(F.array_sort(F.filter(drops, lambda d: d["value"] > 0), _by_value_desc), 1, n)


def top_absolute(items: Column, n: int) -> Column:
    """The n largest by absolute value, n from 1 to 25, of an array of struct(pos, name, value)."""
    if not 1 <= n <= 25:
        raise ValueError("n must lie between 1 and 25")

    def order(a: Column, b: Column) -> Column:
        x, y = F.abs(a["value"]), F.abs(b["value"])
        return (
            F.when(x > y, F.lit(-1))
            .when(x < y, F.lit(1))
            .when(a["pos"] < b["pos"], F.lit(-1))
            .when(a["pos"] > b["pos"], F.lit(1))
            .otherwise(F.lit(0))
        )

    return F.slice(F.array_sort(items, order), 1, n)


def top_importances(importances: DataFrame, n: int = 15) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def newest_first(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(key))


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """First n rows in an explicit order (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)
