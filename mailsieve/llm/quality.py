"""Quality rules: robust multivariate outliers among the documents of one language and source.

Everything here is built-in expressions. One projection chain over the text gives the base counts; they are written
once as a narrow table, and all further passes read that.

* The vector of a document: log of the mean word length, and the angles (arc sine of the square root) of the shares of
  symbols, repeated lines and words in repeated windows, each in steps of 1/4096 so that sums are exact in any order.
* Copies must not define what is usual: each distinct text of a group counts once (told apart by 64-bit hashes). Texts with
  the same vector are one row with their number ``n``, which weighs in every quantile, sum and size.
* A group is a language and source. Groups of fewer than ``min_rows`` texts take the estimate of all their
  language's small groups together; where that is too small as well, the method rejects nothing.
* Minimum covariance determinant: several deterministic starts for each group (medians with median deviations; the
  covariance of the directions from the medians; mean and covariance of the nearest half), all followed at once. A
  concentration step keeps the share ``support`` with the smallest distances and takes mean and covariance from it. A
  start goes on while its determinant falls (by a millionth or more, at most ``steps`` times); of all starts the smallest
  determinant counts, and a last step reweights with all vectors inside the 97.5 % bound. Steps are two aggregations
  each. Quantiles come from histograms of rounded values, so a group's rows never meet in one place.
* Covariances get the squares of ``floors`` on their diagonal, so that a share that is zero nearly everywhere keeps a
  spread. The distance of a document also allows for the counting error of its own length: a quarter of 1 / characters
  for the share of symbols, of 1 / lines for lines, of 8 / words for words in windows, 0.3 / words for word length.
* A document is rejected if its squared Mahalanobis distance is over ``cut`` (default: 99.99 % of chi-square, 4 df).
* ``judged_by`` names the estimate that a document met: ``source``, ``language``, ``none``, or ``base`` where it failed before.

Defined results: null or empty texts have no words and fail the base rule; null languages and sources are groups of
their own; rows with the same id are judged one by one; an empty table gives no rows; other columns are ignored.
Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.session import materialize

_SPACES = " \t\n\x0b\f\r"
FEATURES = ("x0", "x1", "x2", "x3")
STEP = 4096
#: Distributions of chi-square with 4 and 6 degrees of freedom: the 97.5 % and 99.99 % points of the first, and by how
#: much the covariance of the nearest 75 % (97.5 %) of normal vectors is too small.
CHI_975, CHI_9999, GROW_75, GROW_975 = 11.143, 23.513, 1.4864, 1.0645
#: A concentration step counts if the root of the determinant falls by this share.
FALL = 1e-6
_KEYS = ("group", "start")
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
_MEANS = [f"m_{i}" for i in range(len(FEATURES))]
_FACTORS = [f"l_{i}_{j}" for i, j in _PAIRS]


def base_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the base rules for every whole text; ``keep`` names further columns to carry along."""
    text = F.coalesce(docs[text_column], F.lit(""))
    df = docs.select(docs[id_column].alias("id"), *(docs[c].alias(f"k_{c}") for c in keep), text.alias("text"))
    df = df.withColumns({
        "words": F.filter(F.split("text", r"[ \x09-\x0D]+", -1), lambda w: w != ""),
        "lines": F.filter(F.split("text", r"\n", -1), lambda l: F.btrim(l, F.lit(_SPACES)) != ""),
        "word_chars": F.char_length(F.translate("text", _SPACES, "")).cast("bigint"),
        "n_symbols": (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("bigint"),
    })
    df = df.withColumns({
        "n_words": F.size("words").cast("bigint"),
        "n_lines": F.size("lines").cast("bigint"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        "h": F.transform("words", lambda w: F.xxhash64(w)), "digest": F.xxhash64("text"),
    }).drop("text", "words", "lines")
    # Hashes of 2, 4 and 8 neighbouring words; the last of each are cut off at the end.
    for new, old, by in (("h2", "h", 1), ("h4", "h2", 2), ("h8", "h4", 4)):
        later = F.slice(old, 1 + by, F.greatest(F.size(old), F.lit(0)))
        df = df.withColumn(new, F.zip_with(old, later, lambda a, b: F.xxhash64(a, b))).drop(old)
    df = df.withColumn("h8", F.when(F.col("n_words") >= 8, F.slice("h8", 1, F.greatest(F.col("n_words") - 7, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<bigint>")))
    places = F.array_sort(F.transform("h8", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("places", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), places)).drop("h8")
    again = F.filter("places", lambda p, i: (F.get("places", i - 1)["x"] == p["x"]) | (F.get("places", i + 1)["x"] == p["x"]))
    df = df.withColumn("starts", F.array_sort(F.transform(again, lambda p: p["i"]))).drop("places")
    covered = F.aggregate(
        "starts", F.struct(F.lit(-8).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(8), s - a["last"])).alias("n")), lambda a: a["n"],
    )
    return df.select(
        "id", *(F.col(f"k_{c}") for c in keep), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), "digest",
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _vector() -> list[Column]:
    angle = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))
    values = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        angle("n_symbols", "word_chars"), angle("n_dup_lines", "n_lines"), angle("n_repeat_words", "n_words"),
    ]
    return [F.round(v * STEP).cast("bigint").alias(x) for v, x in zip(values, FEATURES)]


def _counting_error() -> list[Column]:
    """Variance of a document's own values from the number of things counted."""
    return [F.lit(weight) / F.greatest(F.col(count), F.lit(1)) for weight, count in ((0.3, "n_words"), (0.25, "word_chars"), (0.25, "n_lines"), (2.0, "n_words"))]


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor in columns l_i_j."""
    total, y = F.lit(0.0), []
    for i, x in enumerate(FEATURES):
        rest = F.col(x) / STEP - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * y[j]
        y.append(rest / F.col(f"l_{i}_{i}"))
        total = total + y[i] * y[i]
    return total


def _near() -> Column:
    """The distance on a fine logarithmic scale of few thousand values, so that a quantile's histogram stays small."""
    return F.round(256 * F.log1p(_distance())).cast("int")


def _factored(df: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Cholesky factor l_i_j of the covariance v_i_j, column by column, and ``volume``, the root of its determinant."""
    for i, j in _PAIRS:
        value = F.col(f"v_{i}_{j}")
        for k in range(j):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        # At least the floor's square remains, also after rounding.
        df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(floors[i] ** 2))) if i == j else value / F.col(f"l_{j}_{j}"))
    return df.withColumn("volume", F.col("l_0_0") * F.col("l_1_1") * F.col("l_2_2") * F.col("l_3_3"))


def _own_distance(floors: tuple[float, ...]) -> Column:
    """Squared distance with the document's own counting error on the diagonal of v_i_j, as one expression."""
    p, error = len(FEATURES), _counting_error()

    def column(j: int, before: list[Column]) -> Column:
        """The rest of the distance, with columns 0..j-1 of the factor and of the solution known."""
        if j == p:
            return functools.reduce(lambda a, b: a + b, (b["y"] * b["y"] for b in before), F.lit(0.0))
        rest = [F.col(f"v_{i}_{j}") + error[j] if i == j else F.col(f"v_{i}_{j}") for i in range(j, p)]
        rest = [functools.reduce(lambda a, b: a - b[f"l{i}"] * b[f"l{j}"], before, r) for i, r in enumerate(rest, j)]
        pivot = F.sqrt(F.greatest(rest[0], F.lit(floors[j] ** 2)))
        off = functools.reduce(lambda a, b: a - b[f"l{j}"] * b["y"], before, F.col(FEATURES[j]) / STEP - F.col(f"m_{j}"))
        return _let(F.struct(pivot.alias("pivot"), off.alias("off"), *(r.alias(f"r{i}") for i, r in enumerate(rest[1:], j + 1))), lambda c: _let(
            F.struct((c["off"] / c["pivot"]).alias("y"), *((c[f"r{i}"] / c["pivot"]).alias(f"l{i}") for i in range(j + 1, p))),
            lambda known: column(j + 1, [*before, known]),
        ))

    return column(0, [])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covariance(vectors: DataFrame, keys: tuple[str, ...], grow: float, floors: tuple[float, ...]) -> DataFrame:
    """Means m_i and covariances v_i_j, floors included, of the vectors with the same keys; all sums are exact."""
    exact = lambda c: F.sum((c * F.col("n")).cast("decimal(20,0)")).cast("double")
    sums = vectors.groupBy(*keys).agg(
        F.sum("n").alias("n"), *(exact(F.col(x)).alias(f"s_{i}") for i, x in enumerate(FEATURES)),
        *(exact(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s_{i}_{j}") for i, j in _PAIRS),
    ).withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") / STEP for i in range(len(FEATURES))})
    return sums.select(*keys, *_MEANS, *(
        (grow * (F.col(f"s_{i}_{j}") / F.col("n") / STEP**2 - F.col(f"m_{i}") * F.col(f"m_{j}")) + (floors[i] ** 2 if i == j else 0.0)).alias(f"v_{i}_{j}")
        for i, j in _PAIRS
    ))


def _starts(vectors: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Estimates to start from: 0 medians and their deviations, 1 covariance of directions, 2 the nearest half."""
    p = len(FEATURES)
    middle = materialize(vectors.groupBy("group").agg(*(F.percentile(x, 0.5, F.col("n")).alias(f"c_{i}") for i, x in enumerate(FEATURES))), "medians")
    off = vectors.join(middle, "group").groupBy("group").agg(
        *(F.first(f"c_{i}").alias(f"c_{i}") for i in range(p)),
        *(F.percentile(F.abs(F.col(x) - F.col(f"c_{i}")), 0.5, F.col("n")).alias(f"d_{i}") for i, x in enumerate(FEATURES)),
    )
    plain = materialize(_factored(off.select(
        "group", F.lit(0).alias("start"), *((F.col(f"c_{i}") / STEP).alias(f"m_{i}") for i in range(p)),
        *((F.greatest(1.4826 * F.col(f"d_{i}") / STEP, F.lit(floors[i])) ** 2 if i == j else F.lit(0.0)).alias(f"v_{i}_{j}") for i, j in _PAIRS),
    ), floors), "plain")
    seen = vectors.join(plain, "group").withColumns({"d": _near(), "r": F.sqrt(_distance())})
    turned = [F.when(F.col("r") > 0, F.round((F.col(x) / STEP - F.col(f"m_{i}")) / F.col(f"l_{i}_{i}") / F.col("r") * STEP)).otherwise(0.0).cast("bigint").alias(x) for i, x in enumerate(FEATURES)]
    scale = plain.select("group", *(F.col(f"m_{i}").alias(f"c_{i}") for i in range(p)), *(F.col(f"l_{i}_{i}").alias(f"r_{i}") for i in range(p)))
    turns = _covariance(seen.select("group", F.lit(1).alias("start"), "n", *turned), _KEYS, 1.0, (0.0,) * p).join(scale, "group").select(
        *_KEYS, *(F.col(f"c_{i}").alias(f"m_{i}") for i in range(p)),
        *((p * F.col(f"v_{i}_{j}") * F.col(f"r_{i}") * F.col(f"r_{j}") + (floors[i] ** 2 if i == j else 0.0)).alias(f"v_{i}_{j}") for i, j in _PAIRS),
    )
    bound = materialize(seen.groupBy("group").agg(F.percentile("d", 0.5, F.col("n")).alias("bound")), "bounds")
    half = seen.join(bound, "group").filter("d <= bound").select("group", F.lit(2).alias("start"), "n", *FEATURES)
    others = _factored(turns.unionByName(_covariance(half, _KEYS, 1.0, floors)), floors)
    return plain.unionByName(others).withColumn("volume", F.lit(float("inf")))


def fit_mcd(vectors: DataFrame, floors: tuple[float, ...], support: float, steps: int) -> DataFrame:
    """Means m_i and covariances v_i_j by group of (group, x0..x3, n); without ``n`` every row counts once."""
    if "n" not in vectors.columns:
        vectors = vectors.withColumn("n", F.lit(1).cast("bigint"))
    moving, found = materialize(_starts(vectors, floors), "estimate"), []
    for _ in range(steps):
        bounds = vectors.join(moving, "group").withColumn("d", _near()).groupBy(*_KEYS).agg(F.percentile("d", support, F.col("n")).alias("bound"))
        bounded = materialize(moving.join(bounds, list(_KEYS)), "bounds")
        nearest = vectors.join(bounded, "group").filter(_near() <= F.col("bound")).select(*_KEYS, *FEATURES, "n")
        before = bounded.select(*_KEYS, F.col("volume").alias("before"))
        fallen = _factored(_covariance(nearest, _KEYS, GROW_75, floors), floors).join(before, list(_KEYS))
        # Written first: a filter would be moved into the factors' chain and repeat it many times over.
        moving = materialize(fallen, "estimate").filter(F.col("volume") < F.col("before") * (1 - FALL)).drop("before")
        found.append(moving)
        if moving.isEmpty():
            break
    smallest = functools.reduce(DataFrame.unionByName, found).groupBy("group").agg(
        F.min(F.struct("volume", "start", *_MEANS, *_FACTORS)).alias("best")).select("group", "best.*")
    inside = vectors.join(materialize(smallest, "estimate"), "group").filter(_distance() <= CHI_975).select("group", *FEATURES, "n")
    return materialize(_covariance(inside, ("group",), GROW_975, floors), "estimate")


def judge(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
    floors: tuple[float, ...] = (0.08, 0.04, 0.06, 0.06), support: float = 0.75, steps: int = 30, min_rows: int = 50, cut: float = CHI_9999, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: base counts, ``base_failed``, squared ``distance`` (null: not judged), ``kept`` and ``judged_by``.

    ``keep`` names columns to carry along, under k_ names.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"k_{c}").cast("string")), F.lit("-"))
    carried = tuple(dict.fromkeys((lang_column, source_column, *keep)))
    counted = base_counts(docs, id_column, text_column, carried).withColumns(
        {"lang_key": part(lang_column), "own": F.concat_ws("\x1f", part(lang_column), part(source_column))}
    ).drop(*(f"k_{c}" for c in carried if c not in keep))
    counted = materialize(counted.select("*", *_vector()), "counts")
    texts = materialize(counted.filter("not base_failed").select("lang_key", "own", "digest", *FEATURES).distinct(), "texts")
    sizes = texts.groupBy("lang_key", "own").count()
    group = F.when(F.col("count") >= min_rows, F.col("own")).otherwise(F.concat("lang_key", F.lit("\x1e")))
    level = F.when(F.col("count") >= min_rows, F.lit("source")).otherwise(F.lit("language"))
    groups = materialize(sizes.select("own", group.alias("group"), level.alias("level")), "groups")
    # A text that several small groups of a language hold counts once for all of them.
    once = texts.join(groups, "own").select("group", "digest", *FEATURES).distinct()
    vectors = materialize(once.groupBy("group", *FEATURES).agg(F.count("*").alias("n")), "vectors")
    enough = vectors.groupBy("group").agg(F.sum("n").alias("count")).filter(F.col("count") >= min_rows)
    estimate = fit_mcd(vectors, floors, support, steps).join(enough.select("group"), "group", "left_semi")
    known = materialize(groups.join(estimate, "group").drop("group"), "estimate")
    judged = counted.join(known, "own", "left").withColumn("distance", F.when(~F.col("base_failed"), _own_distance(floors)))
    by = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.coalesce("level", F.lit("none")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return judged.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "distance", by.alias("judged_by"), *(f"k_{c}" for c in keep),
    )
