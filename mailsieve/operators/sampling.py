"""Repeatable splits, samples, weights and generated samples.

Exact splits need the rank of a row among its class. A window over a class would sort a third of the
table in one task, so only the rows at the cut positions are found: a histogram over the leading bits of
the order key says in which bucket a cut falls, the rows of that one bucket are ranked, and every row is then
compared with the cut rows of its class. Apart from the histogram and one bucket per cut nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.operators.bounded import broadcast_bounded
from mailsieve.operators.prepare import lookup, remainder

KEY_BITS = 60
BUCKET_BITS = 12


def order_key(id_column: Column, seed: int = V.SEED) -> Column:
    """A repeatable pseudo-random number for an id: the first 60 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), id_column.cast("string")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def _cut_rows(df: DataFrame, group: list[str], targets: dict[str, Column], key="email_id", seed=V.SEED) -> DataFrame:
    """For each group and each named target rank t: the order key and id of its t-th row.

    ``targets`` are expressions over the group columns and ``total``, the rows of the group.
    """
    keyed = df.select(*group, F.col(key).alias("_id"), order_key(F.col(key), seed).alias("_key")).withColumn(
        "_bucket", F.shiftright("_key", KEY_BITS - BUCKET_BITS)
    )
    histogram = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    running = within.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.withColumns(
        {"total": F.sum("_n").over(within), "_upto": F.sum("_n").over(running)}
    )
    cuts = F.array(*[F.struct(F.lit(n).alias("cut"), t.cast("long").alias("target")) for n, t in targets.items()])
    wanted = (
        placed.withColumn("_c", F.explode(cuts))
        .select(
            *group, "_bucket", F.col("_c.cut").alias("cut"),
            (F.col("_c.target") - (F.col("_upto") - F.col("_n"))).alias("_rank"), "_n",
        )
        .filter((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_n")))
        .drop("_n")
    )
    wanted = broadcast_bounded(wanted)  # one row for each group and target
    place = [*group, "_bucket"]
    numbered = keyed.join(wanted, place, "left_semi").withColumn(
        "_pos", F.row_number().over(Window.partitionBy(*place).orderBy("_key", "_id"))
    )
    hits = numbered.join(wanted, place).filter(F.col("_pos") == F.col("_rank"))
    return hits.select(*group, "cut", F.col("_key").alias("cut_key"), F.col("_id").alias("cut_id"))


def _with_cuts(df: DataFrame, group: list[str], targets: dict[str, Column], key="email_id", seed=V.SEED) -> DataFrame:
    """Add one boolean per target: is this row among the first t rows of its group?"""
    cuts = _cut_rows(df, group, targets, key, seed)
    wide = (cuts.groupBy(*group) if group else cuts.groupBy(F.lit(0).alias("_one"))).agg(
        *[
            F.max(F.when(F.col("cut") == n, F.struct("cut_key", "cut_id"))).alias(f"_cut_{n}")
            for n in targets
        ]
    )
    here = F.struct(order_key(F.col(key), seed).alias("cut_key"), F.col(key).alias("cut_id"))
    keyed = df.withColumn("_here", here)
    if group:
        keyed = keyed.join(broadcast_bounded(wide), group, "left")
    else:
        # One row of cut positions at most: they become literals.
        first = wide.first()
        for n in targets:
            cut = first[f"_cut_{n}"] if first else None
            literal = (
                F.struct(F.lit(cut["cut_key"]).alias("cut_key"), F.lit(cut["cut_id"]).alias("cut_id"))
                if cut
                else F.lit(None).cast(keyed.schema["_here"].dataType)
            )
            keyed = keyed.withColumn(f"_cut_{n}", literal)
    marked = keyed.withColumns(
        {n: F.coalesce(F.col("_here") <= F.col(f"_cut_{n}"), F.lit(False)) for n in targets}
    )
    return marked.drop("_here", *[f"_cut_{n}" for n in targets])


def stratified_split(df: DataFrame, key="email_id", label="category", seed=V.SEED) -> DataFrame:
    """Add ``split``: 70 / 15 / 15 percent of every class, exact to the row and repeatable."""
    total = F.col("total")
    targets = {
        "_in_70": F.floor(total * 70 / 100),
        "_in_85": F.floor(total * 85 / 100),
    }
    marked = _with_cuts(df.filter(F.col(label).isNotNull()), [label], targets, key, seed)
    return marked.withColumn(
        "split",
        F.when(F.col("_in_70"), F.lit("train")).when(F.col("_in_85"), F.lit("validation")).otherwise(F.lit("test")),
    ).drop("_in_70", "_in_85")


def simple_sample(df: DataFrame, limit: int = 10_000, key="email_id", seed=V.SEED) -> DataFrame:
    """min(limit, rows) rows, repeatable."""
    targets = {"_taken": F.least(F.lit(limit).cast("long"), F.col("total"))}
    return _with_cuts(df, [], targets, key, seed).filter("_taken").drop("_taken")


def stratified_sample(df: DataFrame, n: int, key="email_id", label="category", seed=V.SEED) -> DataFrame:
    """n rows with the class shares of the table: a quota of at least one row per class, trimmed or topped up to n."""
    rows = df.filter(F.col(label).isNotNull())
    total = rows.count()
    n = min(n, total)
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("total") / F.lit(max(total, 1))))
    marked = _with_cuts(rows, [label], {"_quota": quota}, key, seed)
    chosen = marked.filter("_quota").drop("_quota")
    short = n - chosen.count()
    if short == 0:
        return chosen
    if short < 0:
        return simple_sample(chosen, n, key, seed)
    return chosen.unionByName(simple_sample(remainder(rows, chosen, key), short, key, seed))


def balanced_weights(df: DataFrame, label="category") -> DataFrame:
    """(class, rows, weight) with weight = n / (k * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class, so the window is small.
    every = Window.partitionBy(F.lit(0))
    return counts.withColumn(
        "weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    )


def with_balanced_weight(df: DataFrame, label="category", weight="weight") -> DataFrame:
    weights = balanced_weights(df, label).select(label, F.col("weight").alias(weight))
    return df.join(broadcast_bounded(weights), label)


def oversample(df: DataFrame, weight="weight", key="email_id", seed=V.SEED) -> DataFrame:
    """Repeat rows in proportion to their weight, for learners without sample weights.

    The smallest weight stands for one copy; the fraction of a copy is decided by the row's order key.
    """
    least = df.agg(F.min(weight)).first()[0]
    times = F.col(weight) / F.lit(least)
    chance = F.pmod(order_key(F.col(key), seed), F.lit(1_000_000)) / F.lit(1_000_000.0)
    copies = F.floor(times) + (chance < times - F.floor(times)).cast("long")
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("_copy")


# --- generated code-mixed samples -----------------------------------------

# Templates of this library; callers may pass their own.
SUBJECTS = [
    "Verify your account", "Bank notice", "Portal access", "Payroll check", "Parcel waiting", "Payment on hold",
]
SINHALA_BODIES = [
    "ඔබේ ගිණුම verify කරන්න: {url} ({timeframe}).",
    "Dear user, ඔබේ bank account update කරන්න {url}.",
    "ඔබේ password expire වේ. {timeframe} confirm කරන්න {url}.",
]
TAMIL_BODIES = [
    "உங்கள் கணக்கு verify செய்யவும்: {url} ({timeframe}).",
    "Dear user, உங்கள் bank account update செய்யவும் {url}.",
    "உங்கள் password expire ஆகும். {timeframe} confirm செய்யவும் {url}.",
]
OPENINGS = [
    "Our records show an unusual sign-in.", "A routine review needs your reply.", "Service may pause without an answer.",
]
TIMEFRAMES = ["today", "within 24 hours", "before Friday", "at the next login"]
LURES = ["hxxps://bank-a[.]test/verify", "hxxps://portal-b[.]test/login", "hxxps://pay-c[.]test/confirm"]
SENDERS = ["alerts@bank-a.test", "desk@portal-b.test", "team@pay-c.test"]
RECEIVERS = ["one@in.example.test", "two@in.example.test"]


def pick(index: Column, slot: str, choices: list[str], seed: int = V.SEED) -> Column:
    """A repeatable choice for a row and a slot."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(slot), index.cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(number, F.lit(len(choices))) + 1).cast("int"))


def generate_code_mixed(ids: DataFrame, index: str = "index", rows: int | Column = 20_000, seed=V.SEED) -> DataFrame:
    """One generated e-mail per index 1..rows: half Sinhala, half Tamil, every fifth of the AI class."""
    i = F.col(index)
    sinhala = i <= F.floor(F.lit(rows) / 2) if isinstance(rows, int) else i <= F.floor(rows / 2)
    body = F.when(sinhala, pick(i, "body", SINHALA_BODIES, seed)).otherwise(pick(i, "body", TAMIL_BODIES, seed))
    body = F.replace(body, F.lit("{url}"), pick(i, "url", LURES, seed))
    body = F.replace(body, F.lit("{timeframe}"), pick(i, "timeframe", TIMEFRAMES, seed))
    ai = F.pmod(i, F.lit(5)) == 0
    drafted = ids.select(
        F.format_string("CM_%06d", i).alias("email_id"),
        F.lit("Synthetic_CodeMixed").alias("source_dataset"),
        pick(i, "sender", SENDERS, seed).alias("sender"),
        pick(i, "receiver", RECEIVERS, seed).alias("receiver"),
        F.lit("").alias("date"),
        pick(i, "subject", SUBJECTS, seed).alias("subject"),
        F.when(ai, F.concat_ws(" ", pick(i, "opening", OPENINGS, seed), body)).otherwise(body).alias("body"),
        F.lit(1).alias("urls"),
        F.lit("synthetic").alias("original_label"),
        F.when(ai, F.lit("AI_Generated_Phishing")).otherwise(F.lit("Traditional_Phishing")).alias("category"),
        F.when(sinhala, F.lit(V.CODE_MIXED[0])).otherwise(F.lit(V.CODE_MIXED[1])).alias("language"),
    )
    return drafted.withColumns(
        {
            "email_text": F.trim(F.concat_ws(" ", "subject", "body")),
            "label": lookup(F.col("category"), V.CATEGORY_LABELS),
        }
    )
