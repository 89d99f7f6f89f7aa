"""Operators on small tables, with skew where it matters."""

import pytest
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.operators import feedback as B
from mailsieve.operators import metrics as M
from mailsieve.operators import prepare as P
from mailsieve.operators import profiles as A
from mailsieve.operators import sampling as T

# Published test figures of a 200 tree forest: rows are actual classes, alphabetical.
MATRIX = [
    [600, 0, 0, 0, 0], [0, 486, 3, 4, 1], [0, 0, 2866, 69, 0], [0, 18, 32, 2297, 2], [0, 0, 12, 14, 2606],
]


@pytest.fixture(scope="module")
def judged(spark):
    names = V.CLASSES_SORTED
    rows = [(a, p, MATRIX[i][j]) for i, a in enumerate(names) for j, p in enumerate(names)]
    counts = spark.createDataFrame(rows, "category string, prediction string, n int").filter("n > 0")
    return counts.select("category", "prediction", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))


def test_published_figures(judged):
    assert M.accuracy(judged).first()["accuracy"] == pytest.approx(0.9827968923418424)
    assert M.macro_f1(judged).first()["macro_f1"] == pytest.approx(0.9838420987869672)
    matrix = {r["actual"]: [r[c] for c in V.CLASSES_SORTED] for r in M.confusion_matrix(judged).collect()}
    assert [matrix[c] for c in V.CLASSES_SORTED] == MATRIX
    report = {r["class"]: r for r in M.classification_report(judged).collect()}
    assert len(report) == 8
    assert (round(report["Spam"]["precision"], 2), report["Spam"]["support"]) == (0.96, 2349)


def test_division_by_zero(spark):
    df = spark.createDataFrame([("Spam", "Legitimate")], "category string, prediction string")
    report = {r["class"]: r for r in M.classification_report(df).collect()}
    assert (report["Spam"]["precision"], report["Spam"]["recall"], report["Spam"]["f1"]) == (0.0, 0.0, 0.0)
    assert report["AI_Generated_Phishing"]["support"] == 0
    assert len(M.confusion_matrix(df).collect()) == 5


def test_class_weights(spark):
    counts = {
        "AI_Generated_Phishing": 2800, "Business_Email_Compromise": 2304, "Legitimate": 13695, "Spam": 10961,
        "Traditional_Phishing": 12284,
    }
    df = spark.createDataFrame(list(counts.items()), "category string, n int").select(
        "category", F.explode(F.sequence(F.lit(1), F.col("n")))
    )
    weights = {r["category"]: r["weight"] for r in T.balanced_weights(df).collect()}
    assert weights["AI_Generated_Phishing"] == pytest.approx(3.003142857142857)
    assert weights["Business_Email_Compromise"] == pytest.approx(3.649652777777778)
    assert weights["Legitimate"] == pytest.approx(0.614005111354509)


def skewed(spark, n=20_000):
    """One class holds most rows, one holds a single row."""
    return spark.range(n).select(
        F.col("id").alias("email_id"),
        F.when(F.col("id") == 7, "Rare").when(F.col("id") % 10 < 8, "Spam").otherwise("Legitimate").alias("category"),
    )


def test_split_is_exact_and_repeatable(spark):
    df = skewed(spark)
    first = T.stratified_split(df)
    counts = {(r["category"], r["split"]): r["count"] for r in first.groupBy("category", "split").count().collect()}
    for name, total in {r["category"]: r["count"] for r in df.groupBy("category").count().collect()}.items():
        train, validation = total * 70 // 100, total * 85 // 100 - total * 70 // 100
        assert counts.get((name, "train"), 0) == train
        assert counts.get((name, "validation"), 0) == validation
        assert counts.get((name, "test"), 0) == total - train - validation
    again = T.stratified_split(df.repartition(7))
    assert first.exceptAll(again).count() == 0
    assert T.stratified_split(df, seed=1).exceptAll(first).count() > 0


def test_samples(spark):
    df = skewed(spark)
    assert T.simple_sample(df, 777).distinct().count() == 777
    assert T.simple_sample(df, 10**6).count() == 20_000
    assert T.simple_sample(df, 0).count() == 0
    rows = T.stratified_sample(df, 1000)
    assert rows.count() == rows.distinct().count() == 1000
    assert rows.filter("category = 'Rare'").count() == 1
    # More classes than rows: trimmed.
    many = spark.range(50).select(F.col("id").alias("email_id"), F.col("id").cast("string").alias("category"))
    assert T.stratified_sample(many, 10).count() == 10


def test_oversample(spark):
    weighted = T.with_balanced_weight(skewed(spark, 1000).filter("category <> 'Rare'"))
    counts = {r["category"]: r["count"] for r in T.oversample(weighted).groupBy("category").count().collect()}
    assert abs(counts["Spam"] - counts["Legitimate"]) < 100


def test_running_id(spark):
    df = spark.range(5000).select((F.col("id") * 3 % 5000).alias("n"), (F.col("id") % 3).alias("rank"))
    got = P.add_running_id(df, ["rank", "n"]).orderBy("email_id").collect()
    assert [r["email_id"] for r in got] == list(range(1, 5001))
    assert [(r["rank"], r["n"]) for r in got] == sorted((r["rank"], r["n"]) for r in got)
    # Clustered values, and a table with one row.
    odd = spark.range(3000).select(F.when(F.col("id") < 2999, F.col("id")).otherwise(10**12).alias("n"))
    ids = P.add_running_id(odd, ["n"]).orderBy("n").collect()
    assert [r["email_id"] for r in ids] == list(range(1, 3001))
    assert P.add_running_id(spark.range(1).toDF("n"), ["n"]).first()["email_id"] == 1
    assert P.add_running_id(spark.range(0).toDF("n"), ["n"]).count() == 0


def test_keep_first_with_a_hot_text(spark):
    df = spark.range(9000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"),
        (F.col("id") % 2).alias("rank"),
    )
    kept = P.keep_first(df, "text", ["rank", "id"])
    assert kept.count() == 6001
    assert kept.filter("text = 'same'").first()["id"] == 0
    # The map side hands on one row per text and task.
    assert "partial_min" in kept._jdf.queryExecution().toString()


def test_duplicates_keep_columns_apart(spark):
    rows = [("a", "bc"), ("ab", "c"), ("a", "bc"), (None, "x"), (None, "x"), ("", "x")]
    df = spark.createDataFrame(rows, "subject string, body string")
    got = {r["columns"]: r["duplicates"] for r in P.duplicate_counts(df, [["subject", "body"], ["subject"]]).collect()}
    assert got == {"subject+body": 2, "subject": 2}


def test_standardize_and_filters(spark):
    raw = spark.createDataFrame([(" S ", "b\n c", "0"), ("x", "  ", "1"), ("y", "b", "7")], "subject string, body string, label string")
    by_label = F.when(F.col("label") == "0", "Legitimate").when(F.col("label") == "1", "Spam")
    out = P.standardize_corpus(raw, "A", by_label)
    first = out.filter("original_label = '0'").first()
    assert (first["email_text"], first["urls"], first["sender"], first["label"]) == ("S b c", "", "", 0)
    assert [r["original_label"] for r in P.drop_invalid(out).collect()] == ["0"]
    service = out.withColumn("subject", F.lit("re: folder INTERNAL DATA"))
    assert P.drop_service_mail(service, "A", "Folder Internal Data").count() == 0
    assert P.drop_service_mail(service, "B", "Folder Internal Data").count() == 3


def test_union_and_lookup(spark):
    a = spark.createDataFrame([(1, "x")], "b int, a string")
    b = spark.createDataFrame([(2.0, 1)], "c double, b int")
    union = P.union_aligned(a, b)
    assert union.columns == ["a", "b", "c"]
    assert sorted(map(str, union.collect())) == sorted(["Row(a='x', b=1, c=None)", "Row(a=None, b=1, c=2.0)"])
    risk = P.with_class_risk(spark.createDataFrame([("Spam",), ("Other",), (None,)], "category string"))
    assert sorted(r["risk"] for r in risk.collect()) == ["High", "High", "Medium"]


def test_alignment(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "email_id int, label int")
    b = spark.createDataFrame([(1, 0), (2, 2), (4, 1)], "email_id int, label int")
    assert P.check_alignment(a, b).first().asDict() == {"matching": 1, "different": 1, "missing_left": 1, "missing_right": 1}


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 100), ("b", 5)], "category string, v int")
    got = {r["category"]: r for r in A.describe_by(df, ["v"]).collect()}
    assert (got["a"]["q25"], got["a"]["q50"], got["a"]["q75"], got["a"]["mean"]) == (1.75, 3.0, 28.0, 26.75)
    assert got["b"]["std"] is None
    box = {r["category"]: r for r in A.box_plot_stats(df, "v").collect()}
    assert (box["a"]["whisker_low"], box["a"]["whisker_high"], box["a"]["outliers"]) == (1.0, 4.0, 1)
    assert A.null_profile(df).count() == 0


def test_feedback(spark):
    rows = [
        (1, "Correct", "Spam", "s", "b"), (2, "correct", "Spam", "s", "b"), (3, "Wrong", "Other", "s", "b"),
        (4, "Wrong", "Spam", " ", None), (5, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, feedback_status string, correct_category string, subject string, body string")
    reasons = [r["rejected"] for r in B.validate(df).orderBy("id").collect()]
    assert reasons == [
        None, "status must be Correct or Wrong", "unknown category", "empty e-mail", "status must be Correct or Wrong",
    ]
    stored = spark.createDataFrame(
        [(1, "t", "Spam", "Legitimate"), (3, "t", None, "Spam"), (2, "u", "Legitimate", "Spam")],
        "id int, clean_email_text string, correct_category string, predicted_category string",
    )
    got = {r["clean_email_text"]: r["category"] for r in B.training_candidates(stored).collect()}
    assert got == {"t": "Spam", "u": "Legitimate"}


def test_no_window_over_a_whole_class(spark, sf_dir):
    """The split compares rows with the cut rows of their class; the wide side is not shuffled."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("email_id"), F.col("source").alias("category"), "text"
    )
    plan = T.stratified_split(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_broadcast_limit(spark):
    from mailsieve.operators.bounded import broadcast_bounded

    small = broadcast_bounded(spark.range(10).toDF("k"), 10)
    assert "hint" in str(small._jdf.queryExecution().analyzed()).lower() and small.count() == 10
    with pytest.raises(ValueError, match="too many groups"):
        broadcast_bounded(spark.range(11).toDF("k"), 10)


def test_generated_ids_stay_apart(spark):
    numbers = [1, 100_000, 999_999, 1_000_000, 1_000_001, 1_000_009]
    ids = spark.createDataFrame([(i,) for i in numbers], "index long")
    got = [r[0] for r in T.generate_code_mixed(ids, rows=2_000_000).orderBy("email_id").select("email_id").collect()]
    assert sorted(got) == sorted(f"CM_{i:06d}" for i in numbers)


def test_missing_branch_is_an_error(spark):
    one = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "email_id long, embedding array<double>")
    two = spark.createDataFrame([(1, [3.0])], "email_id long, probabilities array<double>")
    three = spark.createDataFrame([(1, [4.0]), (2, [5.0])], "email_id long, structured array<double>")
    with pytest.raises(Exception, match="2 is missing in: probabilities"):
        P.fuse_branches(one, two, three).collect()
    assert P.fuse_branches(one.filter("email_id = 1"), two, three.filter("email_id = 1")).first()[1] == [1.0, 3.0, 4.0]


def test_running_ids_of_many_leading_values(spark):
    rows = spark.range(5000).selectExpr("id % 700 as lead", "id as number", "concat('t', id) as text")
    got = [(r.lead, r.number, r.email_id) for r in P.add_running_id(rows, ["lead", "number"]).collect()]
    want = [(lead, n, i + 1) for i, (lead, n) in enumerate(sorted((i % 700, i) for i in range(5000)))]
    assert sorted(got) == sorted(want)
    assert P.add_running_id(rows.limit(0), ["lead", "number"]).collect() == []


def test_keep_first_with_nulls_in_the_order(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (1, 2, "a"), (None, 3, None), (2, 4, None), (2, 5, "b")], "r long, n long, t string")
    assert sorted(r.n for r in P.keep_first(rows, "t", ["r", "n"]).collect()) == [1, 3, 5]


def test_running_ids_keep_null_and_equal_orders(spark):
    rows = [(None, "a"), (2, "b"), (None, "c"), (1, "d"), (2, "e"), (None, None)]
    got = P.add_running_id(spark.createDataFrame(rows, "n int, t string"), ["n"]).orderBy("email_id").collect()
    assert [r["email_id"] for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r["n"] for r in got] == [None, None, None, 1, 2, 2] and {(r["n"], r["t"]) for r in got} == set(rows)
    alike = spark.range(5000).selectExpr("cast(if(id % 3 = 0, null, 1) as int) as n")
    assert P.add_running_id(alike, ["n"]).agg(F.count_distinct("email_id"), F.max("email_id")).first()[0:2] == (5000, 5000)


def test_verdicts_on_unknown_mail(spark):
    verdicts = spark.createDataFrame([(1, 7, "Correct", "Spam"), (2, 8, "Correct", "Spam"), (3, None, "Wrong", "Spam"), (4, 9, "no", "Spam")], "id int, email_id long, feedback_status string, correct_category string")
    columns = ", ".join(f"'x' as {c}" for c in B.FEATURES_KEPT)
    scored = spark.range(7, 8).selectExpr("id as email_id", "'Spam' as prediction", "0.5 as confidence", "'Spam' as branch_prediction", "0.5 as branch_confidence", *columns.split(", "))
    got = {r["id"]: r["rejected"] for r in B.judged_verdicts(verdicts, scored, blank=F.lit(False)).collect()}
    assert got == {1: None, 2: "unknown e-mail", 3: "unknown e-mail", 4: "status must be Correct or Wrong"}
    assert [r["id"] for r in B.enrich(verdicts, scored, blank=F.lit(False)).collect()] == [1]
