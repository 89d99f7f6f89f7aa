"""Models by inequalities, explanations against brute force."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.operators import boosting as G
from mailsieve.operators import encoders as N
from mailsieve.operators import explain as L
from mailsieve.operators import models as D
from mailsieve.plans import queries as Q


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return Q.split_features(spark, sf_dir)


def hit_rate(df):
    return df.agg(F.avg((F.col("category") == F.col("prediction")).cast("double"))).first()[0]


def majority(df):
    counts = [r["count"] for r in df.groupBy("category").count().collect()]
    return max(counts) / sum(counts)


@pytest.fixture(scope="module")
def fitted(hybrid, rows):
    """Each kind of model; the linear ones and the forest at small sizes."""
    train = rows.filter("split = 'train'")
    return {
        "word": D.fit_logistic_regression(train, "word", vocabulary=2000, max_iter=30),
        "char": D.fit_logistic_regression(train, "char", vocabulary=2000, max_iter=20),
        "forest": D.fit_random_forest(train, vocabulary=2000, trees=20, depth=8),
        "deep": D.fit_deep_forest(train, vocabulary=2000, trees=20),
        "boosted": hybrid.boosted, "hybrid": hybrid,
    }


@pytest.mark.parametrize("name", ["word", "char", "forest", "deep", "boosted", "hybrid"])
def test_better_than_the_largest_class(name, fitted, rows):
    model = fitted[name]
    scored = Q.scored_rows(model, rows)
    if name == "boosted":
        scored = Q.K.with_winner(scored, "probabilities", model.classes)
    assert hit_rate(scored) > majority(scored) + 0.2


@pytest.mark.parametrize("name", ["word", "forest", "deep", "boosted", "hybrid"])
def test_saved_model_scores_alike(name, fitted, rows, spark, tmp_path):
    model, path = fitted[name], str(tmp_path / name)
    few = rows.filter("split = 'test'")
    model.save(path)
    again = type(model).load(spark, path)
    first, second = (m.transform(few).select("email_id", "probabilities").orderBy("email_id").collect() for m in (model, again))
    assert [r["email_id"] for r in first] == [r["email_id"] for r in second] and first
    assert np.allclose([r["probabilities"] for r in first], [r["probabilities"] for r in second])
    with pytest.raises(FileNotFoundError, match="info"):
        type(model).load(spark, str(tmp_path / "nothing"))


def test_every_token_counts(spark):
    words = [f"w{i % 40}" for i in range(400)]
    texts = spark.createDataFrame([(i, " ".join(words[: 200 + i])) for i in range(60)], f"email_id long, {V.TEXT_COLUMN} string")
    encoder = N.fit_text_encoder(texts, size=8, partitions=2)
    vectors = {r["word"]: r["vector"].toArray() for r in encoder.stages[1].getVectors().collect()}
    assert len(vectors) == 40
    for r in encoder.transform(texts).orderBy("email_id").collect()[::20]:
        want = np.mean([vectors[w] for w in r[V.TEXT_COLUMN].split(" ")], axis=0)
        assert np.allclose(r["embedding_vector"].toArray(), want, atol=1e-6)


def test_vocabulary_bound_keeps_the_most_frequent(spark):
    texts = spark.createDataFrame([(1, " ".join(["a"] * 9 + ["b"] * 9 + ["c"] * 7 + ["d"] * 6 + ["e"] * 2))], f"email_id long, {V.TEXT_COLUMN} string")
    for bound, want in ((10, {"a", "b", "c", "d"}), (3, {"a", "b", "c"}), (2, {"a", "b"})):
        encoder = N.fit_text_encoder(texts, size=2, max_words=bound, partitions=1)
        assert {r["word"] for r in encoder.stages[1].getVectors().collect()} == want


def test_probabilities(hybrid, rows):
    scored = hybrid.transform(rows)
    for column in ("probabilities", "branch_probabilities"):
        total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
        low, high = scored.agg(F.min(total), F.max(total)).first()
        assert low == pytest.approx(1.0) and high == pytest.approx(1.0)
    assert hybrid.classes == V.CLASSES_SORTED


def test_missing_parts(spark, tmp_path):
    assert D.missing_parts(spark, str(tmp_path), D.HybridModel.PARTS) == list(D.HybridModel.PARTS)
    with pytest.raises(FileNotFoundError, match="network"):
        D.HybridModel.load(spark, str(tmp_path))


def test_width_check(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, a array<double>").withColumn("v", N.to_vector("a"))
    with pytest.raises(Exception, match="expected 2 fusion features, got 1"):
        D.check_width(df, "v", 2).collect()


def test_scored_mail(spark, sf_dir, hybrid):
    mail = spark.createDataFrame(
        [(1, "Verify", "please verify hxxps://bank[.]test/login"), (2, " ", None), (3, None, "hello")],
        "email_id long, subject string, body string",
    )
    got = {r["email_id"]: r for r in D.score_emails(mail, hybrid).collect()}
    assert set(got) == {1, 3}
    assert got[1]["highest_url_risk"] == "High" and got[3]["highest_url_risk"] == "None"
    assert sum(got[1]["probabilities"].values()) == pytest.approx(1.0, abs=1e-3)
    assert got[1]["risk"] == V.CLASS_RISK[got[1]["prediction"]]
    assert len(got[1]["reasons"]) >= 6


def test_unit_length_and_smooth_idf(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],)], "g array<string>")
    model = N.fit_tfidf(N.gram_counts(df, F.col("g")), 2, 10, "g")
    vectors = [r["tfidf"].toArray() for r in model.transform(df).collect()]
    idf_b = np.log(3 / 2) + 1
    want = np.array([2.0, idf_b]) / np.hypot(2.0, idf_b)
    assert sorted(vectors[0]) == pytest.approx(sorted(want))
    assert model.transform(df).columns == ["g", "tfidf"]


def test_both_ways_to_count_grams(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias(V.TEXT_COLUMN))
    by_word = N.char_gram_counts(texts)
    direct = N.gram_counts(texts, N.char_wb_grams(F.col(V.TEXT_COLUMN)))
    assert by_word.exceptAll(direct).count() == direct.exceptAll(by_word).count() == 0


@pytest.mark.parametrize("size,cells", [(50, None), (50, 8), (50, 300), (3000, 4096), (10**6, 1 << 12)])
def test_most_frequent_grams_for_any_number_of_cells(spark, sf_dir, size, cells):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias(V.TEXT_COLUMN))
    plain = N.vocabulary(N.char_gram_counts(texts), size)
    pruned = N.top_char_grams(texts, size, cells=cells)
    assert pruned.orderBy(F.desc("occurrences"), "gram").collect() == plain.orderBy(F.desc("occurrences"), "gram").collect()


def test_most_frequent_grams_with_ties_and_without_rows(spark):
    df = spark.createDataFrame([(["b", "a", "c"],), (["c", "d", "b", "a"],), ([],), (None,)], "g array<string>")
    for cells in (1, 2, 64):
        assert [tuple(r) for r in N.top_grams(df, F.col("g"), 2, cells).collect()] == [("a", 2, 2), ("b", 2, 2)]
        assert N.top_grams(df.limit(0), F.col("g"), 2, cells).count() == 0


def test_tasks_count_grams_before_they_hand_them_on(spark):
    rows = [(["a", "b", "a", None],), (["b", "c"],), ([],), (None,), ([None, "a", None],)]
    df = spark.createDataFrame(rows, "g array<string>").coalesce(1)
    want = {("a", 2, 3), ("b", 2, 2), ("c", 1, 1), (None, 2, 3)}
    # A row for each gram of a task, not one for each place.
    assert {tuple(r) for r in N._counted_in_tasks(df, F.col("g")).collect()} == want
    assert N._counted_in_tasks(df, F.col("g")).count() == 4
    assert {tuple(r) for r in N.gram_counts(df.repartition(3), F.col("g")).collect()} == want


def test_grams_of_many_slices_add_up(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(N, "GRAM_ROWS", 2)
    lists = pa.array([["x"], ["a", "b", "a", "c"], None, [], ["c", "d", "e"]], pa.list_(pa.string()))
    found = pa.Table.from_batches(N._counts_of(pa.chunked_array([lists.slice(1, 2), lists.slice(3)]))).to_pydict()
    assert sorted(zip(found["gram"], found["d"], found["o"])) == [("a", 1, 2), ("b", 1, 1), ("c", 2, 2), ("d", 1, 1), ("e", 1, 1)]


def test_word_vectors_and_trees_are_fitted_at_the_same_time(spark, monkeypatch):
    both = threading.Barrier(2, timeout=20)  # broken if one waits for the other to end

    def meeting(fit):
        def run(*args, **options):
            both.wait()
            return fit(*args, **options)

        return run

    monkeypatch.setattr(N, "fit_text_encoder", meeting(N.fit_text_encoder))
    monkeypatch.setattr(D, "fit_boosted_trees", meeting(D.fit_boosted_trees))
    words = {"Legitimate": "plain report of the week", "Spam": "claim the prize now"}
    mail = [(i, name, f"{text} {i % 7}") for i, name in enumerate(["Legitimate", "Spam"] * 30) for text in [words[name]]]
    rows = Q.E.build_features(spark.createDataFrame(mail, "email_id long, category string, body string").withColumn("subject", F.col("category")))
    model = D.fit_hybrid(rows, embedding_size=4, rounds=2, depth=2, hidden=(8, 8, 8), max_iter=2)
    assert model.classes == ["Legitimate", "Spam"] and model.transform(rows).count() == 60


def test_external_encoder_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], f"id int, {V.TEXT_COLUMN} string")
    got = N.encode_with(df, lambda texts: [[float(len(t)), 1.0] for t in texts]).orderBy("id").collect()
    assert [r["embedding"] for r in got] == [[2.0, 1.0], [0.0, 1.0]]


def test_occlusion_against_single_removals(spark, hybrid, rows):
    # A small fixture: brute force removes the words one by one in plain Python.
    few = rows.orderBy("email_id").limit(3).select("email_id", V.TEXT_COLUMN, *V.STRUCTURED_COLUMNS)
    few = spark.createDataFrame(few.collect(), few.schema)
    got = {r["email_id"]: r for r in L.occlusion(few, hybrid).collect()}
    base = hybrid.transform(few).collect()
    candidates = {
        r["email_id"]: r["w"] for r in few.select("email_id", L.occlusion_candidates(F.col(V.TEXT_COLUMN)).alias("w")).collect()
    }
    for row in base:
        winner = hybrid.classes.index(row["prediction"])
        changed = [(i, w, row[V.TEXT_COLUMN].replace(w, "", 1)) for i, w in enumerate(candidates[row["email_id"]])]
        texts = spark.createDataFrame(changed, f"i int, w string, {V.TEXT_COLUMN} string").withColumns(
            {
                "branch_probabilities": F.array(*[F.lit(x) for x in row["branch_probabilities"]]),
                "structured": F.array(*[F.lit(x) for x in row["structured"]]),
            }
        )
        scored = hybrid.fuse(hybrid.encoder.transform(texts)).collect()
        drops = sorted(((round(row["confidence"] - r["probabilities"][winner], 12), -r["i"], r["w"]) for r in scored), reverse=True)
        want = [w for d, _, w in drops if d > 0][:5]
        assert [d["name"] for d in got[row["email_id"]]["top_words"]] == want
        sizes = [d for d, _, _ in drops if d > 0][:5]
        assert [d["value"] for d in got[row["email_id"]]["top_words"]] == pytest.approx(sizes, abs=1e-6)
        assert got[row["email_id"]]["prediction"] == row["prediction"]


def test_occlusion_without_words(spark, hybrid, rows):
    one = rows.limit(1).select("email_id", *V.STRUCTURED_COLUMNS).withColumn(V.TEXT_COLUMN, F.lit("a an"))
    assert L.occlusion(one, hybrid).first()["explanation"] == ""


def test_remove_first(spark):
    df = spark.createDataFrame([("a+b a+b", "a+b"), ("x.y", "y"), ("ab", "ab")], "t string, w string")
    assert [r[0] for r in df.select(L.remove_first(F.col("t"), F.col("w"))).collect()] == [" a+b", "x.", ""]


def test_perturbed_texts(spark):
    mail = spark.createDataFrame([(1, "s", "one two, two three"), (2, "only subject", " "), (3, "", "...")], "email_id long, subject string, body string")
    got = L.perturbed_texts(mail, 50).collect()
    assert {r["email_id"] for r in got} == {1, 2}
    whole = {r["email_id"]: r for r in got if r["sample"] == 0}
    assert whole[1]["body"] == "one two, two three" and set(whole[1]["mask"]) == {1}
    assert whole[2]["subject"] == "only subject"
    for r in got:
        if r["email_id"] == 1:
            gone = {w for w, m in zip(r["words"], r["mask"]) if m == 0}
            kept = "".join(t for t in ["one", " ", "two", ", ", "two", " ", "three"] if t not in gone)
            assert r["body"] == kept
    assert len({tuple(r["mask"]) for r in got if r["email_id"] == 1}) > 3


def test_samples_by_sums_equal_full_rescoring(spark, sf_dir, hybrid):
    mail = [
        (1, "Verify now", "please verify: https://bank-login.example.com/verify?x=1, or write to a.b@mail.example.org today! Please."),
        (2, "only a subject, with pass-word", " "), (3, "", "hello"), (4, "  ", "\u0d85\u0db8\u0dca\u0db8\u0dcf hello  there\n\n\u0b85 www.x.test www.x.test hxxp://a[.]b"),
        (5, None, "(...) 12_3 \u00c9t\u00e9 'bank' bank-bank; bank"), (6, "s", "one\u2028two\x1cthree  \t four"), (7, "x@y.zz", "a@b.cc a@b.cc!"),
    ]
    mail = spark.createDataFrame(mail, "email_id long, subject string, body string")
    some = Q.emails(spark, sf_dir).select("email_id", "subject", "body").filter("email_id % 15 = 0").withColumn("email_id", F.col("email_id") + 100)
    mail = mail.unionByName(some.filter("instr(concat(subject, body), '<') = 0"))
    fast, full = (
        {(r["key"], r["sample"]): r for r in way(mail, hybrid, 60).collect()} for way in (L.sample_scores, L.rescored_samples)
    )
    assert fast.keys() == full.keys() and len(fast) >= 60 * 12
    for at, r in full.items():
        assert list(fast[at]["mask"]) == list(r["mask"]) and fast[at]["explained_field"] == r["explained_field"]
        assert np.allclose(fast[at]["probabilities"], r["probabilities"], atol=1e-5), at
        assert fast[at]["words"] == r["words"]


def test_surrogate_hands_on_bounded_batches(spark, monkeypatch):
    import pyarrow as pa

    class Rows:
        schema = spark.createDataFrame([], "email_id bigint").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    rng = np.random.default_rng(1)
    words = [[f"w{i}x{j}" for j in range(50)] for i in range(400)]
    masks = [rng.integers(0, 2, (100, 50)).tolist() for _ in words]
    columns = [
        pa.array(range(400), pa.int64()), pa.array(words), pa.array([[[w] for w in ws] for ws in words]), pa.array(words),
        pa.array(masks, pa.list_(pa.list_(pa.int8()))),
    ]
    batch = pa.RecordBatch.from_arrays(columns, ["email_id", "_chunks", "_pieces", "words", "_mask"])
    monkeypatch.setattr(L, "OUT_BYTES", 1 << 20, raising=False)
    out = list(L._forms(Rows(), "email_id")(iter([batch])))
    assert max(b.nbytes for b in out) < 2 << 20 and [k for b in out for k in b.column(0).to_pylist()] == list(range(400))
    got = [m for b in out for m in b.column(4).to_pylist()]
    assert got == [np.array(m, np.int8).tobytes() for m in masks]


def test_surrogate_writes_no_masks(spark, sf_dir, hybrid, monkeypatch):
    written, plain = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, label: written.append(df.columns) or plain(df, label))
    mail = Q.emails(spark, sf_dir).filter("email_id = 0").select("email_id", "subject", "body")
    assert L.sample_scores(mail, hybrid, 50).count() == 50
    assert written and not any("_mask" in columns for columns in written)


def test_surrogate_ridge_against_normal_equations():
    import pandas as pd

    rng = np.random.default_rng(0)
    masks = rng.integers(0, 2, (60, 6))
    masks[0] = 1
    p = 0.2 + masks[:, 1] * 0.5 - masks[:, 4] * 0.1 + rng.normal(0, 0.01, 60)
    pdf = pd.DataFrame(
        {
            "sample": range(60), "mask": [m.tolist() for m in masks], "probabilities": [[x, 1 - x - 0.3, 0.0] for x in p],
            "words": [list("abcdef")] + [None] * 59, "explained_field": "body",
        }
    )
    out = L._fit_surrogate(6, ["A", "B", "C"])((9,), pdf)
    x = masks.astype(float)
    w = np.sqrt(np.exp(-(((1 - np.sqrt(x.sum(1) / 6)) * 100) ** 2) / 625))
    design = np.column_stack([x, np.ones(60)])
    penalty = np.diag([1.0] * 6 + [0.0])
    coef = np.linalg.solve(design.T @ (design * w[:, None]) + penalty, design.T @ (w * p))
    want = dict(zip("abcdef", coef))
    assert out["predicted_class"].iloc[0] == "A"
    assert {t: pytest.approx(v, abs=1e-5) for t, v in zip(out["term"], out["weight"])} == want
    assert out["term"].iloc[0] == "b"


def test_surrogate_names_the_cause(spark, sf_dir, hybrid):
    mail = Q.emails(spark, sf_dir).filter("email_id < 6").select("email_id", "subject", "body")
    got = L.word_surrogate(mail, hybrid, num_features=4, num_samples=50)
    assert got.filter("num_samples <> 50").count() == 0
    for wrong in (dict(num_samples=10), dict(num_samples=501), dict(num_features=0), dict(num_features=21)):
        with pytest.raises(ValueError, match="between"):
            L.word_surrogate(mail, hybrid, **wrong)
    assert got.groupBy("email_id").count().filter("count > 4").count() == 0


def subset_value(trees, class_, row, known, player_of):
    """The expected margin with only the known players, tree by tree."""

    def down(r, i):
        f, rows = trees.feature[r, class_, i], trees.rows[r, class_]
        if f < 0:
            return trees.value[r, class_, i]
        left, right = 2 * i + 1, 2 * i + 2
        if player_of[f] in known:
            return down(r, right if row[f] >= trees.cut[r, class_, i] else left)
        return (rows[left] * down(r, left) + rows[right] * down(r, right)) / rows[i]

    return sum(down(r, 0) for r in range(len(trees.feature)))


def test_attribution_against_all_subsets(spark, hybrid, rows):
    model = hybrid.boosted
    few = model.structured.transform(rows).limit(3).collect()
    players, trees = model.players, model.trees.take(slice(0, 40, 8))
    count = max(players) + 1
    for r in few:
        x = np.array(r["structured"])
        for class_ in (0, 3):
            value = [subset_value(trees, class_, x, {i for i in range(count) if s >> i & 1}, players) for s in range(1 << count)]
            want = [
                sum(
                    math.factorial(s.bit_count()) * math.factorial(count - 1 - s.bit_count()) / math.factorial(count) * (value[s | 1 << i] - value[s])
                    for s in range(1 << count) if not s >> i & 1
                )
                for i in range(count)
            ]
            got = G.Attribution(trees, class_, players, count)
            assert got.base == pytest.approx(value[0]) and np.allclose(got.values(x[None])[0], want, atol=1e-12)


def test_attribution_adds_up(spark, hybrid, rows):
    table = L.structured_attribution(rows, hybrid.boosted, top=25)
    sums = table.groupBy("email_id", "predicted_class", "expected_value", "margin").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    assert sums.filter("abs(v + expected_value - margin) > 0.00001 or n <> 10").count() == 0
    # The expected value is the mean margin of all training rows.
    train = hybrid.boosted.structured.transform(rows.filter("split = 'train'")).select("structured").collect()
    x, trees = np.array([r[0] for r in train]), hybrid.boosted.trees
    mean = trees.margins(trees.nodes_of_values(x)).mean(0)
    for r in sums.select("predicted_class", "expected_value").distinct().collect():
        assert r["expected_value"] == pytest.approx(mean[hybrid.classes.index(r["predicted_class"])], abs=1e-5)


def boost_rows(spark, n=600):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=(n, 3)), rng.integers(0, 4, n), rng.random(n) > 0.7])
    y = (x[:, 0] > 0.3).astype(int) + ((x[:, 1] * x[:, 2] > 0) & (x[:, 4] > 0))
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "v array<double>, y int").repartition(3)
    return x, y, D.materialize(df, "boost-rows")


def grow(rows, **other):
    options = dict(rounds=3, depth=4, step=0.3, sample=1.0, columns=1.0, seed=1) | other
    return G.fit_trees(rows, "v", "y", 3, 5, range(4, 5), **options)


def test_boosting_against_plain_search(spark):
    """Every cut of two rounds against all cuts of all features over the rows in memory."""
    x, y, rows = boost_rows(spark)
    trees = grow(rows, rounds=2)
    cuts = G.find_cuts(rows, "v", 5, range(4, 5))
    margins = np.zeros((len(x), 3))
    for r in range(2):
        p = G.softmax(margins)
        for k in range(3):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])
            score = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1)
            todo = [(0, np.ones(len(x), bool))]
            while todo:
                i, own = todo.pop()
                f = trees.feature[r, k, i]
                assert trees.rows[r, k, i] == own.sum()
                best = 1e-6
                for feature, edges in enumerate(cuts):
                    for cut in edges:
                        right = own & (x[:, feature] >= cut)
                        left = own & ~right
                        if h[left].sum() >= 1 and h[right].sum() >= 1:
                            best = max(best, score(left) + score(right) - score(own))
                if f < 0:
                    assert trees.value[r, k, i] == pytest.approx(-0.3 * g[own].sum() / (h[own].sum() + 1))
                    assert best == 1e-6 or i >= 15
                else:
                    assert trees.gain[r, k, i] == pytest.approx(best)
                    right = x[:, f] >= trees.cut[r, k, i]
                    todo += [(2 * i + 1, own & ~right), (2 * i + 2, own & right)]
        margins = trees.take(slice(0, r + 1))
        margins = margins.margins(margins.nodes_of_values(x))
    assert (margins.argmax(1) == y).mean() > 0.8


def test_levels_and_whole_subtrees_give_the_same_trees(spark, monkeypatch):
    _, _, rows = boost_rows(spark)
    grown = []
    for limit, keep, block in ((1 << 16, 10, 8192), (0, 1, 8192), (150, 2, 64)):
        monkeypatch.setattr(G, "SUBTREE", limit)
        monkeypatch.setattr(G, "KEEP", keep)
        monkeypatch.setattr(G, "BLOCK", block)
        grown.append(grow(rows))
    for other in grown[1:]:
        for name in ("feature", "bin", "cut", "gain", "rows", "value"):
            assert np.allclose(getattr(grown[0], name), getattr(other, name))


def test_boosting_on_a_hot_class_and_nothing(spark):
    rows = spark.createDataFrame([([float(i % 7)] * 5, 0) for i in range(300)] + [([9.0] * 5, 2)], "v array<double>, y int")
    p = G.probabilities(grow(rows, least_weight=0.0), np.array([[1.0] * 5, [9.0] * 5]))
    assert p[0].argmax() == 0 and p[1, 2] > p[0, 2] and np.allclose(p.sum(1), 1)
    empty = grow(rows.limit(0))
    assert (empty.feature == -1).all() and np.allclose(G.probabilities(empty, np.ones((1, 5))), 1 / 3)


def test_importances(spark, hybrid):
    got = hybrid.boosted.importances(spark).collect()
    raw = hybrid.boosted.raw_importances(spark).collect()
    assert sum(r["importance"] for r in raw) == pytest.approx(1.0) and len(raw) == 10
    assert sum(r["importance"] for r in got) == pytest.approx(1.0)
    assert [r["feature"] for r in got][:9] == V.NUMERIC_FEATURES


def test_limits_fail_loudly(spark, hybrid, rows):
    with pytest.raises(ValueError, match="depth"):
        G.Attribution(G.Trees.empty(1, 2, 7), 0, [0], 1)
    with pytest.raises(ValueError, match="between 1 and 25"):
        Q.K.top_absolute(F.array(), 40)


def test_all_words_can_be_tried(spark):
    text = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(text,)], "t string")
    sizes = df.select(F.size(L.occlusion_candidates(F.col("t"))), F.size(L.occlusion_candidates(F.col("t"), None))).first()
    assert tuple(sizes) == (20, 50)


def test_a_node_of_some_hundred_thousand_rows_is_one_job(spark, monkeypatch):
    n, calls, level_cuts = G.SUBTREE // 6, [], G.level_cuts
    rows = spark.range(n).select(
        F.array((F.col("id") % 97).cast("double"), (F.col("id") % 31).cast("double")).alias("x"), ((F.col("id") % 97 > 40).cast("int") + (F.col("id") % 2).cast("int")).cast("double").alias("y")
    )
    monkeypatch.setattr(G, "level_cuts", lambda *a: calls.append(len(a[3])) or level_cuts(*a))
    fit = lambda: G.fit_trees(rows, "x", "y", 3, 2, range(0), 1, 4, 0.1, 1.0, 1.0, 1)
    whole = fit()
    assert n > 1 << 16 and calls == [3]
    monkeypatch.setattr(G, "SUBTREE", 1 << 16)
    parts = fit()
    assert len(calls) > 2  # level by level
    assert np.array_equal(whole.feature, parts.feature) and np.array_equal(whole.cut, parts.cut) and np.allclose(whole.value, parts.value)


def test_rows_that_are_there_are_not_split_again(spark, monkeypatch):
    monkeypatch.setattr(Q, "split_features", None)
    monkeypatch.setattr(Q, "_fitted", {})
    monkeypatch.setattr(D, "fit_hybrid", lambda train, validation: (train.count(), validation.count()))
    rows = spark.createDataFrame([(1, "train"), (2, "train"), (3, "validation"), (4, "test")], "email_id long, split string")
    assert Q.hybrid_model(spark, "nowhere", rows) == (2, 1)
