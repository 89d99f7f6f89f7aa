"""Classifier branches, the fused model and batch scoring (Spark ML)."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.functions import features as E
from mailsieve.functions import reasons as R
from mailsieve.functions import text as X
from mailsieve.functions import urls as U
from mailsieve.operators import boosting as G
from mailsieve.operators import encoders as N
from mailsieve.operators import forest as B
from mailsieve.operators import ranking as K
from mailsieve.operators import sampling as T
from mailsieve.operators.network import Network, fit_network
from mailsieve.operators.prepare import lookup
from mailsieve.session import ensure_checkpoint_dir, materialize

BRANCH_KEY = "email_id"


def class_id(label: str, classes: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("double")


MAX_CLASSES = 1000


def class_names(train: DataFrame) -> list[str]:
    """The distinct classes in alphabetical order; there are few of them, or it is the wrong column."""
    found = train.select(V.TARGET_COLUMN).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"over {MAX_CLASSES} classes in {V.TARGET_COLUMN}")
    return sorted(r[0] for r in found)


def _result(df: DataFrame, classes: list[str]) -> DataFrame:
    """Probability vector -> array, winner and confidence."""
    with_array = df.withColumn("probabilities", vector_to_array("_probability"))
    return K.with_winner(with_array, "probabilities", classes).drop("_probability", "_raw", "_id")


# --- storing -------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def missing_parts(spark: SparkSession, path: str, parts: tuple[str, ...]) -> list[str]:
    """Names of the model parts that are absent under a path."""
    return [part for part in parts if not _exists(spark, f"{path}/{part}")]


def _need(spark: SparkSession, path: str, parts: tuple[str, ...]) -> None:
    absent = missing_parts(spark, path, parts)
    if absent:
        raise FileNotFoundError("missing model parts: " + ", ".join(absent))


def _write_info(path: str, info: dict) -> None:
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(json.dumps(info),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/info")


def _read_info(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/info").first()[0])


def _structured_info(s: N.StructuredEncoder) -> dict:
    return {"numeric": s.numeric, "categorical": s.categorical, "means": s.means, "stds": s.stds, "levels": s.levels}


def _structured_from(info: dict) -> N.StructuredEncoder:
    return N.StructuredEncoder(info["numeric"], info["categorical"], info["means"], info["stds"], info["levels"])


# --- linear and forest branches ---------------------------------------------------


@dataclass
class TextModel:
    """A linear or forest classifier on TF-IDF of word or character n-grams plus structured features."""

    classes: list[str]
    structured: N.StructuredEncoder
    tfidf: PipelineModel
    classifier: object
    analyzer: str

    def features(self, df: DataFrame) -> DataFrame:
        return _text_features(df, self.analyzer, self.structured, self.tfidf)

    def transform(self, df: DataFrame) -> DataFrame:
        return _result(self.classifier.transform(self.features(df)), self.classes).drop("_x", "tfidf", "grams")

    PARTS = ("tfidf", "classifier", "info")
    KINDS = {k.__name__: k for k in (LogisticRegressionModel, RandomForestClassificationModel, B.Forest)}

    def save(self, path: str) -> None:
        self.tfidf.write().overwrite().save(f"{path}/tfidf")
        if isinstance(self.classifier, B.Forest):
            self.classifier.save(f"{path}/classifier")
        else:
            self.classifier.write().overwrite().save(f"{path}/classifier")
        kind = type(self.classifier).__name__
        _write_info(path, {"classes": self.classes, "analyzer": self.analyzer, "kind": kind, "structured": _structured_info(self.structured)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextModel":
        _need(spark, path, cls.PARTS)
        info = _read_info(spark, path)
        classifier = cls.KINDS[info["kind"]].load(f"{path}/classifier")
        tfidf = PipelineModel.load(f"{path}/tfidf")
        return cls(info["classes"], _structured_from(info["structured"]), tfidf, classifier, info["analyzer"])


def _grams(df: DataFrame, analyzer: str) -> DataFrame:
    if analyzer == "char":
        return df.withColumn("grams", N.char_wb_grams(F.col(V.TEXT_COLUMN)))
    return N.word_grams(df)


def _text_features(df, analyzer, structured, tfidf) -> DataFrame:
    encoded = tfidf.transform(structured.transform(_grams(df, analyzer)))
    ready = encoded.withColumn("_s", array_to_vector("structured"))
    sizes = {"tfidf": N.vocabulary_size(tfidf), "_s": len(structured.names)}
    return N.assemble(ready, sizes, "_x").drop("_s", "structured", "grams")


def _fit_text_model(train: DataFrame, analyzer: str, vocabulary: int, make_classifier) -> TextModel:
    """Fit encoders and a classifier with balanced class weights. The encoded rows are written once, as
    an iterative fit reads them many times."""
    train = train.filter(F.col(V.TARGET_COLUMN).isNotNull())
    weighted = T.with_balanced_weight(train)
    classes = class_names(train)
    structured = N.StructuredEncoder().fit(train)
    if analyzer == "char":
        counts = N.top_char_grams(train, vocabulary)
    else:
        counts = N.top_grams(_grams(train, analyzer), F.col("grams"), vocabulary)
    tfidf = N.fit_tfidf(counts, train.count(), vocabulary)
    ensure_checkpoint_dir(train.sparkSession)
    encoded = _text_features(weighted, analyzer, structured, tfidf).select(
        "_x", "weight", class_id(V.TARGET_COLUMN, classes).alias("_id")
    )
    rows = materialize(encoded, "text-features")
    classifier = make_classifier(rows).fit(rows)
    return TextModel(classes, structured, tfidf, classifier, analyzer)


_COLUMNS = dict(
    featuresCol="_x", labelCol="_id", predictionCol="_p", probabilityCol="_probability", rawPredictionCol="_raw"
)


def fit_logistic_regression(
    train: DataFrame, analyzer="word", vocabulary=50_000, max_iter=1000, c=1.0, tolerance=1e-4
) -> TextModel:
    """Multinomial logistic regression with balanced weights; penalty 1 / (c * rows).

    The steps end when the loss falls by less than ``tolerance`` of itself, at ``max_iter`` at the latest.
    """

    def make(rows: DataFrame):
        n = max(rows.count(), 1)
        return LogisticRegression(
            **_COLUMNS, weightCol="weight", family="multinomial", maxIter=max_iter, regParam=1.0 / (c * n),
            elasticNetParam=0.0, standardization=False, tol=tolerance,
        )

    return _fit_text_model(train, analyzer, vocabulary, make)


def fit_random_forest(train: DataFrame, analyzer="char", vocabulary=15_000, trees=200, depth=30, seed=V.SEED) -> TextModel:
    def make(_rows: DataFrame):
        return RandomForestClassifier(
            **_COLUMNS, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt",
        )

    return _fit_text_model(train, analyzer, vocabulary, make)


def fit_deep_forest(train: DataFrame, analyzer="char", vocabulary=15_000, trees=200, leaf_rows=1, seed=V.SEED) -> TextModel:
    """A random forest whose trees grow until their leaves are pure; ``fit_random_forest`` ends at a depth of 30."""

    class Maker:
        def __init__(self, rows: DataFrame):
            self.shape = rows.select(F.max("_id"), F.max(F.size(vector_to_array("_x")))).first()

        def fit(self, rows: DataFrame) -> B.Forest:
            classes, width = self.shape
            return B.fit_forest(rows, "_x", "_id", "weight", int(classes) + 1, width, trees, leaf_rows, seed)

    return _fit_text_model(train, analyzer, vocabulary, Maker)


# --- boosted trees on structured features ------------------------------------


@dataclass
class BoostedModel:
    """Trees boosted on the softmax loss of all classes."""

    classes: list[str]
    structured: N.StructuredEncoder
    trees: G.Trees

    def transform(self, df: DataFrame, output: str = "probabilities") -> DataFrame:
        """Add ``output`` (array) and ``structured`` (array)."""
        return self.score(self.structured.transform(df), "structured", output)

    def score(self, df: DataFrame, structured: str, output: str) -> DataFrame:
        t = self.trees  # only what scoring needs goes to the tasks
        light = G.Trees(t.feature.astype("int16"), None, t.cut, None, None, t.value)

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(G.probabilities(light, np.stack(x))) if len(x) else [])

        return df.withColumn(output, run(F.col(structured)))

    @property
    def players(self) -> list[int]:
        """The raw feature that each encoded one comes from."""
        numeric = len(self.structured.numeric)
        return [*range(numeric), *[numeric] * len(self.structured.levels)]

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.trees.table(spark).write.mode("overwrite").parquet(f"{path}/trees")
        rounds, classes, _ = self.trees.feature.shape
        _write_info(path, {"classes": self.classes, "structured": _structured_info(self.structured), "shape": [rounds, classes, self.trees.depth]})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedModel":
        _need(spark, path, ("trees", "info"))
        info = _read_info(spark, path)
        # One row for each node: rounds x classes x 2 ** (depth + 1) at most.
        trees = G.Trees.from_rows(spark.read.parquet(f"{path}/trees").collect(), *info["shape"])
        return cls(info["classes"], _structured_from(info["structured"]), trees)

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance): the mean gain of the cuts of each encoded feature, as shares."""
        names = self.structured.names
        return spark.createDataFrame(list(zip(names, self.trees.mean_gains(len(names)))), "feature string, importance double")

    def raw_importances(self, spark: SparkSession) -> DataFrame:
        """The same by raw feature: the shares of the levels of a category are added."""
        names, gains = self.structured.numeric + [self.structured.categorical], self.trees.mean_gains(len(self.structured.names))
        sums = [0.0] * len(names)
        for player, gain in zip(self.players, gains):
            sums[player] += gain
        return spark.createDataFrame(list(zip(names, sums)), "feature string, importance double")


def fit_boosted_trees(train: DataFrame, rounds=300, depth=5, step=0.05, sample=0.9, seed=V.SEED) -> BoostedModel:
    """Trees on the softmax loss; ``sample``: the share of rows of a round, and of features of a tree."""
    train = train.filter(F.col(V.TARGET_COLUMN).isNotNull())
    classes = class_names(train)
    structured = N.StructuredEncoder().fit(train)
    rows = materialize(structured.transform(train).select("structured", class_id(V.TARGET_COLUMN, classes).alias("_id")), "structured-features")
    flags = range(len(structured.numeric), len(structured.names))
    trees = G.fit_trees(rows, "structured", "_id", len(classes), len(structured.names), flags, rounds, depth, step, sample, sample, seed)
    return BoostedModel(classes, structured, trees)


# --- fusion --------------------------------------------------------------------


@dataclass
class HybridModel:
    """Text encoder, boosted trees and a network over [embedding, probabilities, structured]."""

    encoder: PipelineModel
    boosted: BoostedModel
    scaler: PipelineModel
    network: Network
    info: dict = field(default_factory=dict)

    @property
    def classes(self) -> list[str]:
        return self.boosted.classes

    def branches(self, features: DataFrame) -> DataFrame:
        """Feature rows -> embedding vector, branch probabilities and structured array."""
        return self.boosted.transform(self.encoder.transform(features), "branch_probabilities")

    def fuse(self, rows: DataFrame) -> DataFrame:
        """Rows with the three branch columns -> class probabilities of the network."""
        checked = check_width(_fusion_vector(rows), "fusion_vector", self.info["fusion_width"])
        scored = self.network.transform(self.scaler.transform(checked), "fusion_scaled", "probabilities")
        return K.with_winner(scored, "probabilities", self.classes).drop("fusion_vector", "fusion_scaled")

    def transform(self, features: DataFrame) -> DataFrame:
        """Feature rows -> prediction, confidence, probabilities and the result of the tree branch."""
        fused = self.fuse(self.branches(features))
        p = F.col("branch_probabilities")
        names = F.array(*[F.lit(c) for c in self.classes])
        return fused.withColumns(
            {
                "branch_prediction": F.element_at(names, K.arg_max(p) + 1),
                "branch_confidence": F.array_max(p),
            }
        )

    # Saving writes one folder per part; loading checks that all are there.
    PARTS = ("encoder", "scaler", "network", "boosted", "info")

    def save(self, path: str) -> None:
        self.encoder.write().overwrite().save(f"{path}/encoder")
        self.scaler.write().overwrite().save(f"{path}/scaler")
        self.network.save(f"{path}/network")
        self.boosted.save(f"{path}/boosted")
        _write_info(path, self.info)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "HybridModel":
        _need(spark, path, cls.PARTS)
        return cls(
            PipelineModel.load(f"{path}/encoder"),
            BoostedModel.load(spark, f"{path}/boosted"),
            PipelineModel.load(f"{path}/scaler"),
            Network.load(spark, f"{path}/network"),
            _read_info(spark, path),
        )


def _fusion_vector(rows: DataFrame) -> DataFrame:
    parts = F.concat(vector_to_array("embedding_vector"), F.col("branch_probabilities"), F.col("structured"))
    return rows.withColumn("fusion_vector", array_to_vector(parts))


def check_width(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Fail on the first row whose vector has another width; costs no extra pass."""
    size = F.size(vector_to_array(vector))
    message = F.concat(F.lit(f"expected {width} fusion features, got "), size.cast("string"))
    return df.withColumn(
        vector, F.when(size == width, F.col(vector)).otherwise(F.raise_error(message).cast(df.schema[vector].dataType))
    )


def fit_hybrid(
    train: DataFrame, embedding_size=64, rounds=300, depth=5, hidden=(512, 256, 128), max_iter=40,
    seed=V.SEED, encoder=None, validation: DataFrame | None = None,
) -> HybridModel:
    """Fit word vectors and trees at the same time, then the network, its loss weighted by balanced class weights.

    Neither of the first two reads the other, and neither fills a cluster: the vectors are trained in few long tasks, a
    round of trees ends in a task for each class.

    ``train`` is read several times, so a computed table should be written first. ``validation`` rows tell when the network
    is done; without any, a tenth of ``train``, by a hash of the key, is kept for that. ``encoder`` may be any
    transformer that adds ``embedding_vector`` of ``embedding_size`` components; by default one is fitted.
    """
    train = train.filter(F.col(V.TARGET_COLUMN).isNotNull())
    mean_of_tokens = encoder is None
    with ThreadPoolExecutor(1) as side:
        growing = side.submit(inheritable_thread_target(train.sparkSession)(fit_boosted_trees), train, rounds=rounds, depth=depth, seed=seed)
        if encoder is None:
            encoder = N.fit_text_encoder(train, size=embedding_size)
        boosted = growing.result()
    model = HybridModel(encoder, boosted, None, None)

    def fused(rows: DataFrame, held: Column) -> DataFrame:
        known = rows.filter(F.col(V.TARGET_COLUMN).isin(boosted.classes))
        return _fusion_vector(model.branches(known)).select(
            BRANCH_KEY, "fusion_vector", V.TARGET_COLUMN, class_id(V.TARGET_COLUMN, boosted.classes).alias("_id"), held.alias("_held")
        )

    if validation is None:
        rows = fused(train, F.pmod(F.xxhash64(F.lit("held out"), BRANCH_KEY), F.lit(10)) == 0)
    else:
        rows = fused(train, F.lit(False)).unionByName(fused(validation, F.lit(True)))
    rows = materialize(rows, "fusion")
    width = embedding_size + len(boosted.classes) + len(boosted.structured.names)
    model.info = {"fusion_width": width, "embedding_size": embedding_size, "mean_of_tokens": mean_of_tokens}
    model.scaler = N.fit_vector_scaler(rows.filter("not _held"), "fusion_vector", "fusion_scaled")
    weights = T.balanced_weights(rows.filter("not _held")).select(V.TARGET_COLUMN, "weight")  # a row for each class
    weighted = rows.join(weights, V.TARGET_COLUMN, "left").fillna(1.0, ["weight"])
    model.network = fit_network(
        model.scaler.transform(weighted), "fusion_scaled", "_id", "weight", "_held", width, len(boosted.classes), hidden, epochs=max_iter, seed=seed,
        key=BRANCH_KEY,
    )
    return model


# --- batch scoring ---------------------------------------------------------------


def score_emails(mail: DataFrame, model: HybridModel, rules: X.TextRules = X.SERVING) -> DataFrame:
    """(email_id, subject, body) -> class, confidence, risk, probabilities, branch result, URL report, reasons."""
    raw_text = X.join_text(F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    with_urls = mail.withColumn("url_report", U.weighted_url_reports(E.extract_urls(raw_text, rules)))
    scored = model.transform(E.build_features(with_urls, rules))
    names = F.array(*[F.lit(c) for c in model.classes])
    scored = scored.withColumn("highest_url_risk", U.highest_weighted_risk(F.col("url_report")))
    return scored.withColumns(
        {
            "risk": F.coalesce(lookup(F.col("prediction"), V.CLASS_RISK), F.lit(V.DEFAULT_RISK)),
            "reasons": R.service_reasons(
                F.col("prediction"), F.col("confidence"), F.col("branch_prediction"), F.col("branch_confidence"),
                F.col("highest_url_risk"),
            ),
            "probabilities": F.map_from_arrays(
                names, F.transform("probabilities", lambda p: X.round_even(p, 4))
            ),
            "confidence": X.round_even(F.col("confidence"), 4),
            "branch_confidence": X.round_even(F.col("branch_confidence"), 4),
        }
    )
