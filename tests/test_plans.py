"""Physical plans: no cross joins, no Python in expression work, narrow scans, partial aggregation."""

import re

import pytest

from mailsieve.plans.queries import QUERIES

NAMES = [
    "f9_features", "u4_mail_report", "h6_header_risk", "r4_keep_first", "r7_duplicate_counts", "j3_fuse_branches",
    "t1_stratified_split", "a4_describe", "a6_box_plot", "m3_report", "k1_probability_ranking", "e3_word_grams",
    "x1_service_reasons", "b2_enrich", "b4_training_candidates",
]


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_and_no_python(name, spark, sf_dir):
    text = plan(spark, sf_dir, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "RoundRobin"):
        assert word not in text


def test_scans_are_narrow(spark, sf_dir):
    assert re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, sf_dir, "a1_class_distribution")) == ["doc_id:bigint"]
    documents = [s for s in re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, sf_dir, "f7_entropy"))]
    assert documents == ["doc_id:bigint,text:string"]


def test_text_work_needs_no_shuffle_of_its_own(spark, sf_dir):
    from mailsieve.functions.features import build_features

    mail = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "source as subject", "text as body")
    text = build_features(mail)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_counts_combine_before_the_shuffle(spark, sf_dir):
    for name in ("m3_report", "r7_duplicate_counts", "a1_class_distribution", "e3_word_grams"):
        text = plan(spark, sf_dir, name)
        assert "partial_" in text.split("FileScan")[0]


class Settings:
    """A table of a session with other settings."""

    def __init__(self, **settings):
        self.sparkSession = self.conf = self
        self.settings = settings

    def get(self, key, default=None):
        return self.settings.get(key.replace("spark.", "", 1).replace(".", "_"), default)


@pytest.mark.parametrize("master", ["yarn", "k8s://host", "spark://host:1", "local-cluster[2,1,1024]"])
def test_a_cluster_reads_its_splits_and_needs_a_shared_folder(master):
    from mailsieve import session

    table = Settings(master=master)
    assert session.spread(table, "k") is table
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(table)
    assert session.shared_folder(Settings(master=master, checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"


def test_nothing_is_left_behind(spark):
    import os

    from mailsieve import session

    session.materialize(spark.range(3), "left")
    assert os.path.isdir(session.scratch_root(spark))
    session.remove_scratch(spark)
    assert not os.path.exists(session.scratch_root(spark))


@pytest.mark.parametrize("name", ["r4_keep_first", "b4_training_candidates"])
def test_texts_are_not_sorted(name, spark, sf_dir):
    for line in plan(spark, sf_dir, name).splitlines():
        if "SortAggregate" in line or " Sort " in line:
            assert "text" not in line.replace("clean_email_text", "text") or "sha2" in line


@pytest.mark.parametrize("name", ["r5_running_id", "t1_stratified_split"])
def test_no_window_without_partitions(name, spark, sf_dir):
    assert "WindowExec" not in plan(spark, sf_dir, name) and "SinglePartition" not in plan(spark, sf_dir, name)
