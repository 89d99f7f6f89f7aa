"""Corpus and feature tables, array tables, run metadata, feedback store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.operators.prepare import add_running_id, repair_features


def read_corpus(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with header, quoted newlines and doubled quotes; every column stays text.

    A multi-line file is one task, so large corpora should come as many files, or be turned into Parquet once.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV with repair of missing columns, bad numbers and nulls."""
    return repair_features(read_corpus(spark, path))


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with header, UTF-8; one per partition."""
    df.write.mode(mode).options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_arrays(df: DataFrame, path: str, array: str = "embedding", key: str = "email_id") -> None:
    """(key, split, array) as float arrays, one folder per split."""
    write_table(df.select(key, "split", F.col(array).cast("array<float>").alias(array)), path, ["split"])


def read_arrays(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    arrays = spark.read.parquet(path)
    return arrays.filter(F.col("split") == split) if split else arrays


def write_run_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(metadata, ensure_ascii=False),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


METADATA_SCHEMA = (
    "model_name string, max_length int, batch_size int, sample_limit int, embedding_dimension int, "
    "class_names array<string>, train_shape array<long>, validation_shape array<long>, test_shape array<long>"
)


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(path)


def expected_rows(metadata: DataFrame, split: str) -> int:
    return int(metadata.select(F.col(f"{split}_shape")[0]).first()[0])


# --- feedback store --------------------------------------------------------------

# A store is a folder with ``data/batch=<name>`` tables and numbered files in ``commits``. A batch counts once a commit
# names it; the commit also says which id its first row has. Commits are made whole under another name and take their
# number only if it is free, so of two writers one is later, and a crash leaves at most data that no commit names.

_COMMIT = "batch string, first long, rows long"


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _commits(spark: SparkSession, path: str) -> dict[int, object]:
    """Number -> place of the commits; one for each append."""
    system, folder = _hadoop(spark, f"{path}/commits")
    if not system.exists(folder):
        return {}
    places = [status.getPath() for status in system.listStatus(folder)]
    return {int(p.getName().split(".")[0]): p for p in places if p.getName()[0].isdigit()}


def _take_number(spark: SparkSession, path: str, number: int, commit: dict) -> bool:
    """Whether the commit got its number; false where another writer has it."""
    jvm = spark._jvm
    target = f"{path}/commits/{number:012d}.json"
    system, draft = _hadoop(spark, f"{path}/commits/_draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    try:
        if system.getScheme() == "file":
            # A hard link is made only if the name is free, in one step.
            file = lambda p: jvm.java.io.File(jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(file(target), file(draft.toString()))
        else:
            # Elsewhere a rename that does not overwrite: one step on distributed file systems.
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
            options = spark._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(target), options)
        return True
    except Exception as error:
        if "FileAlreadyExists" in str(error) or "FileAlreadyExists" in str(getattr(error, "java_exception", "")):
            return False
        raise
    finally:
        system.delete(draft, False)


def append_feedback(records: DataFrame, path: str, order: str) -> None:
    """Append verdicts with new ids after the largest committed one, in the order of a number column, nulls first.

    Any number of writers: rows are written with their place in the batch, then the batch takes the next free commit
    number; a writer that comes second reads the new end of the store and tries again. No id is used twice, none is left
    out, and a batch is seen whole or not at all.
    """
    spark, path, batch = records.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    folder = f"{path}/data/batch={batch}"
    write_table(add_running_id(records, [order], "id"), folder)
    rows = spark.read.parquet(folder).count()
    if not rows:
        return
    while True:
        commits, first = _commits(spark, path), 1
        number = max(commits, default=0) + 1
        if number > 1:
            last = spark.read.schema(_COMMIT).json(commits[number - 1].toString()).first()
            first = last["first"] + last["rows"]
        if _take_number(spark, path, number, {"batch": batch, "first": first, "rows": rows}):
            return


def stored_feedback(spark: SparkSession, path: str) -> DataFrame:
    """All committed verdicts with their ids."""
    commits = spark.read.schema(_COMMIT).json(f"{path}/commits").select(F.col("batch").alias("_b"), "first")
    data = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    return data.join(commits, F.col("batch") == F.col("_b")).withColumn("id", F.col("first") + F.col("id") - 1).drop("batch", "_b", "first")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return stored_feedback(spark, path).orderBy(F.desc("id"))


def count_feedback(spark: SparkSession, path: str) -> int:
    """Rows of all commits, without reading the batches."""
    return spark.read.schema(_COMMIT).json(f"{path}/commits").agg(F.sum("rows")).first()[0] or 0
