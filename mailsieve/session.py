"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app_name: str = "mailsieve", **conf) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    parallelism = os.cpu_count() or 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, a local session takes a temporary folder that goes with the process. On a cluster that would be
    another disk on every machine, so there it is an error.
    """
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="mailsieve-")
        atexit.register(shutil.rmtree, _fallback, ignore_errors=True)
    return _fallback


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative fits cut their lineage in the checkpoint folder; set one only where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_folder(spark)}/mailsieve-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the application's folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has written so far; results that still read it must be used before."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


#: Bytes of a row group, and rows after which its size is looked at, where single rows are large.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 8}


def materialize(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Cut lineage by writing a table; it survives the loss of an executor.

    ``large_rows``: a row holds a matrix or long lists. A reader decodes up to 4096 rows at once, but never more than a row
    group, so small groups bound its memory.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**LARGE_ROWS if large_rows else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, tasks_per_core: int = 3) -> DataFrame:
    """On one machine, deal rows to all cores by the hash of their id; a cluster reads its splits as they are.

    The small tables of a local run are single row groups, which one task would read and work on alone.
    """
    master = df.sparkSession.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * tasks_per_core, key)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of the application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="mailsieve-package-"), "mailsieve_package.zip")
    with zipfile.ZipFile(path, "w") as package:
        for folder, _, names in sorted(os.walk(home)):
            for name in sorted(n for n in names if n.endswith(".py")):
                place = os.path.join(folder, name)
                package.write(place, os.path.relpath(place, os.path.dirname(home)))
    context.addPyFile(path)
    atexit.register(shutil.rmtree, os.path.dirname(path), ignore_errors=True)
    _shipped.add(context.applicationId)
