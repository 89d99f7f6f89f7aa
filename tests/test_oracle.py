"""Every registered query with a SQL twin gives the same rows, columns and types."""

import os

import pytest
from compare import ROOT, compare, connect

import __spark_entry__ as entry

from mailsieve.plans.oracle import ORACLE as TWINS
from mailsieve.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_registry():
    assert set(QUERIES) == set(TWINS)
    assert QUERIES.keys() <= entry.queries().keys() and TWINS.items() <= entry.oracle_sql().items()


def test_package_reaches_the_workers(sf_dir, tmp_path):
    """A driver that alone knows where the package lies, in another working folder."""
    import subprocess
    import sys

    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"print('ROWS', e.queries()['h9_received_count'](s, {sf_dir!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("name", sorted(TWINS))
def test_same_rows(name, spark, con, sf_dir):
    assert compare(spark, con, name, QUERIES[name], TWINS[name], sf_dir) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
