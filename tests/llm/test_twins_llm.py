"""Queries of this folder next to their SQL twins."""

import pytest
from compare import compare, connect

from mailsieve.llm.oracle import ORACLE
from mailsieve.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf_dir):
    assert compare(spark, connect(sf_dir), name, QUERIES[name], ORACLE[name], sf_dir) == []
