"""The most frequent keys."""

import pytest

from mailsieve.llm.frequent import most_frequent


@pytest.mark.parametrize("limit, keys", [(10, "abcde"), (4, "abc"), (3, "abc"), (2, "ab"), (1, "a"), (0, "")])
def test_equal_counts_stay_or_go_together(spark, limit, keys):
    counts = spark.createDataFrame([("a", 9), ("b", 7), ("c", 3), ("d", 1), ("e", 1)], "key string, n long")
    assert sorted(r.key for r in most_frequent(counts, limit).collect()) == list(keys)
    assert most_frequent(counts.limit(0), limit).collect() == []
