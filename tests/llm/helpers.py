"""Tables of awkward rows shared by the tests of this folder."""

from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while eight small birds sing near an old stone bridge in rain".split()

#: Null and empty texts, ties, repeated rows, a null id, odd characters and a long text.
AWKWARD = [
    (3, "one two three four five six", "en", "a", 27), (1, None, "en", None, None), (2, "", None, "a", 0),
    (4, "one two three four five six", "en", "a", 27), (4, "one two three four five six", "en", "a", 27),
    (None, "no id at all here today", "en", "b", 5), (7, " \n\t ", "en", "b", 4), (8, "é ß 漢字 \U0001f600 \x1c ' 's", "fr", "b", 9),
    (9, "word " * 30_000, "en", "c", 150_000), (10, "x" * 5_000, "en", "c", 5_000),
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def crowded(docs):
    """The same rows with columns whose names the operators use inside."""
    names = ["id", "ids", "words", "kept", "k_text", "bucket", "component", "tail", "shard", "frame", "count", "group", "score", "a", "b"]
    return docs.withColumns({n: F.lit("clash") for n in names})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
