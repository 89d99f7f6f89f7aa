"""Feature encoders: scalers, one-hot flags, n-grams, TF-IDF, label ids, dense text vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, StandardScaler,
    StopWordsRemover, StringIndexer, VectorAssembler, VectorSizeHint, Word2Vec,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.functions.text import squeeze
from mailsieve.session import materialize

STRUCTURED_WIDTH_LIMIT = 10_000


@dataclass
class StructuredEncoder:
    """Scaled numbers (mean 0, population standard deviation 1) and one flag per known level.

    Unknown levels give only zeros. Fitting reads two small aggregates.
    """

    numeric: list[str] = field(default_factory=lambda: list(V.NUMERIC_FEATURES))
    categorical: str = V.CATEGORICAL_FEATURES[0]
    means: list[float] = field(default_factory=list)
    stds: list[float] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> "StructuredEncoder":
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in self.numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in self.numeric]
        ).first()
        self.means = [float(row[f"m_{c}"] or 0.0) for c in self.numeric]
        # A constant column is only centred.
        self.stds = [float(row[f"s_{c}"] or 0.0) or 1.0 for c in self.numeric]
        found = df.select(self.categorical).distinct().limit(STRUCTURED_WIDTH_LIMIT + 1).collect()
        if len(found) > STRUCTURED_WIDTH_LIMIT:
            raise ValueError(f"{self.categorical} has more than {STRUCTURED_WIDTH_LIMIT} levels")
        self.levels = sorted(r[0] for r in found if r[0] is not None)
        return self

    @property
    def names(self) -> list[str]:
        return self.numeric + [f"{self.categorical}_{level}" for level in self.levels]

    def scaled(self, name: str) -> Column:
        i = self.numeric.index(name)
        return (F.col(name).cast("double") - F.lit(self.means[i])) / F.lit(self.stds[i])

    def flag(self, level: str) -> Column:
        return F.coalesce((F.col(self.categorical) == level).cast("int"), F.lit(0))

    def array(self) -> Column:
        return F.array(
            *[self.scaled(c) for c in self.numeric], *[self.flag(level).cast("double") for level in self.levels]
        )

    def transform(self, df: DataFrame, output: str = "structured") -> DataFrame:
        return df.withColumn(output, self.array())


def label_ids(df: DataFrame, label: str = "category", output: str = "label_id") -> DataFrame:
    """Alphabetical class ids."""
    model = StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df).withColumn(output, F.col(output).cast("int"))


# --- n-grams ---------------------------------------------------------------


def char_wb_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, each word padded by a blank on both sides.

    With single blanks between words these are the windows of the text whose inner characters are no
    blanks; a look-ahead finds all of them, overlaps included. A padded word shorter than the smallest n is given once.
    """
    patterns = [rf"(?s)(?=(.[^ ]{{{n - 2}}}.))" for n in range(low, high + 1)]
    if low > 3:
        patterns.append(rf"(?=( [^ ]{{1,{low - 3}}} ))")
    padded = F.array(F.concat(F.lit(" "), squeeze(F.coalesce(text, F.lit(""))), F.lit(" ")))
    return F.transform(
        padded, lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns])
    )[0]


#: Bytes of grams that a task counts at once, and rows that it hands on at once.
GRAM_BYTES, GRAM_ROWS = 32 << 20, 1 << 16


def _counts_of(lists: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """(gram, d, o) of the gram lists of some rows: the rows and the places that hold each gram."""
    joined = lists.combine_chunks()
    coded = joined.flatten().dictionary_encode(null_encoding="encode")
    grams, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if not len(code):
        return
    key = np.sort(pc.list_parent_indices(joined).to_numpy() * len(grams) + code)
    o = np.bincount(code, minlength=len(grams))
    d = np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] % len(grams), minlength=len(grams))
    for at in range(0, len(grams), GRAM_ROWS):
        part = slice(at, at + GRAM_ROWS)
        yield pa.RecordBatch.from_arrays([grams[part], pa.array(d[part], pa.int64()), pa.array(o[part], pa.int64())], ["gram", "d", "o"])


def _counted_in_tasks(df: DataFrame, grams: Column) -> DataFrame:
    """(gram, d, o): documents and occurrences of the grams of some megabytes of rows, counted as numbers where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, size = [], 0
        for batch in batches:
            # A batch may hold many long lists.
            step = max(1, GRAM_BYTES * batch.num_rows // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                lists.append(batch.column(0).slice(at, step))
                size += lists[-1].nbytes
                if size >= GRAM_BYTES:
                    yield from _counts_of(pa.chunked_array(lists))
                    lists, size = [], 0
        if lists:
            yield from _counts_of(pa.chunked_array(lists))

    return df.select(grams.alias("grams")).mapInArrow(run, "gram string, d bigint, o bigint")


def _added_up(emitted: DataFrame) -> DataFrame:
    return emitted.groupBy("gram").agg(F.sum("d").alias("documents"), F.sum("o").alias("occurrences"))


def gram_counts(df: DataFrame, grams: Column) -> DataFrame:
    """(gram, documents, occurrences) over the whole table.

    Tasks count the grams of some megabytes of rows before one aggregation adds them up, so a gram is emitted once for all
    of its places there.
    """
    return _added_up(_counted_in_tasks(df, grams))


def _word_lists(text: str) -> Column:
    return F.filter(F.split(squeeze(F.coalesce(F.col(text), F.lit(""))), " "), lambda w: w != "")


def _word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(_word_lists(text)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("o"))


def _emitted_by_word(df: DataFrame, word_counts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(gram, d, o) of the occurrences and of the documents of character n-grams."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    occurrences = word_counts.select(F.explode(char_wb_grams(F.col("w"))).alias("gram"), zero.alias("d"), "o")
    once = char_wb_grams(F.array_join(F.array_distinct(_word_lists(text)), " "))
    return occurrences, df.select(F.explode(F.array_distinct(once)).alias("gram"), one.alias("d"), zero.alias("o"))


def char_gram_counts(df: DataFrame, text: str = V.TEXT_COLUMN) -> DataFrame:
    """``gram_counts`` of the character n-grams of a text column, by way of its words.

    Occurrences come from the counts of the words, which combine well before the shuffle; documents come
    from the distinct words of each text. Both passes read the text, so a computed text should be written first.
    """
    occurrences, documents = _emitted_by_word(df, _word_counts(df, text), text)
    return _added_up(occurrences.unionByName(documents))


#: Cells for each gram that is wanted: the mass of all rare grams in a cell stays far below a frequent gram's count.
CELLS_PER_GRAM = 32


def _most_frequent(occurrences: DataFrame, emitted: DataFrame, size: int, cells: int | None) -> DataFrame:
    """The ``size`` grams of most occurrences, of equal ones the smaller, with exact counts.

    First all occurrences are added up by the cell that a hash gives their gram: no gram occurs more often than its cell.
    Then only the grams of the fullest cells are counted. If the last of the ``size`` best counts is at least the total
    of every cell left out, no gram of those can be among them. Otherwise that count is a lower bound for the wanted ones, and
    the cells between it and the first limit are counted too. So the result never depends on the hash or the number of cells;
    what is shuffled is a number for each cell and task and the strings of full cells, not those of rare grams.
    """
    cells = cells or 1 << (size * CELLS_PER_GRAM - 1).bit_length()
    cell = F.pmod(F.xxhash64("gram"), F.lit(cells)).cast("int").alias("cell")
    totals = materialize(occurrences.select(cell, "o").groupBy("cell").agg(F.sum("o").alias("total")), "gram-cells")

    def least(table: DataFrame, column: str, places: int) -> int:
        """The number in that place in falling order, 0 where there are fewer."""
        row = table.select(column).orderBy(F.desc(column)).limit(places).agg(F.count(F.lit(1)), F.min(column)).first()
        return row[1] if row[0] == places else 0

    def counted(of_cell: Column) -> DataFrame:
        # At most one row for each cell.
        full = F.broadcast(totals.filter(of_cell).select("cell"))
        return _added_up(emitted.select("*", cell).join(full, "cell", "left_semi"))

    limit = least(totals, "total", size + size // 2)
    counts = materialize(counted(F.col("total") >= limit), "gram-counts")
    reached = least(counts, "occurrences", size)
    if reached < limit:
        counts = counts.unionByName(counted((F.col("total") >= reached) & (F.col("total") < limit)))
    return vocabulary(counts, size)


def top_grams(df: DataFrame, grams: Column, size: int, cells: int | None = None) -> DataFrame:
    """``vocabulary(gram_counts(df, grams), size)`` without a shuffle of the rare grams.

    The table is read once: what its tasks have counted is written, and both passes read that.
    """
    counted = materialize(_counted_in_tasks(df, grams), "gram-parts")
    return _most_frequent(counted.select("gram", "o"), counted, size, cells)


def top_char_grams(df: DataFrame, size: int, text: str = V.TEXT_COLUMN, cells: int | None = None) -> DataFrame:
    """``vocabulary(char_gram_counts(df), size)`` without a shuffle of the rare grams."""
    words = materialize(_word_counts(df, text), "word-counts")
    occurrences, documents = _emitted_by_word(df, words, text)
    return _most_frequent(occurrences.select("gram", "o"), occurrences.unionByName(documents), size, cells)


def word_grams(df: DataFrame, text: str = V.TEXT_COLUMN, output: str = "grams", stop_words=None) -> DataFrame:
    """Words of at least two characters without stop words, then single words and neighbouring pairs."""
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    kept = F.array(F.filter(words, lambda w: ~w.isin(list(stop_words))))

    def with_pairs(ws: Column) -> Column:
        following = F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0)))
        # The last word has no neighbour and gives null.
        pairs = F.zip_with(ws, following, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(ws, F.filter(pairs, lambda p: p.isNotNull()))

    return df.withColumn(output, F.transform(kept, with_pairs)[0])


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent grams."""
    return counts.orderBy(F.desc("occurrences"), "gram").limit(size)


def fit_tfidf(counts: DataFrame, rows: int, size: int, grams: str = "grams", output: str = "tfidf") -> PipelineModel:
    """TF-IDF with idf = ln((n + 1) / (df + 1)) + 1 and unit length rows, as one savable model.

    Vocabulary and weights come from one table of gram counts; only its ``size`` most frequent rows
    reach the driver.
    """
    top = vocabulary(counts, size).collect()
    names = [r["gram"] for r in top]
    weights = Vectors.dense([math.log((rows + 1) / (r["documents"] + 1)) + 1.0 for r in top])
    return PipelineModel(
        stages=[
            CountVectorizerModel.from_vocabulary(names, inputCol=grams, outputCol="_counts"),
            ElementwiseProduct(scalingVec=weights, inputCol="_counts", outputCol="_weighted"),
            Normalizer(p=2.0, inputCol="_weighted", outputCol=output),
            SQLTransformer(statement="SELECT * EXCEPT (_counts, _weighted) FROM __THIS__"),
        ]
    )


# --- dense vectors -----------------------------------------------------------


def masked_mean(tokens: DataFrame, width: int, key="email_id", vector="vector", mask="mask") -> DataFrame:
    """(key, token vector, 0/1 mask) -> (key, embedding): the mean over unmasked tokens.

    Components are summed before the shuffle; an e-mail without unmasked token gives zeros.
    """
    weight = F.col(mask).cast("double")
    sums = [F.sum(F.get(vector, F.lit(i)).cast("double") * weight) for i in range(width)]
    count = F.greatest(F.sum(weight), F.lit(1e-9))
    return tokens.groupBy(key).agg(F.array(*sums).alias("_sums"), count.alias("_count")).select(
        key, F.transform("_sums", lambda x: x / F.col("_count")).alias("embedding")
    )


def fit_text_encoder(
    df: DataFrame, text: str = V.TEXT_COLUMN, size: int = 64, output: str = "embedding_vector", min_count: int = 5,
    max_words: int = 100_000, iterations: int = 1, partitions: int = 8,
) -> PipelineModel:
    """Dense text encoder: the mean of the word vectors of all tokens of a text.

    Vectors are trained on all rows, in ``partitions`` parts at a time. The model holds the ``max_words`` most frequent
    words that occur ``min_count`` times at least: as its vectors live on the driver, a rarer word has none.
    """
    split = f"filter(split({text}, '[ ]+'), w -> w <> '')"
    words = df.select(F.explode(F.expr(split)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # One row for each frequency: the smallest that leaves at most max_words words.
    sizes = words.filter(F.col("n") >= min_count).groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    upward = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    fitting = sizes.withColumn("all", F.sum("words").over(upward)).filter(F.col("all") <= max_words)
    least = fitting.agg(F.min("n")).first()[0] or min_count
    vectors = Word2Vec(
        vectorSize=size, inputCol="_tokens", outputCol=output, seed=V.SEED, minCount=least, maxIter=iterations,
        numPartitions=partitions,
    )
    tokens = SQLTransformer(statement=f"SELECT *, {split} AS _tokens FROM __THIS__")
    drop = SQLTransformer(statement="SELECT * EXCEPT (_tokens) FROM __THIS__")
    return Pipeline(stages=[tokens, vectors, drop]).fit(df.select(text))


def encode_with(df: DataFrame, encode, text: str = V.TEXT_COLUMN, output: str = "embedding") -> DataFrame:
    """Hook for an external encoder: ``encode`` maps a list of texts to a list of float lists.

    It runs on Arrow batches inside the tasks.
    """
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode(texts.fillna("").tolist())))

    return df.withColumn(output, run(F.col(text)))


def fit_vector_scaler(df: DataFrame, vector: str, output: str) -> PipelineModel:
    """Zero mean, unit population standard deviation for a vector column.

    The library divides by the sample deviation; a constant factor turns one into the other.
    """
    n = df.count()
    size = len(df.select(vector).first()[0])
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    scaler = StandardScaler(inputCol=vector, outputCol="_scaled", withMean=True, withStd=True).fit(df)
    return PipelineModel(
        stages=[
            scaler,
            ElementwiseProduct(scalingVec=Vectors.dense([factor] * size), inputCol="_scaled", outputCol=output),
            SQLTransformer(statement="SELECT * EXCEPT (_scaled) FROM __THIS__"),
        ]
    )


def vocabulary_size(tfidf: PipelineModel) -> int:
    return len(tfidf.stages[0].vocabulary)


def assemble(df: DataFrame, sizes: dict[str, int], output: str) -> DataFrame:
    """Concatenate vector columns of known sizes; the sizes spare a look at the first row."""
    for column, size in sizes.items():
        df = VectorSizeHint(inputCol=column, size=size, handleInvalid="optimistic").transform(df)
    return VectorAssembler(inputCols=list(sizes), outputCol=output, handleInvalid="error").transform(df)


def to_array(vector: str) -> Column:
    return vector_to_array(vector)


def to_vector(array: str) -> Column:
    return array_to_vector(array)
