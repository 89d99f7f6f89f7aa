"""Language identification, words first, backing off to shorter and shorter character n-grams.

Fit: up to ``train_rows`` labelled texts of each language (a repeatable sample by the hash of the id, the only bound on
labelled rows), whole, are counted into (language, word) tables. Counts of character n-grams come from the word table.
The ``max_words`` most frequent words and ``max_grams`` most frequent n-grams of each length reach the driver and go to
every task, so the model has a fixed size. Languages are the labels that occur, ``max_languages`` at most (more raise).

Predict: a known word adds its log frequency for each language. An unseen word adds the mean over its known n-grams of
the longest length that has any, from ``LONGEST`` characters (word borders included) down to one. The score is the
posterior under equal priors.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing can
be learned; ties go to the alphabetically first language; texts of which nothing is known get it with score
1 / languages. Null ids are neither held out nor learned from; rows with the same id are judged one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.frequent import most_frequent
from mailsieve.llm.tokens import arrow_rows
from mailsieve.session import materialize

LONGEST = 4
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams with the word's borders; single characters without."""
    if n == 1:
        return list(word)
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class BackoffModel:
    """Log frequencies of words and n-grams: a row of a matrix for each, a column for each language."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.languages = languages
        self.words = {w: i for i, w in enumerate(words)}
        counts = np.array(list(words.values()), np.float64).reshape(len(words), len(languages))
        self.word_rows = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (len(words) + 1)))
        self.grams = {g: i for i, g in enumerate(grams)}
        counts = np.array(list(grams.values()), np.float64).reshape(len(grams), len(languages))
        sizes = np.array([len(g) for g in grams], np.int64)
        self.gram_rows = np.empty(counts.shape)
        for n in range(1, LONGEST + 1):
            own = counts[sizes == n]
            self.gram_rows[sizes == n] = np.log((own + 0.5) / (own.sum(0) + 0.5 * (len(own) + 1)))

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            known = [i for g in grams_of(word, n) if (i := self.grams.get(g)) is not None]
            if known:
                return self.gram_rows[known].sum(0) / len(known)
        return np.zeros(len(self.languages))

    def row(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        return self.unseen(word) if known is None else self.word_rows[known]


class Predictor:
    """Scores texts; the rows of words that a process has met are kept in a bounded matrix."""

    def __init__(self, model: BackoffModel, max_cells: int = 1 << 19):
        self.model, self.place = model, {}
        self.max_rows = max_cells // max(1, len(model.languages))
        self.rows = np.zeros((self.max_rows, len(model.languages)))

    def _places(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > self.max_rows:
            self.place, new = {}, words
        if len(new) > len(self.rows):  # one text with more distinct words than the table was made for
            self.rows = np.zeros((len(new), self.rows.shape[1]))
        for w in new:
            self.place[w] = at = len(self.place)
            self.rows[at] = self.model.row(w)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def predict(self, text: str) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not self.model.languages or not any(w.isalpha() or any(map(str.isalpha, w)) for w in counts):
            return UNKNOWN, 0.0
        places = self._places(list(counts))  # may set up other rows
        found = self.rows[places].T @ np.fromiter(counts.values(), np.float64, len(counts))
        odds = np.exp(found - found.max())
        best = int(found.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


_predictors: dict[str, Predictor] = {}


def _predictor(key: str, shared) -> Predictor:
    """The predictor of a model, one for each worker process."""
    if key not in _predictors:
        _predictors.clear()
        _predictors[key] = Predictor(shared.value)
    return _predictors[key]


def fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    train_rows: int = 4000, max_words: int = 30_000, max_grams: int = 20_000, max_languages: int = 400,
) -> BackoffModel:
    """Model from the labelled texts that are not held out."""
    labelled = docs.select(docs[id_column].alias("id"), docs[lang_column].cast("string").alias("lang"), docs[text_column].alias("text"))
    labelled = labelled.filter("id is not null and lang is not null and text is not null").filter(~held_out(F.col("id")))
    sizes = dict(labelled.groupBy("lang").count().limit(max_languages + 1).collect())
    if len(sizes) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    languages = sorted(sizes)
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, train_rows / n))).otherwise(share)
    chosen = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrow_rows(batches):
            total: dict[str, Counter] = {}
            for lang, text in zip(part.column(0).to_pylist(), texts):
                total.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in total.items() for w, n in c.items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["lang", "key", "n"]
                )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        total[lang, gram] += n
            rows = [(lang, g, n) for (lang, g), n in total.items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["lang", "key", "n"]
                )

    schema = "lang string, key string, n bigint"
    words = chosen.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    grams = words.mapInArrow(split, schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))

    def most(counts: DataFrame, limit: int) -> dict[str, np.ndarray]:
        by_key = counts.groupBy("key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        rows = most_frequent(materialize(by_key, "by-key"), limit).collect()  # as many as the model holds
        return {key: np.array([by.get(name, 0) for name in languages], np.float64) for key, _, by in sorted(rows)}

    grams = materialize(grams, "grams")
    tables: dict[str, np.ndarray] = {}
    for size in range(1, LONGEST + 1):
        tables.update(most(grams.filter(F.char_length("key") == size), max_grams))
    return BackoffModel(languages, most(words, max_words), tables)


def identify(docs: DataFrame, model: BackoffModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, language and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of words and n-grams

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = _predictor(key, shared)
        for part, texts in arrow_rows(batches):
            lang, score = zip(*map(predictor.predict, texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def label(docs: DataFrame, model: BackoffModel, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The same rows and columns with the predicted language in ``lang_column``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index(text_column), docs.columns.index(lang_column)

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = _predictor(key, shared)
        for part, texts in arrow_rows(batches, text_at):
            lang = pa.array([predictor.predict(t)[0] for t in texts], part.schema.field(lang_at).type)
            yield part.set_column(lang_at, part.schema.field(lang_at), lang)

    return docs.mapInArrow(run, docs.schema)


def predict_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **sizes) -> DataFrame:
    """Fit on the rows that are not held out and predict all rows."""
    model = fit(docs, id_column, text_column, lang_column, **sizes)
    found = identify(docs, model, id_column, text_column)
    return found.select(F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
