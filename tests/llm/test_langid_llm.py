"""Language identification: held-out accuracy, back-off against a plain version, defined results."""

import functools
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mailsieve.llm import langid
from mailsieve.llm.queries import op9_word_backoff

from .helpers import AWKWARD, DOCS, awkward, crowded, rows_of


def test_query_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op9_word_backoff(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held)
    most = max(sum(docs[r.doc_id].lang == x for r in held) for x in {d.lang for d in docs.values()}) / len(held)
    assert right > 0.97 > most
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    rows = langid.predict_languages(awkward(spark))
    by_id = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == len(AWKWARD)
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 7))
    assert by_id[None].held_out is False and by_id[3].lang_pred in ("en", "fr")
    assert rows_of(langid.predict_languages(crowded(awkward(spark)))) == rows_of(rows)
    assert langid.predict_languages(spark.createDataFrame([], DOCS)).collect() == []
    nothing = spark.createDataFrame([(1, "some text", None, None, 0)], DOCS)
    assert [tuple(r) for r in langid.predict_languages(nothing).collect()] == [(1, False, "und", 0.0)]


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", "xx" if i % 2 else "yy", "s", 0) for i in range(80)]
    held = {i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [(i, t, "zz" if i in held else lang, s, n) for i, t, lang, s, n in rows]
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(spark.createDataFrame(wrong, DOCS)).collect()}
    assert got == {r[0]: r[2] for r in rows}


def model():
    words = {"the": np.array([8.0, 1.0]), "der": np.array([0.0, 7.0])}
    grams = {g: np.array([3.0, 1.0]) for n in (1, 2, 3, 4) for g in langid.grams_of("the", n)}
    grams |= {"z": np.array([0.0, 5.0]), "tz": np.array([1.0, 9.0])}
    return langid.BackoffModel(["de", "en"], words, grams)


def test_backoff_goes_to_shorter_grams():
    m = model()
    words = np.array([8.0, 8.0])
    assert np.allclose(m.row("the"), np.log((np.array([8.0, 1.0]) + 0.5) / (words + 1.5)))
    assert np.allclose(m.row("qtz"), m.gram_rows[m.grams["tz"]])  # no 4- or 3-gram is known
    assert np.allclose(m.row("zq"), m.gram_rows[m.grams["z"]])
    assert np.allclose(m.row("qqq"), 0)
    them = [m.gram_rows[m.grams[g]] for g in langid.grams_of("them", 4) if g in m.grams]
    assert them and np.allclose(m.row("them"), sum(them) / len(them))


def test_score_is_the_posterior():
    m = model()
    p = langid.Predictor(m)
    lang, score = p.predict("the THE der qtz 12")
    sums = 2 * m.row("the") + m.row("der") + m.row("qtz")
    best = int(sums.argmax())
    assert lang == m.languages[best] and math.isclose(score, np.exp(sums)[best] / np.exp(sums).sum())
    assert p.predict("qqq") == ("de", 0.5) and p.predict("12 ²!") == ("und", 0.0)


def test_small_table_of_rows_gives_the_same():
    big, small = langid.Predictor(model()), langid.Predictor(model(), max_cells=6)
    for text in ("the der the", "a b c d e f g h the", "der tz z q", " ".join(f"w{chr(97 + i)}tz" for i in range(20))):
        assert big.predict(text) == small.predict(text)


def brute_model(docs, max_words, max_grams):
    """Languages and a function for the row of a word, by plain counting over all labelled rows that are not held out."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(r.lang, r.text) for r in docs if None not in (r.doc_id, r.lang, r.text) and not held(r.doc_id)]
    languages = sorted({lang for lang, _ in learned})
    at = {lang: k for k, lang in enumerate(languages)}
    words, grams = defaultdict(lambda: [0] * len(languages)), [defaultdict(lambda: [0] * len(languages)) for _ in range(5)]
    for lang, text in learned:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            words[w][at[lang]] += 1
            for n in range(1, 5):
                spelled = w if n == 1 else f"\x02{w}\x03"
                for i in range(len(spelled) - n + 1):
                    grams[n][spelled[i : i + n]][at[lang]] += 1

    def logs(table, limit):
        sizes = sorted((sum(c) for c in table.values()), reverse=True)
        least = min((n for n in sizes if sum(m >= n for m in sizes) <= limit), default=math.inf) if len(sizes) > limit else 0
        left = {k: c for k, c in table.items() if sum(c) >= least}
        totals = [sum(c[k] for c in left.values()) for k in range(len(languages))]
        return {key: [math.log((n + 0.5) / (totals[k] + 0.5 * (len(left) + 1))) for k, n in enumerate(c)] for key, c in left.items()}

    word_logs, gram_logs = logs(words, max_words), [logs(g, max_grams) for g in grams]

    def row(w):
        if w in word_logs:
            return word_logs[w]
        for n in range(4, 0, -1):
            spelled = w if n == 1 else f"\x02{w}\x03"
            known = [gram_logs[n][g] for i in range(len(spelled) - n + 1) if (g := spelled[i : i + n]) in gram_logs[n]]
            if known:
                return [sum(c) / len(known) for c in zip(*known)]
        return [0.0] * len(languages)

    return languages, functools.cache(row)


@pytest.mark.parametrize("sizes", [{}, {"max_words": 40, "max_grams": 60}])
def test_whole_query_by_plain_counting(spark, sf_dir, sizes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(awkward(spark), allowMissingColumns=True)
    rows = docs.select("doc_id", "lang", "text").collect()
    languages, row = brute_model(rows, sizes.get("max_words", 30_000), sizes.get("max_grams", 20_000))
    want = []
    for r in rows:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            want.append((str(r.doc_id), "und", 0.0))
            continue
        sums = [math.fsum(c) for c in zip(*map(row, words))]
        best = max(range(len(languages)), key=lambda k: sums[k])
        want.append((str(r.doc_id), languages[best], round(1 / sum(math.exp(s - sums[best]) for s in sums), 6)))
    got = [(str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in langid.predict_languages(docs, **sizes).collect()]
    assert sorted(got) == sorted(want)
