"""Pipeline: every stage does what its operator decides, on all that its predecessor kept."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from mailsieve.llm import langid, neardup, pii, quality

from .helpers import DOCS, awkward, crowded
from .test_packing_llm import check


def test_registered():
    assert entry.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
    numbers = [name.split("_")[0] for name in entry.queries() if name.startswith("op")]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    given = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, given, sf_dir).cache()
        assert out.columns == columns
        before, after = ({r.doc_id: r for r in df.collect()} for df in (given, out))
        if name == "quality_rules":
            assert set(after) == {r.doc_id for r in quality.judge(given).collect() if r.kept}
            assert all(before[i] == r for i, r in after.items())
        elif name == "language_id":
            found = {r.doc_id: r.lang_pred for r in langid.predict_languages(given).collect()}
            assert {i: r.lang for i, r in after.items()} == {i: x for i, x in found.items() if x != "und"}
        elif name == "near_duplicates":
            assert set(after) == {r.doc_id for r in neardup.near_duplicates(given).collect() if r.kept}
            assert all(before[i] == r for i, r in after.items())
        else:
            field = pii.ShapeField()
            finder = pii.Finder(field)
            for i, r in after.items():
                base, added = finder.spans([before[i].text])[0]
                assert r.text == pii.masked(before[i].text, base + added) and r.n_chars == len(r.text)
        given = out
    pieces = corpus_pipeline.STAGES[4][1](spark, given, sf_dir).collect()
    check(pieces, [(r.doc_id, r.text) for r in given.collect()])


def test_run(spark, sf_dir):
    docs = corpus_pipeline.run(spark, sf_dir)
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert docs.count() > 0


@pytest.mark.parametrize("rows", ["awkward", "crowded", "empty"])
def test_awkward_rows(spark, sf_dir, rows):
    docs = {"awkward": awkward, "crowded": lambda s: crowded(awkward(s)), "empty": lambda s: s.createDataFrame([], DOCS)}[rows](spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert (out.columns == docs.columns) == (stage is not corpus_pipeline.pack)
        out.collect()
