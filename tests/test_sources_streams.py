"""Readers, writers and streams on files in a temporary folder."""

import base64
import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsieve.functions import features as E
from mailsieve.sources import eml, tables
from mailsieve.streaming import jobs


def test_corpus_with_quotes_newlines_and_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿subject,body,label\n"say ""hi""","two\nlines, one",1\nx,,0\n', encoding="utf-8")
    rows = tables.read_corpus(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [('say "hi"', "two\nlines, one", "1"), ("x", None, "0")]


def test_export_keeps_text(spark, tmp_path):
    texts = [' lead, "q"', "a\nb ", "", "ගිණුම"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    tables.export_csv(df, str(tmp_path / "out"))
    again = tables.read_corpus(spark, str(tmp_path / "out"), ["id", "t"]).orderBy("id").collect()
    assert [r["t"] or "" for r in again] == texts


def test_feature_repair(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("category,has_url,email_entropy\nSpam,1,x\n,abc,2.5\n")
    rows = tables.read_features(spark, str(path)).orderBy("email_entropy").collect()
    assert [(r["category"], r["has_url"], r["email_entropy"], r["url_count_extracted"], r["detected_language"]) for r in rows] == [
        ("Spam", 1.0, 0.0, 0.0, "Unknown"), ("Unknown", 0.0, 2.5, 0.0, "Unknown"),
    ]


def test_metadata(spark, tmp_path):
    tables.write_run_metadata(spark, {"model_name": "m", "train_shape": [7, 3], "class_names": ["a"]}, str(tmp_path / "m"))
    meta = tables.read_run_metadata(spark, str(tmp_path / "m"))
    assert tables.expected_rows(meta, "train") == 7
    assert meta.first()["class_names"] == ["a"]


def test_feedback_store(spark, tmp_path):
    path = str(tmp_path / "store")
    for start in (0, 10):
        tables.append_feedback(spark.range(start, start + 3).toDF("event"), path, "event")
    assert [(r["id"], r["event"]) for r in tables.read_feedback(spark, path).collect()] == [
        (6, 12), (5, 11), (4, 10), (3, 2), (2, 1), (1, 0),
    ]
    assert tables.count_feedback(spark, path) == 6


MESSAGE = (
    "Received: a\r\nReceived: b\r\n"
    "From: =?utf-8?B?{name}?= <Ann@Corp.test>\r\nReply-To: x@evil.test\r\nTo: One <a@b.c>,\r\n D@E.F\r\n"
    "Subject: =?utf-8?Q?caf=C3=A9?=\r\n  news\r\nMessage-ID: <1@corp.test>\r\n"
    "Authentication-Results: mx; spf=fail; dkim=pass\r\nAuthentication-Results: mx2; dmarc=fail\r\n"
    'MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="c"\r\n\r\n'
    "--c\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\nOne \xe9\r\n\r\n  two\r\n"
    "--c\r\nContent-Type: text/plain\r\nContent-Disposition: attachment\r\n\r\nnot body\r\n"
    "--c\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>rich</p>\r\n"
    '--c\r\nContent-Type: application/x; name="s.docm"\r\nContent-Transfer-Encoding: base64\r\n\r\neHh4\r\n--c--\r\n'
)


@pytest.fixture(scope="module")
def mailbox(spark, tmp_path_factory):
    box = tmp_path_factory.mktemp("box")
    (box / "sub").mkdir()
    name = base64.b64encode("Änn".encode()).decode()
    (box / "sub" / "full.eml").write_bytes(MESSAGE.replace("{name}", name).encode("latin-1"))
    (box / "html.eml").write_bytes(b"Subject: s\nContent-Type: text/html\n\n<div>a</div>b &amp; c")
    (box / "odd.eml").write_bytes(b"Subject: s\nContent-Type: text/plain; charset=no-such\n\nabc")
    (box / "bare.EML").write_bytes(b"\x00\xff\xfe")
    (box / "note.txt").write_bytes(b"x")
    (box / "large.eml").write_bytes(b"Subject: x\n\n" + b"a" * (15 * 1024 * 1024))
    (box / "zero.eml").write_bytes(b"")
    (box / "zero one.eml").write_bytes(b"")
    rows = eml.parse_mail(eml.scan_eml(spark, str(box))).collect()
    return {r["path"].rsplit("/", 1)[1]: r for r in rows}


def test_rejected_files(mailbox):
    assert {n: r["error"] for n, r in mailbox.items() if r["error"]} == {
        "note.txt": "not an .eml file", "large.eml": "larger than 15 MB", "zero.eml": "empty file", "zero one.eml": "empty file",
    }
    assert mailbox["large.eml"]["headers"] is None


def test_size_limit_is_a_parameter(spark, tmp_path):
    messages = spark.createDataFrame([("a/x.eml", b"Subject: s\n\n" + b"b" * 3000), ("a/y.eml", b"Subject: t\n\nb")], "path string, content binary")
    assert eml.write_messages(messages, str(tmp_path)) == 2
    rows = eml.parse_mail(eml.scan_eml(spark, str(tmp_path), 1024), 1024).collect()
    assert {r["path"][-5:]: r["error"] for r in rows} == {"x.eml": "larger than 0.000976562 MB", "y.eml": None}


def test_files_are_listed_in_tasks(spark, tmp_path):
    for name in ("a.eml", "b c/d%20e.eml", "b c/deep/er/ü#?.EML", "_hidden/x.eml", "b c/.part.eml", "none.eml", "b c/note.txt"):
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(b"" if name == "none.eml" else name.encode())
    (tmp_path / "empty").mkdir()
    wanted = {"a.eml": b"a.eml", "b c/d%20e.eml": b"b c/d%20e.eml", "b c/deep/er/ü#?.EML": "b c/deep/er/ü#?.EML".encode(), "none.eml": None, "b c/note.txt": None}
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        rows = eml.scan_eml(spark, folder).collect()
        assert {r["path"][len(folder.rstrip("/")) + 1 :]: r["content"] for r in rows} == wanted and len(rows) == 5
        assert all(r["length"] == len(r["content"]) for r in rows if r["content"])
    assert eml.scan_eml(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(FileNotFoundError):
        eml.scan_eml(spark, str(tmp_path / "absent"))


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """The second writer finds its number taken between reading the end of the store and its commit."""
    path, taken = str(tmp_path / "store"), []
    real = tables._take_number

    def late(spark, place, number, commit):
        if not taken:
            taken.append(number)
            tables.append_feedback(spark.range(100, 104).toDF("event"), path, "event")
        return real(spark, place, number, commit)

    monkeypatch.setattr(tables, "_take_number", late)
    tables.append_feedback(spark.range(3).toDF("event"), path, "event")
    assert [(r["id"], r["event"]) for r in tables.read_feedback(spark, path).collect()] == [(7, 2), (6, 1), (5, 0), (4, 103), (3, 102), (2, 101), (1, 100)]
    assert tables.count_feedback(spark, path) == 7


def test_many_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "store")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: tables.append_feedback(spark.range(10 * i, 10 * i + 5).toDF("event"), path, "event"), range(6)))
    rows = tables.read_feedback(spark, path).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 31))
    assert sorted(r["event"] for r in rows) == [10 * i + j for i in range(6) for j in range(5)]
    by_batch = {r["event"] // 10: [] for r in rows}
    for r in rows:
        by_batch[r["event"] // 10].append((r["event"], r["id"]))
    assert all(i[1] - e[1] == 1 for b in by_batch.values() for e, i in zip(sorted(b), sorted(b)[1:]))


def test_crash_before_the_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    tables.append_feedback(spark.range(2).toDF("event"), path, "event")

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(tables, "_take_number", crash)
        with pytest.raises(KeyboardInterrupt):
            tables.append_feedback(spark.range(50, 60).toDF("event"), path, "event")
    assert tables.count_feedback(spark, path) == 2 and tables.read_feedback(spark, path).count() == 2
    tables.append_feedback(spark.createDataFrame([(None,), (7,), (None,)], "event long"), path, "event")
    assert [(r["id"], r["event"]) for r in tables.read_feedback(spark, path).collect()] == [(5, 7), (4, None), (3, None), (2, 1), (1, 0)]
    tables.append_feedback(spark.range(0).toDF("event"), path, "event")
    assert tables.count_feedback(spark, path) == 5


def test_empty_content(spark):
    files = spark.createDataFrame([("a/x.eml", 0, b"")], "path string, length long, content binary")
    assert eml.parse_mail(files).first()["error"] == "empty file"


def test_full_message(mailbox):
    r = mailbox["full.eml"]
    assert r["subject"] == "café  news" or r["subject"] == "café news"
    assert (r["body"], r["body_source"], r["has_html_body"]) == ("One é\ntwo", "text/plain", True)
    h = r["headers"]
    assert (h["from_address"], h["from_display_name"], h["received_count"]) == ("ann@corp.test", "Änn", 2)
    assert [a["address"] for a in h["to"]] == ["a@b.c", "d@e.f"]
    a = r["authentication"]
    assert (a["spf"], a["dkim"], a["dmarc"]) == ("fail", "pass", "fail")
    assert [(x["filename"], x["risk"], x["size_bytes"]) for x in r["attachments"]] == [
        ("unnamed_attachment", "Low", 8), ("s.docm", "High", 3),
    ]
    assert r["security_features"].asDict() == {
        "from_replyto_mismatch": 1, "from_returnpath_mismatch": 0, "message_id_domain_mismatch": 0, "attachment_count": 2,
        "has_executable_attachment": 0, "has_macro_attachment": 1,
    }
    assert (r["header_risk_score"], r["header_risk"]) == (7, "Critical")


def test_other_bodies(mailbox):
    assert (mailbox["html.eml"]["body"], mailbox["html.eml"]["body_source"]) == ("a\nb & c", "text/html converted to text")
    assert mailbox["odd.eml"]["body"] == "abc"
    assert mailbox["html.eml"]["warnings"] == ["No SPF, DKIM, or DMARC result was found in the visible headers."]


def test_attached_message(spark):
    raw = (
        b"Subject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=c\n\n--c\nContent-Type: text/plain\n\nouter\n"
        b"--c\nContent-Type: message/rfc822\nContent-Disposition: attachment; filename=f.eml\n\nSubject: in\n\ninner\n--c--\n"
    )
    files = spark.createDataFrame([("a.eml", len(raw), raw)], "path string, length long, content binary")
    r = eml.parse_mail(files).first()
    assert [x["filename"] for x in r["attachments"]] == ["f.eml"]
    assert r["body"] == "outer\n\ninner"


# --- streams ---------------------------------------------------------------------


def test_stream_features_equal_batch(spark, sf_dir, tmp_path):
    mail = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as email_id", "source as subject", "text as body")
    mail.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.feature_stream(jobs.file_stream(spark, str(tmp_path / "in"), mail.schema))
    got = jobs.run_to_table(stream, "test-features")
    want = jobs.feature_stream(mail)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_rates_drop_late_rows_and_repeats(spark, tmp_path):
    def at(minutes):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)

    schema = "id long, ts timestamp, feedback_status string"
    batches = [
        [(1, at(5), "Correct"), (2, at(10), "Wrong"), (1, at(5), "Correct")],
        [(3, at(130), "Wrong"), (2, at(10), "Wrong")],
        [(5, at(140), "Correct")],
        [(4, at(20), "Wrong")],
        [(6, at(400), "Correct")],
    ]
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    source = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .option("latestFirst", False).parquet(str(folder))
    )
    got = jobs.run_to_table(jobs.feedback_rates(source), "test-rates").orderBy("window_start", "feedback_status").collect()
    # Row 4 came after its window was closed; the window of row 6 is still open.
    assert [(r["window_start"].hour, r["feedback_status"], r["n"]) for r in got] == [
        (0, "Correct", 1), (0, "Wrong", 1), (2, "Correct", 1), (2, "Wrong", 1),
    ]
    source = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .option("latestFirst", False).parquet(str(folder))
    )
    updated = jobs.run_updates(jobs.feedback_rates(source), ["window_start", "window_end", "feedback_status"], "test-updates")
    assert {(r["window_start"].hour, r["feedback_status"], r["n"]) for r in updated.collect()} == {
        (0, "Correct", 1), (0, "Wrong", 1), (2, "Correct", 1), (2, "Wrong", 1), (6, "Correct", 1),
    }
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    batch = {(r["window_start"].hour, r["feedback_status"]): r["n"] for r in jobs.feedback_rates(everything).collect()}
    assert batch == {(0, "Correct"): 1, (0, "Wrong"): 2, (2, "Correct"): 1, (2, "Wrong"): 1, (6, "Correct"): 1}


def test_messages_and_names_are_handed_on_in_parts(tmp_path, monkeypatch):
    body = b"Subject: s\r\nContent-Type: text/plain\r\n\r\n" + b"x" * 1000
    batch = pd.DataFrame({"path": [f"{i}.eml" for i in range(25)], "length": len(body), "content": body, "error": None})
    monkeypatch.setattr(eml, "DECODE_BATCH", 4 * len(body))
    parts = list(eml._decode_batches(iter([batch])))
    assert [len(p) for p in parts] == [4] * 6 + [1] and [p for x in parts for p in x["path"]] == list(batch["path"])
    (tmp_path / "sub").mkdir()
    for name in ["_x", ".y", *(f"{i}.eml" for i in range(9))]:
        (tmp_path / name).write_bytes(b"ab")
    (tmp_path / "gone.eml").symlink_to(tmp_path / "missing")
    monkeypatch.setattr(eml, "LIST_BATCH", 3)
    listed = list(eml._list_folders(iter([pa.RecordBatch.from_arrays([pa.array([str(tmp_path)])], ["path"])])))
    assert max(b.num_rows for b in listed) == 3
    rows = {tuple(r.values()) for b in listed for r in b.to_pylist()}
    assert rows == {(f"{tmp_path}/sub", True, 0), (f"{tmp_path}/gone.eml", False, 0), *((f"{tmp_path}/{i}.eml", False, 2) for i in range(9))}
