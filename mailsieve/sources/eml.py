"""Raw ``.eml`` messages: decoding in Arrow batches, everything else as column expressions."""

from __future__ import annotations

import os
from collections.abc import Iterator
from email import policy
from email.header import decode_header, make_header
from email.parser import BytesParser
from functools import reduce
from itertools import islice
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.functions import headers as H
from mailsieve.functions import text as X
from mailsieve.operators import mail_checks as M
from mailsieve.session import materialize

RAW_SCHEMA = (
    "path string, length long, error string, subject string, from_header string, reply_to_header string, "
    "return_path_header string, message_id string, date string, to_headers array<string>, "
    "cc_headers array<string>, authentication_headers array<string>, received_spf_headers array<string>, "
    "received_count int, "
    "parts array<struct<no: int, content_type: string, filename: string, disposition: string, text: string, "
    "size_bytes: long>>"
)
_SINGLE = {
    "subject": "Subject", "from_header": "From", "reply_to_header": "Reply-To", "return_path_header": "Return-Path",
    "message_id": "Message-ID", "date": "Date",
}
_MANY = {
    "to_headers": "To", "cc_headers": "Cc", "authentication_headers": "Authentication-Results",
    "received_spf_headers": "Received-SPF",
}


#: Bytes of files that one task reads, and that it hands on at once; names that a listing hands on at once.
READ_TASK, READ_BATCH, LIST_BATCH = 64 << 20, 16 << 20, 1 << 14
#: Bytes of messages that are decoded before their rows are handed on, and the most rows.
DECODE_BATCH, DECODE_ROWS = 4 << 20, 1000
_FOUND = "path string, folder boolean, length long"


def _file_uri(path: str) -> str:
    """A local path as the file system library takes it; other places keep their scheme."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return path if "://" in path else f"file://{quote(path)}"


def _entries(path: str) -> Iterator[tuple[str, bool, int]]:
    """(name, folder, length) of what lies in a folder; on a local disk one at a time, however many there are."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(_file_uri(path))
    if not isinstance(system, fs.LocalFileSystem):
        for x in system.get_file_info(fs.FileSelector(place)):
            yield x.base_name, x.type == fs.FileType.Directory, x.size or 0
        return
    with os.scandir(place) as found:
        for x in found:
            folder, missing = x.is_dir(), x.is_symlink() and not os.path.exists(x.path)
            yield x.name, folder, 0 if folder or missing else x.stat().st_size


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder; names that begin with a dot or an underscore are left out."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            kept = ((f"{path.rstrip('/')}/{name}", folder, length) for name, folder, length in _entries(path) if name[:1] not in ("_", "."))
            while part := list(islice(kept, LIST_BATCH)):
                columns = [pa.array(x, kind) for x, kind in zip(zip(*part), (pa.string(), pa.bool_(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "folder", "length"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file below a folder.

    A job lists all folders of one depth, a row for each, and its result is written: no name passes through the driver. Links
    between folders that form a circle are not looked for.
    """
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(_file_uri(path))
    if system.get_file_info(place).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no folder {path}")
    folders, levels = spark.createDataFrame([(path,)], "path string"), []
    while True:
        level = materialize(folders.mapInArrow(_list_folders, _FOUND), "listing")
        levels.append(level.filter("not folder").select("path", "length"))
        below = level.filter("folder").select("path")
        n = below.count()
        if n == 0:
            return reduce(DataFrame.unionByName, levels)
        folders = below.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path")


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with their content, a bounded number of bytes at a time."""
    from pyarrow import fs

    def handed_on(batch: pa.RecordBatch, first: int, contents: list) -> pa.RecordBatch:
        names = batch.slice(first, len(contents))
        return pa.RecordBatch.from_arrays([*names.columns, pa.array(contents, pa.binary())], ["path", "length", "content"])

    for batch in batches:
        first, contents, size = 0, [], 0
        for path in batch.column(0).to_pylist():
            system, place = fs.FileSystem.from_uri(_file_uri(path))
            with system.open_input_stream(place) as file:
                contents.append(file.read())
            size += len(contents[-1])
            if size >= READ_BATCH:
                yield handed_on(batch, first, contents)
                first, contents, size = first + len(contents), [], 0
        yield handed_on(batch, first, contents)


def scan_eml(spark: SparkSession, path: str, max_bytes: int = V.MAX_EML_BYTES) -> DataFrame:
    """(path, length, content) of every file below a folder; only messages of up to ``max_bytes`` come with content.

    The files are listed once, in tasks, and read in tasks by their names. Paths begin as the given one does. Files whose
    name begins with a dot or an underscore are not looked at; a folder that is missing is an error, an empty one gives no rows.
    """
    listed = list_files(spark, path)
    fits = F.endswith(F.lower("path"), F.lit(".eml")) & (F.col("length") > 0) & (F.col("length") <= max_bytes)
    size = listed.filter(fits).agg(F.sum("length")).first()[0] or 0
    # The list is small beside the files, so the number of tasks follows from their bytes.
    tasks = max(size // READ_TASK + 1, spark.sparkContext.defaultParallelism)
    files = listed.filter(fits).repartition(tasks, "path")
    read = files.mapInArrow(_read_files, "path string, length long, content binary")
    return read.unionByName(listed.filter(~fits).withColumn("content", F.lit(None).cast("binary")))


def write_messages(messages: DataFrame, folder: str) -> int:
    """Write (path, content) as files below a folder that all tasks reach; a task that runs again writes the same files.

    Returns the number of files.
    """
    base = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for path, content in batch.itertuples(index=False):
                place = f"{root}/{path}"
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return messages.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _header(value) -> str:
    """Unfolded header with its encoded words decoded."""
    if value is None:
        return ""
    text = "".join(str(value).splitlines())
    try:
        return str(make_header(decode_header(text))).strip()
    except Exception:
        return text.strip()


def _part(no: int, part) -> dict:
    kind = part.get_content_type().lower()
    payload = part.get_payload(decode=True) or b""
    text = None
    if kind in ("text/plain", "text/html") and not part.is_multipart():
        try:
            text = payload.decode(part.get_content_charset() or "ascii", errors="replace")
        except LookupError:
            text = payload.decode("utf-8", errors="replace")
    return {
        "no": no, "content_type": kind, "filename": _header(part.get_filename()),
        "disposition": (part.get_content_disposition() or "").lower(), "text": text, "size_bytes": len(payload),
    }


def _decode(content: bytes) -> dict:
    # The plain message class leaves header values alone; only the few that are needed get decoded.
    message = BytesParser(policy=policy.compat32).parsebytes(content)
    row = {column: _header(message.get(name)) for column, name in _SINGLE.items()}
    row.update({column: [_header(v) for v in message.get_all(name, [])] for column, name in _MANY.items()})
    row["received_count"] = len(message.get_all("Received", []))
    # Containers come too: an attached message is one, and counts as an attachment.
    row["parts"] = [_part(i, p) for i, p in enumerate(message.walk())]
    return row


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.strip().split(" ")[0] for f in RAW_SCHEMA.split("parts array")[0].rstrip(", ").split(",")] + ["parts"]
    made = lambda rows: pd.DataFrame(rows, columns=names).astype({"received_count": "Int32"})
    for batch in batches:
        rows, size = [], 0
        for path, length, content, error in batch.itertuples(index=False):
            row = dict.fromkeys(names) | {"path": path, "length": length, "error": error}
            if error is None:
                try:
                    row.update(_decode(content))
                except Exception as problem:
                    row["error"] = f"unreadable message: {type(problem).__name__}"
            rows.append(row)
            size += len(content or b"")
            if size >= DECODE_BATCH or len(rows) == DECODE_ROWS:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


def rejection(max_bytes: int = V.MAX_EML_BYTES) -> Column:
    return (
        F.when(~F.endswith(F.lower("path"), F.lit(".eml")), F.lit("not an .eml file"))
        .when(F.col("length") == 0, F.lit("empty file"))
        .when(F.col("length") > max_bytes, F.lit(f"larger than {max_bytes / 2**20:g} MB"))
    )


def decode_messages(files: DataFrame, max_bytes: int = V.MAX_EML_BYTES) -> DataFrame:
    """(path, length, content) -> headers and parts; rejected files keep a row with ``error``.

    The bytes of rejected files stay behind.
    """
    error = rejection(max_bytes)
    checked = files.select("path", "length", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))
    return checked.mapInPandas(_decode_batches, RAW_SCHEMA)


# --- from decoded parts to the parsed mail -----------------------------------------


def _attached(part: Column) -> Column:
    return (part["filename"] != "") | (part["disposition"] == "attachment")


def body_columns(parts: Column) -> dict[str, Column]:
    """Body, its source and whether HTML was present: all plain parts, else the HTML parts as text."""

    def texts(kind: str, clean) -> Column:
        chosen = F.filter(parts, lambda p: ~_attached(p) & (p["content_type"] == kind) & p["text"].isNotNull())
        return F.filter(F.transform(chosen, lambda p: clean(p["text"])), lambda t: t != "")

    plain, html = texts("text/plain", X.normalize_lines), texts("text/html", X.html_to_text)
    return {"_plain": plain, "_html": html}


def parse_mail(files: DataFrame, max_bytes: int = V.MAX_EML_BYTES) -> DataFrame:
    """(path, length, content) -> one nested row per message, with flags, attachments and risk."""
    decoded = decode_messages(files, max_bytes).withColumns(body_columns(F.col("parts")))
    c = F.col
    with_body = decoded.withColumns(
        {
            "body": F.when(F.size("_plain") > 0, F.array_join("_plain", "\n\n")).otherwise(
                F.coalesce(F.array_join("_html", "\n\n"), F.lit(""))
            ),
            "body_source": F.when(F.size("_plain") > 0, F.lit("text/plain"))
            .when(F.size("_html") > 0, F.lit("text/html converted to text"))
            .otherwise(F.lit("unavailable")),
            "has_html_body": F.coalesce(F.size("_html") > 0, F.lit(False)),
            "authentication_results": F.array_join("authentication_headers", "\n"),
            "received_spf": F.array_join("received_spf_headers", "\n"),
            "to": F.flatten(F.transform("to_headers", H.address_list)),
            "cc": F.flatten(F.transform("cc_headers", H.address_list)),
            "attachments": F.transform(
                F.filter("parts", _attached),
                lambda p: F.struct(
                    F.when(p["filename"] == "", F.lit("unnamed_attachment")).otherwise(p["filename"]).alias("filename"),
                    p["content_type"].alias("content_type"),
                    p["size_bytes"].alias("size_bytes"),
                    H.file_extension(p["filename"]).alias("extension"),
                    H.attachment_risk(p["filename"]).alias("risk"),
                    H.attachment_warnings(p["filename"]).alias("warnings"),
                ),
            ),
        }
    ).drop("_plain", "_html")
    checked = M.authentication(M.domain_mismatches(M.parse_addresses(with_body)))
    found = c("attachments")
    summed = checked.withColumns(
        {
            "attachment_count": F.coalesce(F.size(found), F.lit(0)),
            "attachment_points": F.aggregate(found, F.lit(0), lambda a, x: a + H.attachment_points(x["risk"])),
            "has_executable_attachment": F.exists(found, lambda x: x["extension"].isin(V.EXECUTABLE_EXTENSIONS)).cast("int"),
            "has_macro_attachment": F.exists(found, lambda x: x["extension"].isin(V.MACRO_EXTENSIONS)).cast("int"),
        }
    )
    rated = M.add_header_risk(summed)
    good = c("error").isNull()

    def group(*names: str) -> Column:
        return F.when(good, F.struct(*names))

    return rated.select(
        "path", "length", "error", "subject", "body", "body_source", "has_html_body",
        group(
            "from_header", "from_address", "from_display_name", "reply_to_header", "reply_to_address",
            "return_path_header", "return_path_address", "to", "cc", "date", "message_id", "received_count",
        ).alias("headers"),
        group("from_domain", "reply_to_domain", "return_path_domain", "message_id_domain").alias("domains"),
        group("spf", "dkim", "dmarc", "authentication_headers", "received_spf").alias("authentication"),
        group(
            "from_replyto_mismatch", "from_returnpath_mismatch", "message_id_domain_mismatch", "attachment_count",
            "has_executable_attachment", "has_macro_attachment",
        ).alias("security_features"),
        "attachments", "header_risk_score", F.when(good, c("header_risk")).alias("header_risk"), "warnings",
    )
