"""Address, domain, authentication and attachment expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve import fixed_values as V
from mailsieve.functions import text as X

_ANGLE = r"<([^<>]*)(?:>|$)"
# A group or scheme name in front of an address, as in ``Team: a@b;`` or ``mailto:a@b``.
_PREFIX = r'^[^"@<]*:'


def address_of(header: Column) -> Column:
    """Lower-case address of ``Name <address>``, ``address (Name)`` or a bare address."""
    h = F.coalesce(header, F.lit(""))
    bare = X.strip_ws(F.regexp_replace(h, r"\([^()]*\)", " "))
    bare = F.regexp_replace(F.regexp_replace(bare, _PREFIX, ""), rf"[{V.WS}]*@[{V.WS}]*", "@")
    bare = F.btrim(bare, F.lit(V.WS_CHARS + ";"))
    bare = F.when(F.rlike(bare, F.lit(rf"[{V.WS}]")), F.lit("")).otherwise(bare)
    return F.lower(
        F.when(F.rlike(h, F.lit(_ANGLE)), X.strip_ws(F.regexp_extract(h, _ANGLE, 1))).otherwise(bare)
    )


def display_name_of(header: Column) -> Column:
    h = F.coalesce(header, F.lit(""))
    before = F.regexp_replace(F.regexp_extract(h, r"^([^<]*)<", 1), _PREFIX, "")
    before = F.regexp_replace(F.btrim(before, F.lit(V.WS_CHARS + '"')), r"\\(.)", "$1")
    comment = X.strip_ws(F.regexp_extract(h, r"\(([^()]*)\)", 1))
    return F.when(F.rlike(h, F.lit(_ANGLE)), before).otherwise(comment)


def address_list(header: Column) -> Column:
    """Array of struct(display_name, address); entries without an address are skipped."""
    # Text between commas, where quoted parts may hold commas; one pass over the longest of lists.
    pieces = F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r'(?:[^,"]++|"[^"]*+")++'), F.lit(0))
    parsed = F.transform(
        pieces, lambda p: F.struct(display_name_of(p).alias("display_name"), address_of(p).alias("address"))
    )
    return F.filter(parsed, lambda a: a["address"] != "")


def domain_of_address(address: Column) -> Column:
    """Part after the last ``@``; empty without one."""
    domain = F.btrim(F.lower(X.strip_ws(F.substring_index(address, "@", -1))), F.lit("<>[]()"))
    return F.when(F.contains(address, F.lit("@")), domain).otherwise(F.lit(""))


def domain_of_message_id(message_id: Column) -> Column:
    found = F.regexp_extract(F.coalesce(message_id, F.lit("")), rf"@([^>{V.WS}]+)", 1)
    return F.btrim(F.lower(found), F.lit("<>[]()"))


def differs(left: Column, right: Column) -> Column:
    """1 only if both are present and unequal."""
    return ((left != "") & (right != "") & (left != right)).cast("int")


def auth_result(header: Column, mechanism: str) -> Column:
    words = "|".join(V.AUTH_RESULTS)
    found = F.regexp_extract(
        F.coalesce(header, F.lit("")), rf"(?i)\b{mechanism}[{V.WS}]*=[{V.WS}]*({words})", 1
    )
    return F.coalesce(F.nullif(F.lower(found), F.lit("")), F.lit("unknown"))


def spf_result(header: Column, received_spf: Column) -> Column:
    """The SPF word of the authentication results, else the first result word of Received-SPF."""
    words = "|".join(V.RECEIVED_SPF_RESULTS)
    fallback = F.regexp_extract(F.coalesce(received_spf, F.lit("")), rf"(?i)\b({words})\b", 1)
    first = auth_result(header, "spf")
    return F.when(first != "unknown", first).otherwise(
        F.coalesce(F.nullif(F.lower(fallback), F.lit("")), F.lit("unknown"))
    )


def file_extension(name: Column) -> Column:
    """Lower-case suffix with its dot; none for names that start or end with their only dot."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"^(?:.*/)?[^/]+(\.[^./]+)$", 1))


def is_double_extension(name: Column) -> Column:
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^./]+$", "")
    return (file_extension(name) != "") & file_extension(stem).isin(V.DOUBLE_EXTENSION_INNER)


def attachment_type_risk(extension: Column) -> Column:
    return (
        F.when(extension.isin(V.EXECUTABLE_EXTENSIONS), F.lit("Critical"))
        .when(extension.isin(V.MACRO_EXTENSIONS), F.lit("High"))
        .when(extension.isin(V.ARCHIVE_EXTENSIONS), F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def attachment_risk(name: Column) -> Column:
    return F.when(is_double_extension(name), F.lit("Critical")).otherwise(
        attachment_type_risk(file_extension(name))
    )


def attachment_warnings(name: Column) -> Column:
    kind = attachment_type_risk(file_extension(name))
    sentences = F.array(
        F.when(kind == "Critical", F.lit("Executable or script attachment type detected."))
        .when(kind == "High", F.lit("Macro-enabled Microsoft Office attachment detected."))
        .when(kind == "Medium", F.lit("Archive attachment detected; contents were not opened.")),
        F.when(is_double_extension(name), F.lit("Possible double-extension filename detected.")),
    )
    return F.array_compact(sentences)


def attachment_points(risk: Column) -> Column:
    return (
        F.when(risk == "Critical", F.lit(3))
        .when(risk == "High", F.lit(2))
        .when(risk == "Medium", F.lit(1))
        .otherwise(F.lit(0))
    )


def header_risk_level(score: Column) -> Column:
    return (
        F.when(score >= 6, F.lit("Critical"))
        .when(score >= 4, F.lit("High"))
        .when(score >= 2, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def spf_bad(result: Column) -> Column:
    return result.isin("fail", "softfail", "permerror")


def signature_bad(result: Column) -> Column:
    """For DKIM and DMARC."""
    return result.isin("fail", "permerror")
