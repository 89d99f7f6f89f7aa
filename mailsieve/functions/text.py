"""Cleaning and normalising text columns."""

from __future__ import annotations

from dataclasses import dataclass
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve import fixed_values as V


@dataclass(frozen=True)
class TextRules:
    """Word list and URL pattern that belong together: those of training or of serving."""

    keywords: tuple[str, ...]
    url_pattern: str


TRAINING = TextRules(tuple(V.TRAINING_KEYWORDS), V.TRAINING_URL)
SERVING = TextRules(tuple(V.SERVING_KEYWORDS), V.SERVING_URL)

# A run of white space that is not a lone blank: single blanks need no rewrite. The engine's own class is
# faster than the spelled out one; it lacks four separators only.
_RUN_TO_SQUEEZE = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


def round_even(c: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the rounding of numeric array libraries."""
    factor = float(10**digits)
    return F.rint(c * F.lit(factor)) / F.lit(factor)


def squeeze(c: Column) -> Column:
    """White space runs become one blank, edges are stripped."""
    return F.trim(F.regexp_replace(c, _RUN_TO_SQUEEZE, " "))


def clean_basic(c: Column) -> Column:
    return squeeze(F.coalesce(c.cast("string"), F.lit("")))


def _before_last_close(c: Column, change) -> Column:
    """Apply ``change`` up to the last ``>``.

    No tag can start behind it, and a pattern that looks for the end of a tag from every ``<`` there would
    take time quadratic in the length of a hostile text.
    """
    cut = F.transform(F.array(c), lambda t: F.struct(t.alias("t"), F.substring_index(t, ">", -1).alias("tail")))
    return F.transform(
        cut,
        lambda s: F.concat(
            change(F.substring(s["t"], F.lit(1), F.length(s["t"]) - F.length(s["tail"]))), s["tail"]
        ),
    )[0]


def drop_tags(c: Column) -> Column:
    # The cheap substring test spares the regular expression on the many texts without tags.
    replaced = _before_last_close(c, lambda t: F.regexp_replace(t, V.HTML_TAG, " "))
    return F.when(F.contains(c, F.lit("<")), replaced).otherwise(c)


def clean_html(c: Column) -> Column:
    return squeeze(drop_tags(F.coalesce(c.cast("string"), F.lit(""))))


def join_text(subject: Column, body: Column) -> Column:
    return F.trim(F.concat(subject, F.lit(" "), body))


def may_hold_url(c: Column, lowered: Column | None = None) -> Column:
    """Every URL pattern needs one of these substrings."""
    low = F.lower(c) if lowered is None else lowered
    return F.contains(c, F.lit("://")) | F.contains(low, F.lit("www."))


# The address pattern of the fixed values in a form that tries each run of address characters once: the match
# starts at the first word boundary of the run, which goes on to its end. Letter case as in Unicode.
_ADDRESS_CHARS = "[a-z0-9._%+-]"
_ADDRESS = (
    rf"(?iu)(?<!{_ADDRESS_CHARS})((?>{_ADDRESS_CHARS}*?\b)){_ADDRESS_CHARS}++@[a-z0-9.-]+\.[a-z]{{2,}}\b"
)


def mask_addresses(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, _ADDRESS, "$1 <EMAIL> ")).otherwise(c)


def mask_urls(c: Column, rules: TextRules = TRAINING, lowered: Column | None = None) -> Column:
    return F.when(may_hold_url(c, lowered), F.regexp_replace(c, rules.url_pattern, " <URL> ")).otherwise(c)


def normalize_for_model(c: Column, rules: TextRules = TRAINING) -> Column:
    """Clean, lower, mask addresses, then mask URLs. The order matters: addresses go first."""
    lowered = F.lower(clean_html(c))
    # One element arrays give each step a name, so that no step is computed twice.
    steps = F.transform(F.array(lowered), mask_addresses)
    steps = F.transform(steps, lambda t: mask_urls(t, rules, t))
    return squeeze(steps[0])


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(V.WS_CHARS))


def is_blank(c: Column) -> Column:
    return strip_ws(F.coalesce(c, F.lit(""))) == ""


def text_lines(c: Column) -> Column:
    """Non-empty lines with blanks and tabs squeezed and edges stripped."""
    pieces = F.split(F.coalesce(c, F.lit("")), f"[{V.LINE_SEP}]")
    squeezed = F.transform(pieces, lambda x: strip_ws(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.filter(squeezed, lambda x: x != "")


def normalize_lines(c: Column) -> Column:
    return F.array_join(text_lines(c), "\n")


def split_subject(text: Column) -> Column:
    """Struct(subject, body, warning) from the lines of a screenshot.

    A line ``Subject: ...`` (or ``Sub - ...``) wins; else the first line of at least three
    characters that is no metadata line, with a warning; else the whole text is the body.
    """
    label = rf"(?i)^(?:subject|sub)[{V.WS}]*[:\-][{V.WS}]*(.+)$"
    lines = F.transform(F.array(text_lines(text)), lambda x: x)

    def with_marks(ls: Column) -> Column:
        labelled = F.filter(
            F.transform(ls, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, label, 1).alias("s"))),
            lambda s: s["s"] != "",
        )
        plain = F.filter(
            F.transform(
                ls,
                lambda x, i: F.struct(
                    i.alias("i"),
                    x.alias("s"),
                    F.lower(x).alias("low"),
                ),
            ),
            lambda s: (F.length(s["s"]) >= 3) & ~_any_prefix(s["low"], V.METADATA_PREFIXES),
        )
        return F.struct(
            ls.alias("lines"),
            F.get(labelled, F.lit(0)).alias("labelled"),
            F.get(plain, F.lit(0)).alias("plain"),
        )

    def pick(m: Column) -> Column:
        def rest(i: Column) -> Column:
            return F.array_join(F.slice(m["lines"], i + 2, F.size(m["lines"]) + 1), "\n")

        labelled, plain = m["labelled"], m["plain"]
        return F.struct(
            F.when(labelled.isNotNull(), strip_ws(labelled["s"]))
            .when(plain.isNotNull(), plain["s"])
            .otherwise(F.lit(""))
            .alias("subject"),
            F.when(labelled.isNotNull(), rest(labelled["i"]))
            .when(plain.isNotNull(), rest(plain["i"]))
            .otherwise(F.array_join(m["lines"], "\n"))
            .alias("body"),
            F.when(F.size(m["lines"]) == 0, F.lit("no readable text"))
            .when(labelled.isNotNull(), F.lit(""))
            .when(plain.isNotNull(), F.lit("subject estimated from the first meaningful line"))
            .otherwise(F.lit("subject not identified"))
            .alias("warning"),
        )

    return F.transform(F.transform(lines, with_marks), pick)[0]


def _any_prefix(c: Column, prefixes: list[str]) -> Column:
    test = F.lit(False)
    for p in prefixes:
        test = test | F.startswith(c, F.lit(p))
    return test


def truncate_text(c: Column, limit: int = V.TEXT_CUT) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, limit)


def display_name(c: Column) -> Column:
    return F.translate(c, "_", " ")


# --- HTML bodies ---------------------------------------------------------

_TAG_TAIL = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
_BLOCK = r"(?i)</?(?:" + "|".join(V.BLOCK_TAGS) + r")(?=[\s/>])" + _TAG_TAIL
_OTHER_TAG = r"</?[a-zA-Z]" + _TAG_TAIL

# Named character references from the standard library's tables: those of HTML 4 with the old names that are also
# read without their semicolon, and, looked up only where these fail, all others.
_OLD_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
NAMED_ENTITIES = {name: html5[f"{name};"] for name in sorted({*name2codepoint, *_OLD_NAMES, "apos"})}
OTHER_ENTITIES = {n[:-1]: v for n, v in sorted(html5.items()) if n.endswith(";") and n[:-1] not in NAMED_ENTITIES}
# References to control positions mean the characters of the Windows code page.
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_CONTROLS_MEANT = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))
_NUMERIC = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
_NAMED = r"^([A-Za-z][A-Za-z0-9]{1,31});"
_OLD = "^(" + "|".join(_OLD_NAMES) + ")"


def _number_char(code: Column) -> Column:
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127), F.lit(""))
        .when(code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE), F.lit(""))
        .otherwise(F.translate(char, _CONTROLS, _CONTROLS_MEANT))
    )


def _decode_once(c: Column) -> Column:
    """Each piece behind an ``&`` may open with a reference: ``amp;``, ``#39;`` or ``#x27;``."""
    def table(entities: dict[str, str]) -> Column:
        """Two literals that the optimizer folds into one map."""
        return F.map_from_arrays(
            F.split(F.lit("\x1f".join(entities)), "\x1f"), F.split(F.lit("\x1f".join(entities.values())), "\x1f")
        )

    names, others = table(NAMED_ENTITIES), table(OTHER_ENTITIES)

    def found(piece: Column) -> Column:
        return F.struct(
            piece.alias("piece"),
            F.regexp_extract(piece, _NUMERIC, 0).alias("number"),
            F.regexp_extract(piece, _NAMED, 1).alias("name"),
            F.regexp_extract(piece, _OLD, 1).alias("old"),
        )

    def decoded(s: Column, i: Column) -> Column:
        piece, number, name = s["piece"], s["number"], s["name"]
        hexadecimal = F.lower(F.substring(number, 2, 1)) == "x"
        # Without leading zeros seven digits say all: anything longer lies beyond the last character.
        digits = F.regexp_replace(number, "^#[xX]?0*|;", "")
        short = F.when(F.length(digits) > 7, F.lit("1234567")).when(digits == "", F.lit("0")).otherwise(digits)
        code = F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(short).cast("int")
        named = F.coalesce(F.try_element_at(names, name), F.try_element_at(others, name))

        def rest(size: Column) -> Column:
            return F.substring(piece, size + 1, F.length(piece))

        return (
            F.when(i == 0, piece)
            .when(number != "", F.concat(_number_char(code), rest(F.length(number))))
            .when(named.isNotNull(), F.concat(named, rest(F.length(name) + 1)))
            .when(s["old"] != "", F.concat(F.try_element_at(names, s["old"]), rest(F.length(s["old"]))))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.transform(F.split(c, "&"), found)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(c)


def decode_entities(c: Column) -> Column:
    """References are decoded twice, as a parser that decodes and a later decoding step do."""
    return F.transform(F.transform(F.array(c), _decode_once), _decode_once)[0]


_END = "\x00\uffff"


def _drop_element(c: Column, tag: str) -> Column:
    """Without the elements of a tag and their contents; one that is never closed takes the rest with it.

    Only the text up to the last ``>`` is searched, where every opening finds its end. A mark behind it tells whether
    an unclosed element ran to the end.
    """
    pattern = rf"(?is)<{tag}(?=[\s/>])[^>]*>.*?(?:</{tag}(?=[\s/>])[^>]*>|\z)"
    cut = F.transform(F.array(c), lambda t: F.struct(t.alias("t"), F.substring_index(t, ">", -1).alias("tail")))
    changed = F.transform(
        cut,
        lambda s: F.struct(
            F.regexp_replace(
                F.concat(F.substring(s["t"], F.lit(1), F.length(s["t"]) - F.length(s["tail"])), F.lit(_END)), pattern, ""
            ).alias("head"),
            s["tail"].alias("tail"),
        ),
    )
    return F.transform(
        changed,
        lambda s: F.when(
            F.endswith(s["head"], F.lit(_END)),
            F.concat(F.substring(s["head"], F.lit(1), F.length(s["head"]) - len(_END)), s["tail"]),
        ).otherwise(s["head"]),
    )[0]


def html_to_text(c: Column) -> Column:
    """Readable text of an HTML body: no scripts and styles, one line per block."""
    t = F.coalesce(c, F.lit(""))
    t = F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", "")
    for tag in ("script", "style"):
        t = _drop_element(t, tag)
    t = _before_last_close(
        t,
        lambda h: F.regexp_replace(
            F.regexp_replace(F.regexp_replace(h, r"<[!?][^>]*>", ""), _BLOCK, "\n"), _OTHER_TAG, ""
        ),
    )
    t = decode_entities(t)
    t = F.regexp_replace(t, rf"[{V.WS}&&[^{V.LINE_SEP}]]+", " ")
    t = F.regexp_replace(t, rf" ?[{V.LINE_SEP}][ {V.LINE_SEP}]*", "\n")
    return F.btrim(t, F.lit(" \n"))
