"""Text of HTML, Markdown and JSON documents."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as t

# Comments, declarations, and the elements whose content is no text.
_HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>|<![^>]*>|<\?[^>]*>"
_TAG = r"(?s)</?[a-zA-Z](?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>"
_NAMES = {**{k: chr(v) for k, v in name2codepoint.items()}, "apos": "'"}


def unescape(text: Column) -> Column:
    """Named and numeric character references."""
    names = t.table([{"n": n, "c": c} for n, c in sorted(_NAMES.items())], "array<struct<n:string,c:string>>")
    lookup = F.map_from_entries(names)

    def decode(piece: Column, i: Column) -> Column:
        ref = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        rest = F.substring(piece, F.length(ref) + 2, F.length(piece))
        digits = F.when(
            F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substring(ref, F.lit(3), F.length(ref)), 16, 10)
        ).otherwise(F.substring(ref, F.lit(2), F.length(ref)))
        code = F.lpad(F.hex(digits.cast("long")), 8, "0")
        char = F.when(ref.startswith("#"), F.decode(F.unhex(code), "UTF-32")).otherwise(F.element_at(lookup, ref))
        known = (i > 0) & (ref != "") & char.isNotNull()
        return (
            F.when(known, F.concat(char, rest)).when(i > 0, F.concat(F.lit("&"), piece)).otherwise(piece)
        )

    decoded = F.array_join(F.transform(F.split(text, "&"), decode), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def html_text(html: Column) -> Column:
    """The text between the tags; scripts, styles and comments have none."""
    return unescape(F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _TAG, ""))


# (pattern, replacement) in order: block marks first, then inline marks.
_MARKDOWN = [
    (r"(?m)^ {0,3}(?:```|~~~).*$\n?", ""),
    (r"(?m)^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", "$1"),
    (r"(?m)^ {0,3}(?:[-*_][ \t]*){3,}$", ""),
    (r"(?m)^ {0,3}>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"`([^`]+)`", "$1"),
]


def markdown_text(source: Column) -> Column:
    """Text of a Markdown document: marks are removed, then tags and references."""
    out = source
    for pattern, replacement in _MARKDOWN:
        out = F.regexp_replace(out, pattern, replacement)
    return html_text(out)
