"""Pieces of the SQL twins: the same definitions written for a second engine."""

from __future__ import annotations

from docloom.functions.text import SPACE, SPACE_CHARS, WORD

__all__ = ["SPACE", "WORD", "quote", "strip", "words", "word_count", "word_runs", "sentences", "re2"]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {quote(SPACE_CHARS)})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{SPACE}]+')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def word_runs(x: str, min_len: int = 1) -> str:
    return f"regexp_extract_all({x}, '[{WORD}]{{{min_len},}}')"


def sentences(x: str) -> str:
    cut = f"regexp_replace({strip(x)}, '([.!?])[{SPACE}]+', '\\1' || chr(64976), 'g')"
    return f"list_filter(string_split({cut}, chr(64976)), lambda s: s <> '')"


def re2(pattern: str, edge: str = "") -> str:
    """The pattern with Unicode classes; ``edge`` stands for the word boundary."""
    from docloom.functions.text import _expand

    return _expand(pattern, edge).replace("'", "''")


def has_any(x: str, needles) -> str:
    if not needles:
        return "false"
    return "(" + " OR ".join(f"contains({x}, {quote(n)})" for n in needles) + ")"


def any_match(x: str, patterns, edge: str = "", flags: str = "i") -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{re2(p, edge)}', '{flags}')" for p in patterns) + ")"
