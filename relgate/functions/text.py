"""Text expressions: lines, words, tokens, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """Lines of a text. Splits on a newline only and keeps empty lines."""
    return F.split(text, "\n")


def words_of(text: Column) -> Column:
    """Lower-cased tokens between whitespace; holds an empty one between two in a row.

    A split at one plain character needs no regular expression engine, and a replacement
    passes over texts without its character faster than a translation.
    """
    blank = F.lower(text)
    for space in "\t\n\x0b\f\r":
        blank = F.replace(blank, F.lit(space), F.lit(" "))
    return F.split(blank, " ")


def token_count(text: Column, tokens: list[str]) -> Column:
    """Occurrences of whole whitespace-delimited tokens, case folded."""
    wanted = [t.lower() for t in tokens]
    return F.size(F.filter(words_of(text), lambda word: word.isin(*wanted)))


def digest(value: Column) -> Column:
    """128-bit digest of a text or of bytes, 16 bytes; empty for NULL, so never NULL.

    A column that cannot be NULL as a join key needs no null filter, which would
    digest everything a second time.
    """
    return F.coalesce(F.unhex(F.md5(value)), F.lit(b""))


def quote_regex(literal: str) -> str:
    """Escape a literal for a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", literal)


def glob_regex(glob: str) -> str:
    """Java regex for a whole-string glob: ``*`` any run, ``?`` any one character."""
    wild = {"*": ".*", "?": "."}
    body = "".join(wild.get(ch) or quote_regex(ch) for ch in glob)
    return rf"(?s)\A{body}\z"
