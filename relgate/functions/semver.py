"""Semantic version expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII digits only, and no trailing newline: hence \z, not $.
VERSION_PATTERN = r"\A[0-9]+\.[0-9]+\.[0-9]+\z"

BUMP_TYPES = ("major", "minor", "patch")


def version_part(version: Column, position: int) -> Column:
    """One number of a version (1 to 3), NULL when the text is no version.

    All parts share the pattern test, so it is evaluated once per row.
    """
    part = F.split_part(version, F.lit("."), F.lit(position))
    return F.when(version.rlike(VERSION_PATTERN), part).try_cast("bigint")


def version_order(version: Column) -> Column:
    """``(major, minor, patch)``, which orders numerically; NULL when the text is no version.

    The pattern is tested once per row.
    """
    parts = [F.split_part(version, F.lit("."), F.lit(i)).try_cast("bigint") for i in (1, 2, 3)]
    known = version.rlike(VERSION_PATTERN)
    for part in parts:
        known = known & part.isNotNull()
    return F.when(known, F.struct(*[p.alias(name) for p, name in zip(parts, BUMP_TYPES)]))


def version_text(major: Column, minor: Column, patch: Column) -> Column:
    """``major.minor.patch``, NULL if a part is NULL."""
    dot = F.lit(".")
    return F.concat(
        major.cast("string"), dot, minor.cast("string"), dot, patch.cast("string")
    )
