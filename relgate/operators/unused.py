"""Definitions nothing refers to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgate.functions.text import words_of

#: The most that is broadcast, and what a term takes there beside its bytes.
BROADCAST_BYTES = 64_000_000
TERM_BYTES = 64


def unreferenced_keys(
    defs: DataFrame, refs: Sequence[tuple[DataFrame, Sequence[str]]], on: Sequence[str]
) -> DataFrame:
    """Keys of ``defs`` that occur in none of ``refs``.

    Each reference is a frame and its columns standing for ``on``. References are
    made distinct per frame before they are put together and joined.
    """
    used = None
    for frame, columns in refs:
        keys = frame.select(*[F.col(c).alias(k) for c, k in zip(columns, on)]).distinct()
        used = keys if used is None else used.unionByName(keys)
    return defs.select(*on).join(used, list(on), "left_anti")


def _tokens(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.explode(words_of(F.col(text_col))).alias("term")).filter("term <> ''")


def terms(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct lower-cased tokens; repeats are dropped on the map side."""
    return _tokens(df, text_col).distinct()


def unreferenced_terms(
    defs: DataFrame,
    defs_text: str,
    refs: DataFrame,
    refs_text: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Terms of the defining texts that no referring text uses.

    The distinct terms are measured first. If they fit into ``broadcast_bytes``, only tokens
    that are among them leave the task that read them; else all distinct tokens do.
    """
    wanted = terms(defs, defs_text)
    used = _tokens(refs, refs_text)
    size = wanted.agg(F.sum(F.octet_length("term") + TERM_BYTES)).first()[0] or 0
    if size <= broadcast_bytes:
        used = used.join(F.broadcast(wanted), "term", "left_semi")
    return wanted.join(used.distinct(), "term", "left_anti")
