"""Joining rows back to a per-key aggregate when a few keys hold most rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_MIN = 100_000
MAX_HOT = 4096


def heavy_hitters(
    stats: DataFrame, key: str, weight: str, hot_min: int = HOT_MIN, max_hot: int = MAX_HOT
) -> DataFrame:
    """The keys with the most rows: at most ``max_hot`` of them, so safe to broadcast.

    A key left out has fewer than ``hot_min`` rows or is outweighed by ``max_hot``
    others, so it holds at most one part in ``max_hot + 1`` of all rows.
    """
    return (
        stats.filter(F.col(weight) >= hot_min)
        .orderBy(F.col(weight).desc(), F.col(key))
        .limit(max_hot)
    )


def join_key_stats(
    rows: DataFrame,
    stats: DataFrame,
    key: str,
    weight: str,
    hot_min: int = HOT_MIN,
    max_hot: int = MAX_HOT,
) -> DataFrame:
    """Inner join of ``rows`` to ``stats`` (one row per ``key``, ``weight`` = its rows).

    Rows are read once. Those of a heavy key get their stats from a broadcast list where
    they were read; in the shuffle join that all other rows meet their stats by, they are
    spread by a hash of the whole row. Rows with a NULL key match nothing; put the key
    in a struct to have NULLs match.
    """
    names = [c for c in stats.columns if c != key]
    entries = F.struct(*names)
    hot = heavy_hitters(stats, key, weight, hot_min, max_hot).select(
        F.col(key).alias("_hot_key"), entries.alias("_hot")
    )
    keyed = rows.filter(F.col(key).isNotNull())
    tagged = keyed.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    hashable = [c for c, kind in rows.dtypes if not re.search("map<|variant", kind)]
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64(*hashable))
    # One key of both parts: a second, constant one would be folded away, and the rows of
    # a heavy key would meet in one task.
    cold = stats.filter(F.col(key).isNotNull()).select(
        F.struct(F.col(key).alias("key"), F.lit(None).cast("bigint").alias("spread")).alias("_place"),
        entries.alias("_cold"),
    )
    placed = tagged.withColumn("_at", F.struct(F.col(key).alias("key"), spread.alias("spread")))
    joined = placed.join(cold, F.col("_at") == F.col("_place"), "left")
    found = joined.withColumn("_stats", F.coalesce("_hot", "_cold")).filter("_stats IS NOT NULL")
    return found.select(*rows.columns, *[F.col(f"_stats.{c}").alias(c) for c in names])
