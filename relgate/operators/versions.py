"""Versions: parsing, bumping, a running ledger, the latest one."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from relgate.functions import codes
from relgate.functions.semver import (
    BUMP_TYPES,
    version_order,
    version_part,
    version_text,
)
from relgate.functions.settings import START_VERSION
from relgate.operators.skew import heavy_hitters

CHUNK_ROWS = 5_000_000

# Types that a ledger can be ordered by: their order is that of their ordinal.
ORDERED = r"(tinyint|smallint|int|bigint|float|double|decimal.*|date|timestamp|timestamp_ntz)$"

# The heaviest entities may be cut into more ranges than the others. With at most 4096
# heavy entities that is about 1.1 million cut points, some 9 MB.
TOP_ENTITIES = 16
TOP_CHUNKS = 4096
OTHER_CHUNKS = 256

# Up to so many cut points, rows per range (some 100 bytes each) are broadcast.
BROADCAST_POINTS = 100_000


def parse_versions(df: DataFrame, col: str) -> DataFrame:
    """Add ``major, minor, patch`` and ``code``."""
    text = F.col(col)
    parts = df.withColumns(
        {part: version_part(text, i) for i, part in enumerate(BUMP_TYPES, start=1)}
    )
    known = F.col("major").isNotNull() & F.col("minor").isNotNull() & F.col("patch").isNotNull()
    return parts.withColumn("code", F.when(known, codes.PASSED).otherwise(codes.VERSION_ERROR))


def bump_versions(df: DataFrame, col: str, bump_col: str) -> DataFrame:
    """Add ``next_version`` and ``code``; a bad version or bump type gives code 109.

    So does a number that cannot be raised any further.
    """
    bump, zero, one = F.col(bump_col), F.lit(0), F.lit(1)
    major, minor, patch = (F.col(part) for part in BUMP_TYPES)
    parsed = parse_versions(df.withColumn("_version", F.col(col)), "_version")
    after = (
        F.when(bump == "major", version_text(F.try_add(major, one), zero, zero))
        .when(bump == "minor", version_text(major, F.try_add(minor, one), zero))
        .when(bump == "patch", version_text(major, minor, F.try_add(patch, one)))
    )
    after = F.when(F.col("code") == codes.PASSED, after)
    code = F.when(after.isNull(), codes.VERSION_ERROR).otherwise(codes.PASSED)
    return parsed.select(*df.columns, after.alias("next_version"), code.alias("code"))


def latest_version(df: DataFrame, entity: Sequence[str], version: str) -> DataFrame:
    """Highest version per entity, in numeric order; text that is no version is ignored."""
    found = df.groupBy(*entity).agg(F.max_by(version, version_order(F.col(version))).alias(version))
    return found.filter(F.col(version).isNotNull()) if entity else found


def version_ledger(
    events: DataFrame,
    entity: str,
    order: str,
    bump: str,
    start: str = START_VERSION,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Version of each entity after each event: adds ``version``.

    Rows whose bump is no bump type carry the version forward. ``order`` is a number, date
    or timestamp, unique per entity; a NULL comes first; any other type is refused.

    Running counts need an entity's rows in order. An entity of ``chunk_rows`` rows or
    more is cut into ranges of ``order`` of about that size; each range is counted on
    its own, and the counts of the ranges before it are added. Cut points are found by
    jobs run before the plan is built, and only for the (at most 4096) heaviest entities.
    """
    if not re.match(ORDERED, dict(events.dtypes)[order]):
        raise TypeError(f"{order} is no number, date or timestamp")
    cuts, points = _heavy_cuts(events, entity, order, chunk_rows)
    if cuts is None:
        counted = _running(events, [entity], order, bump)
        return _with_version(counted, events.columns, start, carried=False)

    chunked = events.join(
        F.broadcast(cuts), F.col(entity).eqNullSafe(F.col("_cut_entity")), "left"
    ).withColumn("_chunk", _chunk_of(F.col("_cuts"), _ordinal(events, order)))
    counted = _running(chunked, [entity, "_chunk"], order, bump)
    heavy_rows = chunked.filter(F.col("_cuts").isNotNull())
    # Per range there is one row of either; adaptive execution decides beyond the bound.
    hint = F.broadcast if points <= BROADCAST_POINTS else lambda df: df
    carry = hint(_carried_in(_chunk_totals(heavy_rows, entity, order, bump, hint), entity))
    joined = counted.join(
        carry,
        F.col(entity).eqNullSafe(F.col("_carry_entity"))
        & (F.col("_chunk") == F.col("_carry_chunk")),
        "left",
    )
    return _with_version(joined, events.columns, start, carried=True)


def _ordinal(events: DataFrame, order: str) -> Column:
    """The order as a number that never falls where the order rises."""
    dtype = dict(events.dtypes)[order]
    at = F.col(order)
    if dtype == "timestamp":
        return F.unix_micros(at)
    days = F.unix_date(at.cast("date")).cast("bigint")
    if dtype == "date":
        return days
    if dtype == "timestamp_ntz":
        # A cast to timestamp would follow the session's clock changes.
        minutes = (days * 24 + F.hour(at)) * 60 + F.minute(at)
        seconds = F.extract(F.lit("SECOND"), at)
        return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return at.cast("double")
    return at.cast("bigint")


def _heavy_cuts(
    events: DataFrame, entity: str, order: str, chunk_rows: int
) -> tuple[DataFrame | None, int]:
    """Cut points ``(_cut_entity, _cuts)`` of the heavy entities, None if there are none,
    and how many there are.

    The result is fetched (its size is bounded, see above) and made a literal frame, so
    every later stage, retried or not, cuts at the same points.
    """
    spark = events.sparkSession
    counts = events.groupBy(entity).agg(F.count("*").alias("_n"))
    heavy = heavy_hitters(counts, entity, "_n", chunk_rows).select(
        F.col(entity).alias("_cut_entity"), "_n"
    )
    found = heavy.collect()
    if not found:
        return None, 0
    ordinal = _ordinal(events, order)
    blocks = []
    for entities, most in (
        (found[:TOP_ENTITIES], TOP_CHUNKS),
        (found[TOP_ENTITIES:], OTHER_CHUNKS),
    ):
        if not entities:
            continue
        chunks = min(most, 1 + math.ceil(entities[0]["_n"] / chunk_rows))
        shares = [i / chunks for i in range(1, chunks)]
        keys = F.broadcast(spark.createDataFrame(entities, heavy.schema).drop("_n"))
        cuts = (
            events.join(keys, F.col(entity).eqNullSafe(F.col("_cut_entity")))
            .groupBy("_cut_entity")
            .agg(F.percentile_approx(ordinal, shares, 5 * chunks).alias("_cuts"))
        )
        side = math.isqrt(chunks - 1) + 1
        for key, points in cuts.collect():
            points = sorted(set(points))
            blocks.append((key, [points[i : i + side] for i in range(0, len(points), side)]))
    fractional = re.match("float|double|decimal", dict(events.dtypes)[order])
    schema = StructType([heavy.schema["_cut_entity"]]).add(
        "_cuts", ArrayType(ArrayType(DoubleType() if fractional else LongType()))
    )
    points = sum(len(block) for _, cut in blocks for block in cut)
    return spark.createDataFrame(blocks, schema), points


def _chunk_of(cuts: Column, ordinal: Column) -> Column:
    """Number of cut points below ``ordinal``, 0 without cut points.

    Cut points come in blocks of equal length, so only the block ends and one block
    are looked at.
    """
    full_blocks = F.size(F.filter(cuts, lambda block: F.element_at(block, -1) < ordinal))
    partial = F.size(F.filter(F.get(cuts, full_blocks), lambda cut: cut < ordinal))
    before = full_blocks * F.size(F.get(cuts, F.lit(0)))
    # After the last block there is no partial one, and all cut points are below.
    inside = F.when(full_blocks < F.size(cuts), before + partial).otherwise(
        F.size(F.flatten(cuts))
    )
    return F.when(cuts.isNull(), 0).otherwise(inside)


def _bump_tests(bump: str) -> list[Column]:
    return [F.coalesce(F.col(bump) == b, F.lit(False)) for b in BUMP_TYPES]


def _running(df: DataFrame, keys: list[str], order: str, bump: str) -> DataFrame:
    """Running counts per key: all bumps so far, and minors/patches at the last reset.

    All four windows share one partitioning and order: one shuffle, one sort.
    """
    upto = (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    is_major, is_minor, is_patch = _bump_tests(bump)
    totals = df.withColumns(
        {
            "_majors": F.sum(is_major.cast("bigint")).over(upto),
            "_minors": F.sum(is_minor.cast("bigint")).over(upto),
            "_patches": F.sum(is_patch.cast("bigint")).over(upto),
        }
    )
    # The counts never fall, so their maximum over reset rows is the one at the last reset.
    return totals.withColumns(
        {
            "_minor_reset": F.max(F.when(is_major, F.col("_minors"))).over(upto),
            "_patch_reset": F.max(F.when(is_major | is_minor, F.col("_patches"))).over(upto),
        }
    )


def _chunk_totals(
    heavy_rows: DataFrame,
    entity: str,
    order: str,
    bump: str,
    hint: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """What ``_running`` ends with in each chunk of the heavy entities.

    Two aggregations, partly done on the map side, so the rows are neither shuffled nor
    sorted for it: the first finds the last resets, the second counts up to them.
    """
    is_major, is_minor, is_patch = _bump_tests(bump)
    at = F.col(order)
    chunk = [F.col(entity).alias("_reset_entity"), F.col("_chunk").alias("_reset_chunk")]
    resets = heavy_rows.groupBy(*chunk).agg(
        F.max(F.when(is_major, at)).alias("_last_major"),
        F.max(F.when(is_major | is_minor, at)).alias("_last_reset"),
    )
    known = heavy_rows.join(
        hint(resets),
        F.col(entity).eqNullSafe(F.col("_reset_entity"))
        & (F.col("_chunk") == F.col("_reset_chunk")),
    )

    def before(last: str) -> Column:
        # The one row without an order comes first, before any reset that has one.
        return F.col(last).isNotNull() & F.coalesce(at < F.col(last), F.lit(True))

    minors_before = F.count_if(is_minor & before("_last_major"))
    patches_before = F.count_if(is_patch & before("_last_reset"))
    return known.groupBy(entity, "_chunk").agg(
        F.count_if(is_major).alias("_majors"),
        F.count_if(is_minor).alias("_minors"),
        F.count_if(is_patch).alias("_patches"),
        F.when(F.count_if(is_major) > 0, minors_before).alias("_minor_reset"),
        F.when(F.count_if(is_major | is_minor) > 0, patches_before).alias("_patch_reset"),
    )


def _carried_in(per_chunk: DataFrame, entity: str) -> DataFrame:
    """Counts of all earlier chunks, per chunk of a heavy entity."""
    before = (
        Window.partitionBy(entity).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = per_chunk.select(
        entity,
        "_chunk",
        F.coalesce(F.sum("_majors").over(before), F.lit(0)).alias("_in_majors"),
        F.coalesce(F.sum("_minors").over(before), F.lit(0)).alias("_in_minors"),
        F.coalesce(F.sum("_patches").over(before), F.lit(0)).alias("_in_patches"),
        "_minor_reset",
        "_patch_reset",
    )
    return summed.select(
        F.col(entity).alias("_carry_entity"),
        F.col("_chunk").alias("_carry_chunk"),
        "_in_majors",
        "_in_minors",
        "_in_patches",
        F.max(F.col("_in_minors") + F.col("_minor_reset")).over(before).alias("_in_minor_reset"),
        F.max(F.col("_in_patches") + F.col("_patch_reset")).over(before).alias("_in_patch_reset"),
    )


def _with_version(df: DataFrame, columns: list[str], start: str, carried: bool) -> DataFrame:
    start_major, start_minor, start_patch = (int(part) for part in start.split("."))

    def total(own: str, before: str) -> Column:
        if not carried:
            return F.col(own)
        return F.col(own) + F.coalesce(F.col(before), F.lit(0))

    def reset(own: str, before: str, earlier: str) -> Column:
        if not carried:
            return F.col(own)
        return F.coalesce(F.col(own) + F.coalesce(F.col(before), F.lit(0)), F.col(earlier))

    majors = total("_majors", "_in_majors")
    minors = total("_minors", "_in_minors")
    patches = total("_patches", "_in_patches")
    minor_reset = reset("_minor_reset", "_in_minors", "_in_minor_reset")
    patch_reset = reset("_patch_reset", "_in_patches", "_in_patch_reset")
    # The start's own minor and patch count only until the first reset.
    minor = minors - F.coalesce(minor_reset, F.lit(-start_minor))
    patch = patches - F.coalesce(patch_reset, F.lit(-start_patch))
    return df.select(
        *columns, version_text(majors + start_major, minor, patch).alias("version")
    )
