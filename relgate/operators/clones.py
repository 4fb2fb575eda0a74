"""Duplication: exact clones, repeated line windows, duplication percent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relgate.functions import codes
from relgate.functions.settings import CLONE_LINES, MAX_DUPLICATES
from relgate.functions.text import digest, lines_of
from relgate.operators.skew import HOT_MIN, join_key_stats


def exact_clones(df: DataFrame, id_col: str, text_col: str, hot_min: int = HOT_MIN) -> DataFrame:
    """Members of groups of equal texts: ``(group_id, id, n)``, group_id = lowest id.

    Only digests are shuffled. Group sizes are counted with partial aggregation,
    and members of very large groups are joined back without a shuffle.
    """
    whole = F.coalesce(F.unhex(F.sha2(F.col(text_col), 256)), F.lit(b""))
    digests = df.filter(F.col(text_col).isNotNull()).select(id_col, whole.alias("_digest"))
    groups = (
        digests.groupBy("_digest")
        .agg(F.min(id_col).alias("group_id"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    members = join_key_stats(digests, groups, "_digest", "n", hot_min)
    return members.select("group_id", id_col, "n")


def drop_clones(df: DataFrame, id_col: str, text_col: str, hot_min: int = HOT_MIN) -> DataFrame:
    """``df`` with one row of each group of equal texts, that of the lowest id.

    Rows without a text all stay, and so do rows without an id. Ids are unique. What is
    to go is found from digests; the rows themselves meet only the list of ids to drop.
    """
    members = exact_clones(df, id_col, text_col, hot_min)
    return df.join(members.filter(F.col(id_col) != F.col("group_id")).select(id_col), id_col, "left_anti")


def _line_digests(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    lines = F.transform(lines_of(F.col(text_col)), digest)
    return df.filter(F.col(text_col).isNotNull()).select(*keep, lines.alias("_lines"))


def _window_digests(k: int) -> Column:
    """Digests of all runs of ``k`` lines of ``_lines``, NULL if it has fewer lines.

    Each line is digested once and a window digests its ``k`` line digests, so long
    lines are not read ``k`` times. Nothing is grouped: a text stays in its row.
    """

    def window_digest(i: Column) -> Column:
        parts = [F.get(F.col("_lines"), i + offset) for offset in range(k)]
        return digest(F.concat(*parts))

    starts = F.sequence(F.lit(0), F.size("_lines") - k)
    return F.when(F.size("_lines") >= k, F.transform(starts, window_digest))


def line_windows(df: DataFrame, id_col: str, text_col: str, k: int = CLONE_LINES) -> DataFrame:
    """Digest of every run of ``k`` consecutive lines: ``(id, start, digest)``."""
    lines = _line_digests(df, text_col, id_col)
    return lines.select(id_col, F.posexplode(_window_digests(k)).alias("start", "digest"))


def window_counts(df: DataFrame, text_col: str, k: int = CLONE_LINES) -> DataFrame:
    """Occurrences of each window digest: ``(digest, n)``.

    A text of ``m`` lines has ``m - k + 1`` windows. The lines that start none, at most
    ``k - 1``, are counted under the empty digest, so ``n`` sums to the number of lines
    and no second pass is needed to count them.
    """
    rest = F.array_repeat(F.lit(b""), F.least(F.size("_lines"), F.lit(k - 1)))
    entries = F.concat(F.coalesce(_window_digests(k), F.array().cast("array<binary>")), rest)
    exploded = _line_digests(df, text_col).select(F.explode(entries).alias("digest"))
    # The join on the digest asks for this filter; made here, both its uses share one shuffle.
    counted = exploded.filter(F.col("digest").isNotNull())
    return counted.groupBy("digest").agg(F.count("*").alias("n"))


def clone_runs(
    df: DataFrame, id_col: str, text_col: str, k: int = CLONE_LINES, hot_min: int = HOT_MIN
) -> DataFrame:
    """Runs of lines covered by repeated windows: ``(id, start, n_lines)``, no overlap.

    A repeated window covers ``k`` lines from its start, cut short where the next
    repeated window of the same text begins. The window is per text, so a task
    never holds more than the lines of one record at a time.
    """
    # One condition on both columns stays above the aggregate; a filter on the digest
    # alone would move below it, and the counts could not be shared with the total.
    occurrences = F.when(F.col("digest") == F.lit(b""), 0).otherwise(F.col("n"))
    repeated = window_counts(df, text_col, k).filter(occurrences > 1)
    windows = line_windows(df, id_col, text_col, k)
    hits = join_key_stats(windows, repeated, "digest", "n", hot_min)
    following = F.lead("start").over(Window.partitionBy(id_col).orderBy("start"))
    return hits.select(
        id_col,
        "start",
        F.least(F.lit(k), F.coalesce(following - F.col("start"), F.lit(k))).alias("n_lines"),
    )


def window_clones(
    df: DataFrame, id_col: str, text_col: str, k: int = CLONE_LINES, hot_min: int = HOT_MIN
) -> DataFrame:
    """Every line covered by a repeated window of ``k`` lines, once: ``(id, line_no)``."""
    runs = clone_runs(df, id_col, text_col, k, hot_min)
    last = F.col("start") + F.col("n_lines") - 1
    return runs.select(id_col, F.explode(F.sequence("start", last)).alias("line_no"))


def duplication(
    df: DataFrame, id_col: str, text_col: str, k: int = CLONE_LINES, hot_min: int = HOT_MIN
) -> DataFrame:
    """One row ``(dup_lines, total_lines, pct)``; pct is NULL when there are no lines.

    Covered lines are summed from run lengths, so they are never materialised. The
    total comes from the same window counts the runs are found with.
    """
    total = window_counts(df, text_col, k).agg(F.sum("n"))
    runs = clone_runs(df, id_col, text_col, k, hot_min)
    counts = runs.agg(
        F.coalesce(F.sum("n_lines"), F.lit(0)).cast("bigint").alias("dup_lines")
    ).withColumn("total_lines", total.scalar())
    return counts.withColumn("pct", F.try_divide(100.0 * F.col("dup_lines"), F.col("total_lines")))


def duplication_gate(
    df: DataFrame,
    id_col: str,
    text_col: str,
    max_pct: float = MAX_DUPLICATES,
    k: int = CLONE_LINES,
    hot_min: int = HOT_MIN,
) -> DataFrame:
    """``duplication`` with ``failed`` (strictly above the limit, or unmeasured) and ``code``.

    The limit is held against the exact percent; ``pct`` is then rounded to 6 places.
    """
    measured = duplication(df, id_col, text_col, k, hot_min)
    failed = F.coalesce(F.col("pct") > max_pct, F.lit(True))
    judged = measured.withColumn("failed", failed).withColumn("pct", F.round("pct", 6))
    return judged.withColumn(
        "code", F.when(F.col("failed"), codes.QUALITY_ERROR).otherwise(codes.PASSED)
    )
