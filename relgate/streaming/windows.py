"""Gates over windows of event time, and streams without repeated events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgate.functions import codes


def windowed_gate(
    stream: DataFrame,
    at: str,
    group: Sequence[str],
    max_rows: int,
    window: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """``(window_start, window_end, group, n_rows, failed, code)`` of every closed window.

    A window is closed once an event ``delay`` after its end was seen; its row is then
    given once, and later events of it are dropped and counted in the query's progress. ``failed``
    is strictly above ``max_rows``. State is one count per open window and group, merged
    before the shuffle, so a group of most events is no burden. Events without a time
    are in no window. ``at`` is a timestamp; one without a time zone is read in the session's.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    counts = timed.groupBy(F.window(at, window), *group).agg(F.count("*").alias("n_rows"))
    failed = F.col("n_rows") > max_rows
    return counts.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *group,
        "n_rows",
        failed.alias("failed"),
        F.when(failed, codes.QUALITY_ERROR).otherwise(codes.PASSED).alias("code"),
    )


def without_repeats(stream: DataFrame, keys: Sequence[str], at: str, delay: str = "1 hour") -> DataFrame:
    """The first row of every key; rows that repeat it within ``delay`` of event time are dropped.

    A key is kept in the state until the watermark has passed its time and ``delay``, so the
    state holds the keys of the last hours and not of all times. Rows without a time take
    no part, as nothing would ever end their state.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).filter(F.col(at).isNotNull())
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
