"""Quality gates: metrics, bands, limits, report lines, summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgate.functions import codes
from relgate.functions.settings import BANDS
from relgate.functions.text import glob_regex, token_count


def flatten_report(df: DataFrame, map_col: str, metric: str = "complexity") -> DataFrame:
    """A nested report as rows ``(file, pos, name, metric)``."""
    return (
        df.select(F.explode(map_col).alias("file", "_blocks"))
        .select("file", F.posexplode("_blocks").alias("pos", "_block"))
        .select("file", "pos", F.col("_block.name"), F.col(f"_block.{metric}").alias("metric"))
    )


def band_of(metric: Column, bands: Mapping[str, int] = BANDS) -> Column:
    """The band of a metric: up to one below the next band's lower bound it is in the lower.

    So 5 is A, 5.5 is B, and whatever lies below all bands is in the lowest.
    """
    (lowest, _), *higher = sorted(bands.items(), key=lambda item: item[1])
    found = [F.when(metric > low - 1, F.lit(name)) for name, low in reversed(higher)]
    return F.coalesce(*found, F.when(metric.isNotNull(), F.lit(lowest)))


def band_filter(
    df: DataFrame, metric: str, min_band: str = "C", bands: Mapping[str, int] = BANDS
) -> DataFrame:
    """Rows of ``min_band`` or worse, with ``band``.

    The filter is on the metric itself, so it can move below the band expression
    and into the scan.
    """
    lowest = bands[min_band] == min(bands.values())
    kept = df.filter(F.col(metric).isNotNull() if lowest else F.col(metric) > bands[min_band] - 1)
    return kept.withColumn("band", band_of(F.col(metric), bands))


def threshold_violations(df: DataFrame, metric: str, max_value: float) -> DataFrame:
    """Rows whose metric is strictly above the limit."""
    return df.filter(F.col(metric) > max_value)


def first_violation(
    df: DataFrame, order_cols: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """The first row by ``order_cols``, overall or per group; an aggregate, not a sort."""
    rest = [c for c in df.columns if c not in group]
    first = F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_first")
    found = df.groupBy(*group).agg(first).filter(F.col("_first").isNotNull())
    return found.select(*group, "_first.*").select(*df.columns)


def metric_average(
    df: DataFrame, metric: str, by: Sequence[str] = (), bands: Mapping[str, int] = BANDS
) -> DataFrame:
    """Sum, count, average (6 places) of a metric and the average's band."""
    totals = df.groupBy(*by).agg(
        F.sum(metric).alias("metric_sum"), F.count(metric).alias("n_blocks")
    )
    ratio = F.try_divide(F.col("metric_sum").cast("double"), F.col("n_blocks"))
    return totals.withColumn("metric_avg", F.round(ratio, 6)).withColumn(
        "band", band_of(ratio, bands)
    )


def token_score(df: DataFrame, text: str, tokens: list[str]) -> DataFrame:
    """Add ``score``: one plus the occurrences of branching tokens in the text."""
    return df.withColumn("score", 1 + token_count(F.col(text), tokens))


def scrape_metric(
    lines: DataFrame,
    id_col: str,
    must_contain: Sequence[str],
    pattern: str,
    group: int = 1,
) -> DataFrame:
    """First matching report line per id and its number: ``(id, line_no, value, status)``.

    A line matches if it holds every string of ``must_contain``, case folded. An id
    with no matching line, or whose line's number cannot be read, is ``unmeasured``.
    """
    line = F.col("line")
    folded = F.lower(line)
    matching = F.lit(True)
    for needle in must_contain:
        matching = matching & folded.contains(needle.lower())
    at = F.when(matching, F.col("line_no"))
    first = (
        lines.withColumn("_at", at)
        .groupBy(id_col)
        .agg(F.min_by("line", "_at").alias("_line"), F.min("_at").alias("line_no"))
        .withColumn("_text", F.regexp_extract("_line", pattern, group))
    )
    value = F.col("_text").try_cast("double")
    return first.select(
        id_col,
        "line_no",
        value.alias("value"),
        F.when(value.isNull(), "unmeasured").otherwise("measured").alias("status"),
    )


def exclude(df: DataFrame, col: str, globs: Sequence[str]) -> DataFrame:
    """Rows whose value matches none of the globs. Apply before any shuffle.

    A glob with nothing but a trailing ``*`` becomes a prefix test, which the scan
    can use; any other glob becomes a regex.
    """
    kept = df
    for glob in globs:
        stem = glob[:-1]
        if glob.endswith("*") and "*" not in stem and "?" not in stem:
            hit = F.col(col).startswith(stem)
        else:
            hit = F.col(col).rlike(glob_regex(glob))
        kept = kept.filter(F.col(col).isNull() | ~hit)
    return kept


def gate_result(
    measure: DataFrame, ord_: int, gate: str, measured: str, limit: float
) -> DataFrame:
    """One gate row from a one-row measurement. No measurement is a failure."""
    value = F.col(measured).cast("double")
    failed = F.coalesce(value > limit, F.lit(True))
    return measure.select(
        F.lit(ord_).alias("ord"),
        F.lit(gate).alias("gate"),
        F.round(value, 6).alias("measured"),
        F.lit(float(limit)).alias("limit"),
        failed.alias("failed"),
        F.when(failed, codes.QUALITY_ERROR).otherwise(codes.PASSED).alias("code"),
    )


def gate_summary(gates: Sequence[DataFrame]) -> DataFrame:
    """All gates in their order; those after the first failure read ``skipped``.

    Each frame is one row, so the rows are put in one array (as long as ``gates``) to
    find the first failure without evaluating any gate twice.
    """
    rows = gates[0]
    for gate in gates[1:]:
        rows = rows.unionByName(gate)
    together = rows.agg(
        F.collect_list(F.struct(*rows.columns)).alias("_gates"),
        F.min(F.when(F.col("failed"), F.col("ord"))).alias("_stop"),
    )
    status = (
        F.when(F.col("ord") > F.col("_stop"), "skipped")
        .when(F.col("measured").isNull(), "unmeasured")
        .when(F.col("failed"), "failed")
        .otherwise("passed")
    )
    return together.select("_stop", F.inline("_gates")).select(
        *rows.columns, status.alias("status")
    )
