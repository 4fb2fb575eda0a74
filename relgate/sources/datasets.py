"""Scans: released tables, nested report columns, text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relgate.functions.text import lines_of

REPORT_SCHEMA = "map<string, array<struct<name: string, complexity: int>>>"


def read_dataset(
    spark: SparkSession,
    root: str,
    name: str,
    version: str | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """A parquet dataset ``root/name``, or one published version of it.

    ``columns`` narrows the scan; filters on the result reach the scan as well.
    """
    path = f"{root}/{name}" if version is None else f"{root}/{name}/version={version}"
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def parse_report(
    df: DataFrame, col: str, schema: str | StructType = REPORT_SCHEMA, out: str = "report"
) -> DataFrame:
    """Parse a JSON report column; a malformed report gives NULL, not an error."""
    return df.withColumn(out, F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"}))


def to_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: ``(id, line_no, line)``, lines counted from 0."""
    return df.select(id_col, F.posexplode(lines_of(F.col(text_col))).alias("line_no", "line"))
