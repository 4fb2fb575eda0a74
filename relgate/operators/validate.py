"""Record validation: what is missing, malformed, too short or incomplete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgate.functions import codes
from relgate.functions.codes import with_code_name
from relgate.functions.settings import MIN_TEXT_LENGTH


def missing_entities(
    expected: DataFrame, actual: DataFrame, on: list[str], code: int = codes.MISSING_RECORD
) -> DataFrame:
    """Expected keys that have no row in ``actual``, with ``code``.

    ``actual`` is reduced to distinct keys before the join, so a key with very
    many rows is collapsed on the map side.
    """
    present = actual.select(*on).distinct()
    return expected.select(*on).join(present, on, "left_anti").withColumn("code", F.lit(code))


def split_malformed(df: DataFrame, json_col: str) -> DataFrame:
    """Add ``is_valid`` and ``code``: absent text and unparsable text differ."""
    text = F.col(json_col)
    parsed = F.try_parse_json(text)
    return df.withColumn(
        "code",
        F.when(text.isNull(), codes.MISSING_RECORD)
        .when(parsed.isNull(), codes.INVALID_RECORD)
        .otherwise(codes.PASSED),
    ).withColumn("is_valid", F.col("code") == codes.PASSED)


def first_missing_field(json: Column, fields: Sequence[str], parent: str | None = None) -> Column:
    """First of ``fields`` that is no key of the JSON object, in the given order.

    A key holding an explicit null is present.
    """
    scope = F.get_json_object(json, f"$.{parent}") if parent else json
    keys = F.coalesce(F.json_object_keys(scope), F.array().cast("array<string>"))
    return F.get(F.array_except(F.array(*[F.lit(f) for f in fields]), keys), F.lit(0))


def required_fields(
    df: DataFrame, json_col: str, fields: Sequence[str], parent: str | None = None
) -> DataFrame:
    """Add ``missing_field``, NULL when all fields are there."""
    return df.withColumn("missing_field", first_missing_field(F.col(json_col), fields, parent))


def too_short(text: Column, n: int = MIN_TEXT_LENGTH) -> Column:
    """Fewer than ``n`` characters (code points); absent text is too short."""
    return F.coalesce(F.length(text), F.lit(0)) < n


def min_length(df: DataFrame, col: str, n: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Rows whose text is shorter than ``n`` characters."""
    return df.filter(too_short(F.col(col), n))


def first_missing_section(text: Column, sections: Sequence[str], prefix: str = "") -> Column:
    """First section whose marker is nowhere in the text; literal and unanchored."""
    return F.coalesce(
        *[
            F.when(~F.coalesce(text.contains(prefix + s), F.lit(False)), F.lit(s))
            for s in sections
        ]
    )


def required_sections(
    df: DataFrame, col: str, sections: Sequence[str], prefix: str = ""
) -> DataFrame:
    """Add ``missing_section``, NULL when all sections are there."""
    return df.withColumn("missing_section", first_missing_section(F.col(col), sections, prefix))


def verdict(
    df: DataFrame, keys: list[str], checks: Sequence[tuple[Column, int, Column | str]]
) -> DataFrame:
    """``(keys, code, message)`` of the first failing check, code 0 when none fails.

    ``checks`` are ``(fails, code, message)`` in order. Later checks of a row are
    not evaluated once one failed.
    """
    failures = [F.when(fails, _outcome(code, message)) for fails, code, message in checks]
    outcome = F.coalesce(*failures, _outcome(codes.PASSED, F.lit(None)))
    return df.select(*keys, outcome.alias("_outcome")).select(
        *keys, F.col("_outcome.code"), F.col("_outcome.message")
    )


def _outcome(code: int, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), text.cast("string").alias("message"))


def text_checks(
    col: str, n: int, sections: Sequence[str], prefix: str = ""
) -> list[tuple[Column, int, Column]]:
    """The text part of a verdict: absent, too short, then a section missing."""
    text = F.col(col)
    missing = first_missing_section(text, sections, prefix)
    return [
        (text.isNull(), codes.MISSING_TEXT, F.lit("text is absent")),
        (too_short(text, n), codes.INVALID_TEXT, F.lit(f"text is shorter than {n} characters")),
        (
            missing.isNotNull(),
            codes.INVALID_TEXT,
            F.concat(F.lit("missing section: "), missing),
        ),
    ]


def record_checks(
    json_col: str, fields: Sequence[str], parent: str | None = None
) -> list[tuple[Column, int, Column]]:
    """The manifest part of a verdict: absent, malformed, then a field missing."""
    text = F.col(json_col)
    missing = first_missing_field(text, fields, parent)
    return [
        (text.isNull(), codes.MISSING_RECORD, F.lit("record is absent")),
        (F.try_parse_json(text).isNull(), codes.INVALID_RECORD, F.lit("record is not JSON")),
        (missing.isNotNull(), codes.INVALID_RECORD, F.concat(F.lit("missing field: "), missing)),
    ]


def validation_report(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per code and group, with the code's name."""
    counts = verdicts.groupBy(*by, "code").agg(F.count("*").alias("n_rows"))
    return with_code_name(counts).select(*by, "code", "code_name", "n_rows")
