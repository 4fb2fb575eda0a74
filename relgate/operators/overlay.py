"""Settings: defaults, overrides, section checks, typed lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgate.functions import codes
from relgate.functions.settings import DEFAULT_SETTINGS, SECTIONS


def default_rows(
    entities: DataFrame, defaults: Mapping[str, Mapping[str, Any]] = DEFAULT_SETTINGS
) -> DataFrame:
    """Every default setting for every entity: adds ``section, key, value``.

    The defaults are a literal array exploded in each row, so there is no join.
    """
    text = F.lit(None).cast("string")
    settings = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(key).alias("key"),
            (text if value is None else F.lit(str(value))).alias("value"),
        )
        for section, keys in defaults.items()
        for key, value in keys.items()
    ]
    exploded = entities.select("*", F.explode(F.array(*settings)).alias("_setting"))
    return exploded.select(*entities.columns, "_setting.*")


def overlay(
    defaults: DataFrame, overrides: DataFrame, keys: Sequence[str], value: str = "value"
) -> DataFrame:
    """Overrides on defaults per key: ``(keys, value, origin)``.

    A key present in ``overrides`` wins even with a NULL value; keys only one side
    has are kept. Keys are unique on each side.
    """
    base = defaults.select(*keys, F.col(value).alias("_default"))
    over = overrides.select(*keys, F.col(value).alias("_override"), F.lit(True).alias("_present"))
    present = F.col("_present").isNotNull()
    return base.join(over, list(keys), "full_outer").select(
        *keys,
        F.when(present, F.col("_override")).otherwise(F.col("_default")).alias(value),
        F.when(present, "override").otherwise("default").alias("origin"),
    )


def overlay_maps(defaults: Column, overrides: Column) -> Column:
    """The same rule for two map columns; an explicit NULL value still wins."""
    over = F.coalesce(overrides, F.create_map().cast("map<string,string>"))
    base = F.coalesce(defaults, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def known_sections(
    overrides: DataFrame, sections: Sequence[str] = SECTIONS, section_col: str = "section"
) -> DataFrame:
    """Only rows of known sections."""
    return overrides.filter(F.col(section_col).isin(*sections))


def section_type_check(
    df: DataFrame, json_col: str, sections: Sequence[str] = SECTIONS
) -> DataFrame:
    """Add ``bad_section`` (first known section that is no object) and ``code``.

    An absent section is fine; one set to null, a scalar or a list is not, and neither are
    settings that are no object themselves.
    """
    parsed = df.withColumn("_settings", F.try_parse_json(json_col))

    def bad(section: str) -> Column:
        found = F.schema_of_variant(F.variant_get("_settings", f"$.{section}", "variant"))
        return F.when(~found.startswith("OBJECT"), F.lit(section))

    is_object = F.schema_of_variant("_settings").startswith("OBJECT")
    return (
        parsed.withColumn("bad_section", F.coalesce(*[bad(s) for s in sections]))
        .withColumn(
            "code",
            F.when(
                F.col("_settings").isNull() | ~is_object | F.col("bad_section").isNotNull(),
                codes.CONFIG_ERROR,
            ).otherwise(codes.PASSED),
        )
        .drop("_settings")
    )


def settings_lookup(
    df: DataFrame, json_col: str, wanted: Mapping[str, tuple[str, str, Any]]
) -> DataFrame:
    """Add one column per wanted setting ``{name: (path, type, default)}``.

    The default stands in only for an absent path. A null setting stays NULL, and
    so does one of another type.
    """
    parsed = df.withColumn("_settings", F.try_parse_json(json_col))
    columns = {}
    for name, (path, dtype, default) in wanted.items():
        absent = F.variant_get("_settings", path, "variant").isNull()
        columns[name] = F.when(absent, F.lit(default).cast(dtype)).otherwise(
            F.try_variant_get("_settings", path, dtype)
        )
    return parsed.withColumns(columns).drop("_settings")
