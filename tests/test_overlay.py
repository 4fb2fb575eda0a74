import json

from pyspark.sql import functions as F

from relgate.functions.settings import DEFAULT_SETTINGS
from relgate.operators import overlay as c


def test_override_wins_even_with_null_and_new_keys_stay(spark):
    entities = spark.createDataFrame([("p",), ("q",)], "entity string")
    defaults = c.default_rows(entities)
    rows = [
        ("p", "ai", "model", None),
        ("p", "quality", "max_complexity", "20"),
        ("p", "quality", "extra", "1"),
        ("r", "ai", "model", "m"),
    ]
    schema = "entity string, section string, key string, value string"
    overrides = spark.createDataFrame(rows, schema)
    merged = c.overlay(defaults, overrides, ["entity", "section", "key"])
    found = {(r.entity, r.section, r.key): (r.value, r.origin) for r in merged.collect()}
    expected = {
        (e, section, key): (value, "default")
        for e in "pq"
        for section, keys in DEFAULT_SETTINGS.items()
        for key, value in keys.items()
    }
    expected.update({(e, s, k): (v, "override") for e, s, k, v in rows})
    assert found == expected


def test_overlay_of_maps(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS d, map('b', NULL, 'c', '3') AS o")
    merged = df.select(c.overlay_maps(F.col("d"), F.col("o"))).first()[0]
    assert merged == {"a": "1", "b": None, "c": "3"}
    none = F.lit(None).cast("map<string,string>")
    assert df.select(c.overlay_maps(F.col("d"), none)).first()[0] == {"a": "1", "b": "2"}


def test_unknown_sections_are_dropped(spark):
    df = spark.createDataFrame([("quality",), ("tool",), (None,)], "section string")
    assert [r.section for r in c.known_sections(df).collect()] == ["quality"]


def test_section_types(spark):
    cases = {
        '{"project": {}, "tool": 1}': (None, 0),
        '{"quality": 1, "project": []}': ("project", 101),
        '{"ai": null}': ("ai", 101),
        "{}": (None, 0),
        "{": (None, 101),
    }
    df = spark.createDataFrame([(t,) for t in cases], "json string")
    found = {r.json: (r.bad_section, r.code) for r in c.section_type_check(df, "json").collect()}
    assert found == cases


def test_lookup_defaults_only_for_absent_paths(spark):
    cases = {
        json.dumps({"quality": {"max_complexity": 20}}): (20, 1.0),
        json.dumps({"quality": {"max_complexity": None, "max_duplicates": 2.5}}): (None, 2.5),
        json.dumps({"quality": {"max_complexity": {"a": 1}}}): (None, 1.0),
        json.dumps({"other": 1}): (15, 1.0),
    }
    df = spark.createDataFrame([(t,) for t in cases], "json string")
    wanted = {
        "complexity": ("$.quality.max_complexity", "int", 15),
        "duplicates": ("$.quality.max_duplicates", "double", 1.0),
    }
    found = c.settings_lookup(df, "json", wanted).collect()
    assert {r.json: (r.complexity, r.duplicates) for r in found} == cases
