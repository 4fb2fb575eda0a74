from pyspark.sql import functions as F

from relgate.functions import codes
from relgate.operators import validate as v


def test_length_boundary_counts_code_points(spark):
    rows = [(1, "x" * 49), (2, "x" * 50), (3, "é😀" * 25), (4, "é" * 49), (5, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    assert sorted(r.id for r in v.min_length(df, "text").collect()) == [1, 4, 5]


def test_section_markers_are_literal_case_sensitive_and_unanchored(spark):
    rows = [
        (1, "## Installation\n## Usage"),
        (2, "### Installation and ### Usage"),
        (3, "## installation\n## Usage"),
        (4, "## Installation"),
        (5, "none"),
        (6, None),
    ]
    df = spark.createDataFrame(rows, "id int, text string")
    found = v.required_sections(df, "text", ["Installation", "Usage"], prefix="## ")
    assert dict(found.select("id", "missing_section").collect()) == {
        1: None,
        2: None,
        3: "Installation",
        4: "Usage",
        5: "Installation",
        6: "Installation",
    }


def test_required_fields_report_the_first_in_order_and_count_nulls_as_present(spark):
    rows = [
        (1, '{"project": {"readme": "r", "description": "d", "version": "1", "name": "n"}}'),
        (2, '{"project": {"name": "n", "readme": "r"}}'),
        (3, '{"project": {"name": null, "version": 1, "description": "", "readme": {}}}'),
        (4, '{"tool": {}}'),
        (5, '{"project": [1]}'),
        (6, None),
    ]
    df = spark.createDataFrame(rows, "id int, json string")
    found = v.required_fields(df, "json", ["name", "version", "description", "readme"], "project")
    assert dict(found.select("id", "missing_field").collect()) == {
        1: None,
        2: "version",
        3: None,
        4: "name",
        5: "name",
        6: "name",
    }


def test_malformed_and_absent_records_differ(spark):
    rows = [(1, '{"a": 1}'), (2, '{"a"'), (3, None), (4, "null"), (5, "")]
    df = spark.createDataFrame(rows, "id int, json string")
    found = v.split_malformed(df, "json").select("id", "is_valid", "code")
    assert sorted(map(tuple, found.collect())) == [
        (1, True, 0),
        (2, False, 112),
        (3, False, 111),
        (4, True, 0),
        (5, False, 112),
    ]


def test_verdict_stops_at_the_first_failing_check(spark):
    rows = [(1, "short"), (2, "y" * 60), (3, "## A" + "y" * 60)]
    df = spark.createDataFrame(rows, "id int, t string")
    verdicts = v.verdict(df, ["id"], v.text_checks("t", 50, ["A"], "## "))
    assert sorted(map(tuple, verdicts.collect())) == [
        (1, 114, "text is shorter than 50 characters"),
        (2, 114, "missing section: A"),
        (3, 0, None),
    ]


def test_missing_entities_with_one_hot_key(spark):
    expected = spark.range(100).withColumnRenamed("id", "k")
    key = F.when(F.col("id") < 20_000, 7).otherwise(F.col("id") % 90)
    actual = spark.range(30_000).select(key.alias("k"))
    found = v.missing_entities(expected, actual, ["k"])
    assert sorted(r.k for r in found.collect()) == list(range(90, 100))
    assert {r.code for r in found.collect()} == {codes.MISSING_RECORD}


def test_report_names_every_code(spark):
    rows = [(c,) for c in [0, *codes.CODES.values()]]
    report = v.validation_report(spark.createDataFrame(rows, "code int"))
    names = {r.code: r.code_name for r in report.collect()}
    assert names == {0: "PASSED", **{code: name for name, code in codes.CODES.items()}}
