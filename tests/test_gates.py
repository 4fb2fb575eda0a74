import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from relgate.operators import gates as g
from relgate.operators import unused
from relgate.sources.datasets import parse_report, to_lines


def test_limit_is_strict(spark):
    df = spark.createDataFrame([("a", 15), ("b", 16), ("c", None)], "name string, metric int")
    assert [r.name for r in g.threshold_violations(df, "metric", 15).collect()] == ["b"]


@pytest.mark.parametrize("measured, failed", [(1.0, False), (1.01, True), (None, True)])
def test_gate_fails_above_the_limit_or_unmeasured(spark, measured, failed):
    df = spark.createDataFrame([(measured,)], "pct double")
    row = g.gate_result(df, 2, "duplication", "pct", 1.0).first()
    assert (row.failed, row.code) == (failed, 102 if failed else 0)


def test_summary_skips_what_follows_the_first_failure(spark):
    def gate(number, value):
        df = spark.createDataFrame([(value,)], "m double")
        return g.gate_result(df, number, f"g{number}", "m", 1.0)

    rows = g.gate_summary([gate(1, 0.5), gate(2, None), gate(3, 0.1), gate(4, 9.0)]).collect()
    assert {r.ord: r.status for r in rows} == {
        1: "passed",
        2: "unmeasured",
        3: "skipped",
        4: "skipped",
    }
    rows = g.gate_summary([gate(1, 0.5), gate(2, 1.0)]).collect()
    assert {r.status for r in rows} == {"passed"}


def test_band_boundaries(spark):
    edges = [1, 5, 6, 10, 11, 20, 21, 30, 31, 40, 41, 500]
    df = spark.createDataFrame([(m,) for m in edges], "m int")
    banded = {r.m: r.band for r in g.band_filter(df, "m", "A").collect()}
    assert "".join(banded[m] for m in edges) == "AABBCCDDEEFF"
    assert sorted(r.m for r in g.band_filter(df, "m", "C").collect()) == edges[4:]


def test_nested_report_is_flattened(spark):
    report = '{"b.py": [{"name": "f", "complexity": 3, "rank": "A"}], "a.py": []}'
    df = spark.createDataFrame([(report,), ("{",)], "json string")
    rows = g.flatten_report(parse_report(df, "json"), "report").collect()
    assert [tuple(r) for r in rows] == [("b.py", 0, "f", 3)]


def test_first_violation_per_group_and_overall(spark):
    rows = [("x", 3, 20), ("x", 1, 30), ("y", 2, 40)]
    df = spark.createDataFrame(rows, "grp string, pos int, metric int")
    assert tuple(g.first_violation(df, ["pos"]).first()) == ("x", 1, 30)
    found = g.first_violation(df, ["pos"], ["grp"])
    assert sorted(map(tuple, found.collect())) == [("x", 1, 30), ("y", 2, 40)]
    assert g.first_violation(df.filter("metric > 99"), ["pos"]).isEmpty()


def test_token_score_matches_whole_tokens(spark):
    text = "If x and if y: AND for(z) for\tfor\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "band for")], "id int, t string")
    scores = dict(g.token_score(df, "t", ["and", "for", "if"]).select("id", "score").collect())
    expected = {
        i: 1 + sum(w in ("and", "for", "if") for w in re.split(r"\s+", t.lower()))
        for i, t in [(1, text), (2, ""), (3, "band for")]
    }
    assert scores == expected


def test_scrape_takes_the_first_matching_line(spark):
    out = "intro 9%\nFormat | Clones Found: 5 (12.5%) of\nclones found 99%"
    bad = "clones found many%"
    df = spark.createDataFrame([(1, out), (2, bad), (3, "nothing")], "id int, t string")
    lines = to_lines(df, "id", "t")
    found = g.scrape_metric(lines, "id", ["%", "clones found"], r"([^%\s(]+)\s*%")
    assert sorted(map(tuple, found.collect())) == [
        (1, 1, 12.5, "measured"),
        (2, 0, None, "unmeasured"),
        (3, None, None, "unmeasured"),
    ]


def test_exclude_follows_glob_rules(spark):
    names = [".venv/a.py", "src/.venv/b", "x.py", "x_py", "a+b", "aab", "x\n.py", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for globs in ([".venv/*"], ["*.py"], ["x?py"], ["a+b"], ["*"], [".venv/*", "a*"]):
        kept = [r.name for r in g.exclude(df, "name", globs).collect()]
        expected = [
            n for n in names if n is None or not any(fnmatch.fnmatchcase(n, p) for p in globs)
        ]
        assert kept == expected, globs


def test_average_of_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 12)], "k string, m int")
    found = g.metric_average(df, "m", ["k"]).collect()
    assert sorted(map(tuple, found)) == [("a", 5, 3, 1.666667, "A"), ("b", 12, 1, 12.0, "C")]


def test_unreferenced_keys_with_several_reference_frames(spark):
    defs = spark.range(6).withColumnRenamed("id", "k")
    first = spark.createDataFrame([(0,), (0,), (None,)], "a long")
    second = spark.createDataFrame([(3,), (9,)], "b long")
    found = unused.unreferenced_keys(defs, [(first, ["a"]), (second, ["b"])], ["k"])
    assert sorted(r.k for r in found.collect()) == [1, 2, 4, 5]


def test_unreferenced_terms(spark):
    defs = spark.createDataFrame([("Foo bar  baz",), ("foo qux ",)], "t string")
    refs = spark.createDataFrame([("bar\tBAZ",), ("other",)], "u string")
    found = unused.unreferenced_terms(defs, "t", refs, "u")
    assert sorted(r.term for r in found.collect()) == ["foo", "qux"]


def test_lines_keep_empty_ones(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n"), (2, "")], "id int, t string")
    lines = to_lines(df, "id", "t").collect()
    assert sorted((r.id, r.line_no, r.line) for r in lines) == [
        (1, 0, "a"),
        (1, 1, ""),
        (1, 2, "b"),
        (1, 3, ""),
        (2, 0, ""),
    ]
    assert to_lines(df, "id", "t").agg(F.max("line_no")).first()[0] == 3
