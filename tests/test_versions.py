"""Version operators against a plain fold."""

import random

import pytest

from relgate.operators import versions as s


def bump(version, kind):
    major, minor, patch = map(int, version.split("."))
    return {
        "major": f"{major + 1}.0.0",
        "minor": f"{major}.{minor + 1}.0",
        "patch": f"{major}.{minor}.{patch + 1}",
    }.get(kind, version)


def test_versions_are_parsed_strictly(spark):
    good = {"1.2.3": (1, 2, 3), "0.0.0": (0, 0, 0), "01.2.10": (1, 2, 10)}
    bad = ["1.2", "1.2.3.4", "v1.2.3", "1.2.3\n", "", " 1.2.3", "1.-2.3", "1.2.٣", None]
    bad.append("9" * 30 + ".1.1")
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "v string")
    parsed = s.parse_versions(df, "v").collect()
    found = {r.v: ((r.major, r.minor, r.patch), r.code) for r in parsed}
    assert {v: found[v] for v in good} == {v: (parts, 0) for v, parts in good.items()}
    assert {found[v][1] for v in bad} == {109}


def test_bumps(spark):
    rows = [("1.2.3", "major"), ("1.2.3", "minor"), ("1.2.3", "patch"), ("1.2.3", "Major")]
    rows += [("1.2.3", ""), ("1.2.3", None), ("1.2", "patch")]
    df = spark.createDataFrame(rows, "v string, b string")
    found = [(r.next_version, r.code) for r in s.bump_versions(df, "v", "b").collect()]
    assert found[:3] == [("2.0.0", 0), ("1.3.0", 0), ("1.2.4", 0)]
    assert found[3:] == [(None, 109)] * 4


@pytest.mark.parametrize(
    "start, chunk_rows, order_type",
    [
        ("0.1.0", 100_000, "bigint"),
        ("0.1.0", 150, "bigint"),
        ("0.0.0", 40, "bigint"),
        ("3.2.1", 40, "timestamp_ntz"),
        ("3.2.1", 1, "bigint"),
        ("0.1.0", 100_000, "timestamp_ntz"),
        ("2.0.1", 3, "bigint"),
    ],
)
def test_ledger_equals_a_fold(spark, monkeypatch, start, chunk_rows, order_type):
    # So small that both classes of heavy entities occur.
    monkeypatch.setattr(s, "TOP_ENTITIES", 2)
    monkeypatch.setattr(s, "OTHER_CHUNKS", 5)
    rng = random.Random(11)
    kinds = ["major", "minor", "patch", "patch", "patch", None, "other"]
    rows = []
    for i in range(600):
        entity = rng.choice(["hot", "hot", "a", "b", None])
        # The heavy entity has long stretches without a major or minor.
        kind = "patch" if entity == "hot" and i % 200 > 60 else rng.choice(kinds)
        rows.append((i, entity, kind))
    current, expected = {}, {}
    for i, entity, kind in rows:
        current[entity] = bump(current.get(entity, start), kind)
        expected[i] = current[entity]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i bigint, e string, b string")
    if order_type != "bigint":
        df = df.selectExpr("i", "e", "b", "cast(timestamp_seconds(i * 3600) as timestamp_ntz) as at")
    order = "i" if order_type == "bigint" else "at"
    found = s.version_ledger(df, "e", order, "b", start, chunk_rows)
    assert {r.i: r.version for r in found.collect()} == expected
    assert found.count() == len(rows)


def test_ledger_over_a_clock_change(spark):
    rows = [(i, "e", "minor" if i % 7 == 0 else "patch") for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, e string, b string")
    clock = spark.conf.get("spark.sql.session.timeZone")
    at = "timestamp_ntz'2024-03-10 00:00:00' + make_dt_interval(0, 0, cast(i AS int) * 3)"
    timed = df.selectExpr("*", f"{at} AS at").withColumnRenamed("i", "n")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        found = s.version_ledger(timed, "e", "at", "b", "0.1.0", 10)
        versions = {r.n: r.version for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", clock)
    current = "0.1.0"
    for i, _, kind in rows:
        current = bump(current, kind)
        assert versions[i] == current


def test_latest_is_numeric_and_ignores_what_is_no_version(spark):
    rows = [("a", "1.9.0"), ("a", "1.10.0"), ("a", "x"), ("b", "0.0.9"), ("c", "bad"), ("a", "1.2.99")]
    rows.append(("b", f"9.{'9' * 30}.1"))
    df = spark.createDataFrame(rows, "e string, v string")
    found = dict(s.latest_version(df, ["e"], "v").collect())
    assert found == {"a": "1.10.0", "b": "0.0.9"}
