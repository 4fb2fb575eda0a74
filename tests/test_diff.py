import datetime as dt
import json
import random
from collections import Counter
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from relgate.operators import diff as d


def test_first_non_empty_source(spark):
    schema = "k string, v int"
    empty = spark.createDataFrame([], schema)
    a = spark.createDataFrame([("x", 1), ("x", 1)], schema)
    b = spark.createDataFrame([("x", 2), ("y", 3)], schema)
    changes = d.union_changes([("staged", empty), ("unstaged", a), ("unpushed", b)])
    assert [r.source for r in d.first_non_empty(changes).collect()] == ["unstaged"] * 2
    both = d.union_changes([("staged", a, 0), ("unstaged", b, 0), ("unpushed", b, 1)])
    assert d.first_non_empty(both).count() == 4
    assert d.first_non_empty(d.union_changes([("staged", empty)])).isEmpty()


@pytest.mark.parametrize("hot_min", [100_000, 2])
def test_first_non_empty_per_group(spark, hot_min):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b", "c", None]), rng.randint(0, 2)) for _ in range(60)]
    rows += [("late", 2)] * 3
    df = spark.createDataFrame(rows, "k string, priority int")
    first = {}
    for k, p in rows:
        first[k] = min(p, first.get(k, p))
    expected = Counter((k, p) for k, p in rows if p == first[k])
    found = d.first_non_empty(df, ["k"], hot_min).collect()
    assert Counter(map(tuple, found)) == expected
    both = d.first_non_empty(df.withColumn("one", F.lit(1)), ["one", "k"], hot_min)
    assert Counter(map(tuple, both.drop("one").collect())) == expected


def test_snapshot_diff_applied_to_old_gives_new(spark):
    rng = random.Random(5)
    old = {i: (rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for i in range(0, 60)}
    new = {i: (rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for i in range(20, 80)}
    schema = "k int, x string, y int"
    old_df = spark.createDataFrame([(k, *v) for k, v in old.items()], schema)
    new_df = spark.createDataFrame([(k, *v) for k, v in new.items()], schema)
    found = {r.k: r for r in d.snapshot_diff(old_df, new_df, ["k"], carry=["x"]).collect()}
    assert set(found) == set(old) | set(new)
    for k, row in found.items():
        if k not in old:
            assert (row.op, row.changed_cols, row.x) == ("added", [], new[k][0])
        elif k not in new:
            assert (row.op, row.changed_cols, row.x) == ("removed", [], old[k][0])
        else:
            changed = [c for c, o, n in zip("xy", old[k], new[k]) if o != n]
            assert (row.op, row.changed_cols, row.x) == (
                "modified" if changed else "same",
                changed,
                new[k][0],
            )


def test_long_texts_can_be_compared_by_digest(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "x")], "k int, t string")
    new = spark.createDataFrame([(1, "b"), (2, ""), (3, ""), (4, None)], "k int, t string")
    plain = d.snapshot_diff(old, new, ["k"], carry=["t"])
    digested = d.snapshot_diff(old, new, ["k"], carry=["t"], by_digest=["t"])
    assert sorted(plain.collect()) == sorted(digested.collect())
    assert {r.k: r.op for r in digested.collect()} == {
        1: "modified",
        2: "modified",
        3: "same",
        4: "modified",
    }


def test_keyed_diff_counts_the_rows_of_each_key(spark):
    schema = "k int, d double, t timestamp_ntz, n decimal(20,2), a array<string>, m map<string,int>, s string"
    at = dt.datetime(2024, 1, 1)
    row = (1.5, at, Decimal("1.25"), ["x", None], {"a": 1}, "long enough to be digested")
    old = spark.createDataFrame([(1, *row), (2, *row), (2, *row), (None, *row), (4, *row), (5, *[None] * 6), (6, *row)], schema)
    new = [(1, *row), (2, *row), (3, *row), (3, *row), (4, 1.5, at, Decimal("1.26"), ["x"], {"b": 1}, "another"), (5, *[None] * 6)]
    new.append((6, *[None] * 6))
    found = {r.k: r for r in d.keyed_diff(old, spark.createDataFrame(new, schema), ["k"], carry=["s"]).collect()}
    assert {k: (r.old_rows, r.new_rows, r.op) for k, r in found.items()} == {
        1: (1, 1, "same"), 2: (2, 1, "same"), 3: (0, 2, "added"), None: (1, 0, "removed"), 4: (1, 1, "modified"),
        5: (1, 1, "same"), 6: (1, 1, "modified"),
    }
    assert found[4].changed_cols == ["n", "a", "m", "s"] and found[6].changed_cols == ["d", "t", "n", "a", "m", "s"]
    assert found[4].s == "another" and found[None].s == row[-1] and found[6].s is None


def test_duplicate_keys_are_found(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 1), (None, 1)], "a int, b int")
    found = {(r.a, r.b): r.n_rows for r in d.duplicate_keys(df, ["a", "b"]).collect()}
    assert found == {(1, 1): 2, (None, 1): 1}


def test_line_diff_is_a_bag_difference(spark):
    old = {1: "a\na\nb", 2: "x", 3: "same\nsame", 4: "gone"}
    new = {1: "a\nb\nb\nc", 2: "x", 3: "same", 5: "\n"}
    old_df = spark.createDataFrame(list(old.items()), "id int, t string")
    new_df = spark.createDataFrame(list(new.items()), "id int, t string")
    expected = {}
    for key in set(old) | set(new):
        before = Counter(old[key].split("\n")) if key in old else Counter()
        after = Counter(new[key].split("\n")) if key in new else Counter()
        added, removed = (after - before).total(), (before - after).total()
        if added or removed:
            expected[key] = (added, removed)
    found = d.line_diff(old_df, new_df, "id", "t")
    assert {r.id: (r.added, r.removed) for r in found.collect()} == expected


def test_field_drift_operations(spark):
    old = ['{"a": 1, "b": "x", "c": true}', '{"a": 2.5, "c": null}', "[1, 2]", "7", "{"]
    new = ['{"a": 1, "b": {"z": 1}, "d": [1]}', None]
    old_df = spark.createDataFrame([(t,) for t in old], "j string")
    new_df = spark.createDataFrame([(t,) for t in new], "j string")
    found = {
        (r.field, r.old_type, r.new_type): (r.old_n, r.new_n, r.op)
        for r in d.field_drift(old_df, new_df, "j").collect()
    }
    assert found == {
        ("a", "int", "int"): (1, 1, "same"),
        ("a", "double", None): (1, 0, "retyped"),
        ("b", "string", None): (1, 0, "retyped"),
        ("b", None, "object"): (0, 1, "retyped"),
        ("c", "boolean", None): (1, 0, "removed"),
        ("c", "null", None): (1, 0, "removed"),
        ("d", None, "array"): (0, 1, "added"),
    }


def test_schema_drift(spark):
    old = spark.createDataFrame([(1, "1", 1)], "k int, a string, b int")
    new = spark.createDataFrame([(1, 1, 2.0)], "k int, a int, c double")
    assert sorted(map(tuple, d.schema_drift(old, new).collect())) == [
        ("a", "string", "int", "retyped"),
        ("b", "int", None, "removed"),
        ("c", None, "double", "added"),
    ]
    assert d.schema_drift(old, old).isEmpty()
    # A retyped column is left to the schema comparison.
    assert d.snapshot_diff(old, new, ["k"]).first().op == "same"


def test_change_records_need_three_strings(spark):
    full = {"title": "feat: x", "description": "d", "bump_type": "minor"}
    cases = [
        (json.dumps(full), 0),
        (json.dumps({**full, "extra": 1}), 0),
        (json.dumps({**full, "title": 1}), 103),
        (json.dumps({**full, "description": None}), 103),
        (json.dumps({k: v for k, v in full.items() if k != "bump_type"}), 103),
        ('{"title": ', 103),
        ('["title"]', 103),
        (None, 103),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, j string")
    for row in d.parse_change_record(df, "j").collect():
        code = cases[row.i][1]
        assert row.code == code
        assert (row.title, row.description, row.bump_type) == (
            tuple(full.values()) if code == 0 else (None, None, None)
        )


def test_titles(spark):
    cases = {
        "feat: add": ("feat", None, False, "minor"),
        "fix(core): x": ("fix", "core", False, "patch"),
        "chore(x)!: y": ("chore", "x", True, "major"),
        "docs: BREAKING CHANGE here": ("docs", None, True, "major"),
        "Feat: add": (None, None, None, None),
        "feat:add": (None, None, None, None),
        "no type": (None, None, None, None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "title string")
    found = {
        r.title: (r.type, r.scope, r.breaking, r.bump_type)
        for r in d.classify_title(df, "title").collect()
    }
    assert found == cases


@pytest.mark.parametrize(
    "ops, drift_ops, bump",
    [
        (["same"], [], None),
        (["modified"], [], "patch"),
        (["modified", "added"], [], "minor"),
        (["removed", "added"], [], "major"),
        (["modified"], ["added"], "minor"),
        (["same"], ["retyped"], "major"),
        ([], ["same"], None),
    ],
)
def test_bump_from_changes(spark, ops, drift_ops, bump):
    changes = spark.createDataFrame([(o,) for o in ops], "op string")
    drift = spark.createDataFrame([(o,) for o in drift_ops], "op string")
    row = d.infer_bump(changes, drift).first()
    assert (row.bump_type, row.code) == (bump, 0 if bump else 107)
    if not drift_ops:
        assert d.infer_bump(changes).first() == row


def test_summary_titles_carry_the_bump(spark):
    rows = [
        ("p", "added", []),
        ("p", "modified", ["x", "y"]),
        ("p", "modified", ["x"]),
        ("q", "modified", ["y"]),
        ("r", "removed", []),
        ("s", "same", []),
    ]
    df = spark.createDataFrame(rows, "k string, op string, changed_cols array<string>")
    summary = d.change_summary(df, "k")
    found = {r.k: (r.title, r.description) for r in summary.collect()}
    assert found == {
        "p": ("feat(p): 1 added, 0 removed, 2 modified", "changed columns: x (2), y (1)"),
        "q": ("fix(q): 0 added, 0 removed, 1 modified", "changed columns: y (1)"),
        "r": ("feat(r)!: 0 added, 1 removed, 0 modified", "changed columns: none"),
    }
    bumps = {r.k: r.bump_type for r in d.classify_title(summary, "title").collect()}
    assert bumps == {"p": "minor", "q": "patch", "r": "major"}


def test_scorer_failures_cost_only_their_own_rows(spark):
    def scorer(texts: pd.Series) -> pd.Series:
        if (texts == "boom").any():
            raise ValueError("cannot score")
        return texts.map(
            lambda t: json.dumps({"title": t, "description": "d", "bump_type": "patch"})
        )

    rows = [(i, "boom" if i % 10 == 3 else f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    found = d.score_changes(df, ["i"], "t", scorer)
    assert found.columns == ["i", "title", "description", "bump_type", "code", "error"]
    assert {r.i: (r.title, r.code) for r in found.collect()} == {
        i: (None, 103) if t == "boom" else (t, 0) for i, t in rows
    }
    assert found.filter(F.col("code") == 0).count() == 45
