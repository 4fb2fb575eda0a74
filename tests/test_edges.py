"""Edge cases that no table holds: nulls, overflow, unfinished writes, maps, types."""

import datetime
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from relgate.functions.codes import GateError
from relgate.operators import clones, diff, gates, overlay, versions
from relgate.sources.publish import publish


def test_bump_overflow_is_the_rows_own_error(spark):
    rows = spark.createDataFrame([("9223372036854775807.0.0",), ("1.2.3",)], "v string")
    found = versions.bump_versions(rows.withColumn("b", F.lit("major")), "v", "b").collect()
    assert sorted((r.code, r.next_version) for r in found) == [(0, "2.0.0"), (109, None)]


@pytest.mark.parametrize("text", ["[1]", "5", "null"])
def test_settings_that_are_no_object(spark, text):
    df = spark.createDataFrame([(text,), ("{}",)], "s string")
    found = {r.s: r.code for r in overlay.section_type_check(df, "s").collect()}
    assert found == {text: 101, "{}": 0}


def test_null_defaults_keep_overrides(spark):
    df = spark.range(1).select(F.expr("map('k', 'v')").alias("o"), F.expr("cast(null as map<string,string>)").alias("d"))
    assert df.select(overlay.overlay_maps(F.col("d"), F.col("o"))).first()[0] == {"k": "v"}


def test_bands_of_fractions_and_zero(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.5,), (None,)], "m double")
    assert [r[0] for r in df.select(gates.band_of(F.col("m"))).collect()] == ["A", "A", "B", None]
    assert gates.band_filter(df, "m", "A").count() == 3


def test_map_columns_are_compared(spark):
    old = spark.sql("SELECT 1 AS k, map('a', 1, 'b', 2) AS m UNION ALL SELECT 2, map('a', 1)")
    new = spark.sql("SELECT 1 AS k, map('b', 2, 'a', 1) AS m UNION ALL SELECT 2, map('a', 2)")
    assert {r.k: r.op for r in diff.snapshot_diff(old, new, ["k"]).collect()} == {1: "same", 2: "modified"}


def test_unfinished_version_is_not_returned(spark, tmp_path):
    rows = spark.range(2)
    publish(rows.limit(1), str(tmp_path), "d", "1.0.0")
    os.remove(tmp_path / "d" / "version=1.0.0" / "_SUCCESS")
    with pytest.raises(GateError) as error:
        publish(rows, str(tmp_path), "d", "1.0.0", skip_existing=True)
    assert error.value.code == 106


ORDERS = {
    "bigint": lambda i: i,
    "double": lambda i: i / 100,
    "float": lambda i: float(i),
    "decimal(30,2)": lambda i: Decimal(10) ** 20 + i,
    "date": lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i),
    "timestamp": lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i),
}


@pytest.mark.parametrize("kind", ORDERS)
def test_ledger_is_the_same_at_every_size(spark, kind):
    bumps = ["patch", "minor", "none", "patch", "major", "minor", "patch"]
    rows = [("e", None if i == 0 else ORDERS[kind](i), bumps[(i * i) % 7], i) for i in range(41)]
    df = spark.createDataFrame(rows, f"e string, at {kind}, bump string, i int")
    ledgers = [
        {r.i: r.version for r in versions.version_ledger(df, "e", "at", "bump", chunk_rows=n).collect()}
        for n in (1, 5, 10**9)
    ]
    assert ledgers[0] == ledgers[2] and ledgers[1] == ledgers[2] and len(ledgers[2]) == 41


@pytest.mark.parametrize("chunk_rows", [1, 10**9])
def test_ledger_refuses_text_orders(spark, chunk_rows):
    df = spark.createDataFrame([("e", "x", "major")], "e string, at string, bump string")
    with pytest.raises(TypeError):
        versions.version_ledger(df, "e", "at", "bump", chunk_rows=chunk_rows)


def test_scorer_batches_are_halved_to_the_rows_at_fault(spark):
    def scorer(texts):
        if (texts == "bad").any():
            raise ValueError("no score")
        good = texts[texts != "lost"]
        return good.map(lambda t: '{"title": "%s", "description": "d", "bump_type": "patch"}' % t)

    rows = [(i, "bad" if i == 7 else "lost" if i == 20 else f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    found = {r.id: r for r in diff.score_changes(df, ["id"], "t", scorer).collect()}
    assert {i for i, r in found.items() if r.code} == {7, 20}
    assert found[7].error == "ValueError: no score"
    assert found[20].error == "ValueError: 0 answers to 1 texts"
    assert found[3].error is None and found[3].title == "t3"


def test_digests_tell_null_empty_and_long_texts_apart(spark):
    values = [None, "", "a" * 15, "a" * 16, "b" * 40]
    pairs = [(i * 10 + j, x, y) for i, x in enumerate(values) for j, y in enumerate(values)]
    df = spark.createDataFrame(pairs, "k int, x string, y string")
    found = diff.snapshot_diff(df.selectExpr("k", "x AS v"), df.selectExpr("k", "y AS v"), ["k"])
    assert {r.k for r in found.collect() if r.op == "same"} == {0, 11, 22, 33, 44}


def test_drop_clones_keeps_rows_without_text_or_id(spark):
    rows = [(3, "a"), (1, "a"), (None, "a"), (4, None), (5, None), (6, ""), (7, ""), (8, "b")]
    df = spark.createDataFrame(rows, "id int, t string")
    for hot_min in (1, 10**9):
        kept = clones.drop_clones(df, "id", "t", hot_min).collect()
        assert sorted((r.id for r in kept), key=str) == [1, 4, 5, 6, 8, None]
        assert clones.exact_clones(spark.createDataFrame(kept, df.schema), "id", "t").filter("id IS NOT NULL AND id <> group_id").isEmpty()
    assert clones.drop_clones(df.filter("false"), "id", "t").isEmpty()
