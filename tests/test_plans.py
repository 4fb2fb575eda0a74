"""What the plans must and must not hold, whatever the data size."""

import re

import pytest
from compare import DATA
from pyspark.sql import functions as F

from relgate.operators import clones, diff, gates, unused, versions
from relgate.plans.queries import QUERIES
from relgate.sources.datasets import read_dataset

SF_DIR = f"{DATA}/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_no_single_task_window_no_row_python(spark, name):
    plan = plan_of(QUERIES[name][0](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan
    if name != "d10_score_changes":
        assert "MapInPandas" not in plan
    for spec in re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan):
        # Columns before the first ordering are the partitioning.
        assert not re.match(r"^\S+ (ASC|DESC)", spec)
    # A limit is used only for the bounded list of heavy keys.
    assert "CollectLimit" not in plan and "GlobalLimit" not in plan


def test_scans_are_pruned_and_filters_pushed(spark):
    lineitem = read_dataset(spark, SF_DIR, "lineitem.parquet")
    quantities = lineitem.select("l_orderkey", "l_quantity")
    plan = plan_of(gates.band_filter(quantities, "l_quantity", "D"))
    assert "GreaterThan(l_quantity,20.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    documents = read_dataset(spark, SF_DIR, "documents.parquet")
    plan = plan_of(gates.exclude(documents.select("doc_id", "source"), "source", ["src1*"]))
    assert "Not(StringStartsWith(source,src1))" in plan


def test_ledger_takes_one_shuffle(spark):
    events = read_dataset(spark, SF_DIR, "events.parquet").select(
        "event_id", "user_id", F.lit("patch").alias("bump")
    )
    plan = plan_of(versions.version_ledger(events, "user_id", "event_id", "bump"))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_snapshot_diff_shuffles_both_sides_in_one_exchange(spark):
    orders = read_dataset(spark, SF_DIR, "orders.parquet")
    plan = plan_of(diff.snapshot_diff(orders, orders, ["o_orderkey"], ["o_orderstatus"]))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert plan.count("ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>") == 2


def test_a_release_compares_and_finds_repeats_in_one_exchange(spark, tmp_path):
    orders = read_dataset(spark, SF_DIR, "orders.parquet")
    # Every type of the table is kept in a hash table: nothing is sorted before the shuffle.
    plan = plan_of(diff.keyed_diff(orders, orders, ["o_orderkey"]))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Sort" not in plan and plan.count("HashAggregate") == 2


@pytest.mark.parametrize("hot_min", [100_000, 2])
@pytest.mark.parametrize("find", [clones.exact_clones, clones.window_clones])
def test_clones_read_rows_once_and_count_once(spark, find, hot_min):
    documents = read_dataset(spark, SF_DIR, "documents.parquet")
    found = find(documents, "doc_id", "text", hot_min=hot_min)
    found.collect()
    final = plan_of(found).split("Initial Plan")[0]
    # Without heavy keys the list is dropped, and only the reuse of its counts is left to see.
    assert final.count("FileScan") == (2 if hot_min == 2 else 1) and "ReusedExchange" in final


@pytest.mark.parametrize("limit", [0, 10**9])
def test_unreferenced_terms_leave_their_task_only_if_defined(spark, limit):
    defs = read_dataset(spark, SF_DIR, "benchmark.parquet").select("text")
    refs = read_dataset(spark, SF_DIR, "documents.parquet").select("text")
    found = unused.unreferenced_terms(defs, "text", refs, "text", broadcast_bytes=limit)
    assert ("LeftSemi" in plan_of(found)) == (limit > 0)
    assert sorted(found.collect()) == sorted(unused.unreferenced_terms(defs, "text", refs, "text").collect())


def test_total_lines_come_from_the_window_counts(spark):
    documents = read_dataset(spark, SF_DIR, "documents.parquet")
    found = clones.duplication(documents, "doc_id", "text")
    found.collect()
    subquery = plan_of(found).split("Subquery")[1].split("Initial Plan")[0]
    assert "ReusedExchange" in subquery and "FileScan" not in subquery
