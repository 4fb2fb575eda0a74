"""Known counts on the sf0.01 tables."""

from collections import Counter

from compare import DATA
from pyspark.sql import functions as F

from relgate.operators import diff
from relgate.plans import queries as q

SF_DIR = f"{DATA}/sf0.01"


def counts(df, *columns):
    rows = df.select(*columns).collect()
    return Counter(tuple(row) if len(columns) > 1 else row[0] for row in rows)


def test_validation_counts(spark):
    assert q.to_lines_query(spark, SF_DIR).count() == 9344
    assert q.missing_entities_query(spark, SF_DIR).count() == 257
    assert counts(q.split_malformed_query(spark, SF_DIR), "code")[112] == 104
    missing = counts(q.required_fields_query(spark, SF_DIR), "missing_field")
    assert missing == {"version": 215, "description": 257, None: 1028}
    messages = counts(q.verdict_query(spark, SF_DIR), "message")
    assert messages == {
        "text is shorter than 50 characters": 12,
        "missing section: . ": 74,
        None: 914,
    }


def test_gate_counts(spark):
    assert dict(q.band_counts_query(spark, SF_DIR).collect()) == {"A": 11523, "B": 3178, "C": 42}
    assert q.threshold_violations_query(spark, SF_DIR).count() == 42
    groups = q.exact_clones_query(spark, SF_DIR)
    assert (groups.select("group_id").distinct().count(), groups.count()) == (62, 135)
    covered = q.window_clones_query(spark, SF_DIR)
    assert (covered.count(), covered.select("doc_id").distinct().count()) == (1222, 84)
    gate = q.duplication_gate_query(spark, SF_DIR).first()
    assert (gate.dup_lines, gate.total_lines, round(gate.pct, 2), gate.failed) == (
        1222,
        9344,
        13.08,
        True,
    )
    values = counts(q.scrape_metric_query(spark, SF_DIR), "value")
    assert (values[2.0], values[3.0]) == (16, 9)
    assert q.unreferenced_keys_query(spark, SF_DIR).count() == 257
    assert q.unreferenced_terms_query(spark, SF_DIR).count() == 141


def test_settings_counts(spark):
    labels = q.overlay_query(spark, SF_DIR).groupBy("doc_id").pivot("key", ["quality", "toxic"])
    found = counts(labels.agg({"value": "max"}), "quality", "toxic")
    assert found == {("0", "0"): 49, ("0", "1"): 9, ("1", "0"): 900, ("1", "1"): 42}


def test_change_counts(spark):
    orders = q.table(spark, SF_DIR, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    turn = F.col("o_orderkey") % 10
    status = F.when(turn == 2, "X").otherwise(F.col("o_orderstatus"))
    old = orders.filter(turn != 0)
    new = orders.filter(turn != 1).withColumn("o_orderstatus", status)
    ops = counts(diff.snapshot_diff(old, new, ["o_orderkey"]), "op")
    assert ops == {"added": 1500, "removed": 1500, "modified": 1500, "same": 10500}
    ops = counts(q.snapshot_diff_query(spark, SF_DIR), "op")
    assert ops == {"added": 1500, "removed": 1500, "modified": 1500, "same": 12000}
    drift = q.field_drift_query(spark, SF_DIR)
    drift = drift.select("field", "old_type", "new_type", "new_n", "op")
    assert sorted(map(tuple, drift.collect()), key=repr) == [
        ("k", "int", "int", 9000, "same"),
        ("k", None, "string", 1000, "retyped"),
        ("z", None, "int", 1429, "added"),
    ]
    assert q.infer_bump_query(spark, SF_DIR).first().bump_type == "major"


def test_version_counts(spark):
    assert counts(q.parse_versions_query(spark, SF_DIR), "code") == {0: 15000, 109: 5}
    latest = dict(q.latest_version_query(spark, SF_DIR).collect())
    assert (latest[0], latest[1], latest[2]) == ("14.0.0", "12.1.0", "17.3.0")


def test_scored_changes_equal_the_title_rule(spark):
    scored = q.score_changes_query(spark, SF_DIR).select("event_id", "bump_type")
    ruled = q.classify_title_query(spark, SF_DIR).select("event_id", "bump_type")
    assert scored.exceptAll(ruled).isEmpty() and ruled.exceptAll(scored).isEmpty()
