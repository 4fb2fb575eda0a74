"""Streams against batch results, across restarts, replays and late rows."""

import datetime as dt

import pytest
from compare import DATA
from pyspark.sql import functions as F

from relgate.functions import codes
from relgate.operators import validate
from relgate.plans import queries as q
from relgate.streaming.streams import append_to, finished_folders, stream_dataset
from relgate.streaming.validation import judged_records, split_stream, write_batch
from relgate.streaming.windows import windowed_gate, without_repeats

SF_DIR = f"{DATA}/sf0.01"
DAY = dt.datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp, kind string"


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def judge(batch):
    return validate.verdict(batch, ["doc_id"], validate.text_checks("text", 5, ["."]))


@pytest.fixture
def texts(spark):
    rows = [(i, None if i % 7 == 0 else "no" if i % 5 == 0 else f"text {i}." if i % 3 else f"text {i}") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_stream_verdicts_equal_batch_verdicts(spark, tmp_path, texts):
    source, root, checkpoint = (str(tmp_path / n) for n in ("source", "root", "checkpoint"))
    schema = judge(texts).schema
    for part in range(3):
        texts.filter(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = stream_dataset(spark, source, files_per_batch=1)
    split_stream(stream, judge, root, checkpoint)
    assert len(finished_folders(spark, f"{root}/batch=*")) == 3
    expected = listed(judge(texts))
    assert listed(judged_records(spark, root, schema).drop("outcome")) == expected
    good = judged_records(spark, root, schema, "good")
    assert good.filter(F.col("code") != codes.PASSED).isEmpty()
    assert good.count() + judged_records(spark, root, schema, "reject").count() == 60

    # A restart without new files adds nothing, and one with a new file only that.
    split_stream(stream, judge, root, checkpoint)
    assert listed(judged_records(spark, root, schema).drop("outcome")) == expected
    spark.createDataFrame([(100, "text 100.")], texts.schema).coalesce(1).write.mode("append").parquet(source)
    split_stream(stream, judge, root, checkpoint)
    assert judged_records(spark, root, schema).count() == 61


def test_a_replayed_batch_leaves_the_same_tables(spark, tmp_path, texts):
    root, schema = str(tmp_path / "root"), judge(texts).schema
    assert judged_records(spark, root, schema).collect() == []
    write_batch(judge(texts), root, 0)
    once = listed(judged_records(spark, root, schema))
    write_batch(judge(texts), root, 0)
    assert listed(judged_records(spark, root, schema)) == once and len(once) == 60
    # A batch that was cut short has no marker and is not read; run again, it is whole.
    write_batch(judge(texts), root, 1)
    (tmp_path / "root/batch=1/_SUCCESS").unlink()
    assert listed(judged_records(spark, root, schema)) == once
    write_batch(judge(texts.limit(0)), root, 1)
    assert listed(judged_records(spark, root, schema)) == once


def events(spark, *rows):
    return spark.createDataFrame([(i, None if at is None else DAY + dt.timedelta(hours=at), kind) for i, at, kind in rows], EVENT)


def test_windows_close_once_and_late_rows_change_nothing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    schema = events(spark, (0, 0, "a")).schema

    def run(*rows):
        if rows:
            events(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        gate = windowed_gate(stream_dataset(spark, source, schema), "ts", ["kind"], 2)
        query = append_to(gate, out, checkpoint)
        got = spark.read.schema(gate.schema).parquet(out)
        return query, listed(got.select(F.dayofyear("window_start"), "kind", "n_rows", "failed", "code"))

    first = [(1, "a", 3, True, codes.QUALITY_ERROR), (1, "b", 1, False, codes.PASSED)]
    rows = [(i, i, "a") for i in range(3)] + [(3, 5, "b"), (4, 24.5, "a"), (5, None, "a")]
    assert run(*rows)[1] == []  # the first day ended half an hour ago: still open
    assert run((6, 25.5, None))[1] == first
    assert run()[1] == first  # a restart gives no window twice
    query, got = run((7, 3, "a"), (8, 26, "a"))
    assert got == first
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    assert dropped == 1
    assert run((9, 60, "b"))[1] == sorted([*first, (2, "a", 2, False, codes.PASSED), (2, None, 1, False, codes.PASSED)], key=repr)


def test_windows_equal_the_closed_ones_of_the_batch(spark):
    stream = q.windowed_gate_query(spark, SF_DIR)
    assert stream.count() == 145
    batch = q.table(spark, SF_DIR, "events", "ts", "event_type").groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type"
    )
    assert batch.count().count() == 150
    assert stream.select("day", "event_type", "n_rows").join(batch.agg(F.count("*").alias("n_rows")), ["day", "event_type", "n_rows"]).count() == 145


def test_repeats_are_dropped_and_the_state_is_bounded(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    schema = events(spark, (0, 0, "a")).schema
    kept = []
    for hour in range(6):
        rows = [(100 * hour + i, hour + i / 200, "a") for i in range(100)]
        again = [(100 * (hour - 1) + i, hour - 1 + i / 200, "a") for i in range(100)] if hour else []
        events(spark, *rows, *rows, *again[80:], (None, hour, "n"), (None, hour, "n"), (7, None, "t")).coalesce(1).write.mode("append").parquet(source)
        query = append_to(without_repeats(stream_dataset(spark, source, schema), ["event_id"], "ts"), out, checkpoint)
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    found = spark.read.schema(schema).parquet(out)
    assert found.filter("event_id is not null").count() == 600
    assert found.select("event_id").filter("event_id is not null").distinct().count() == 600
    assert max(kept) <= 350 and kept[-1] <= 350  # keys of the last hours, not all 600
    append_to(without_repeats(stream_dataset(spark, source, schema), ["event_id"], "ts"), out, checkpoint)
    assert spark.read.schema(schema).parquet(out).count() == found.count()


def test_doubled_stream_gives_every_event_once(spark):
    found = q.streaming_deduplication_query(spark, SF_DIR)
    assert found.count() == 10_000 and found.select("event_id").distinct().count() == 10_000
