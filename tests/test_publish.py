import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from relgate import session
from relgate.functions.codes import GateError
from relgate.operators.skew import heavy_hitters
from relgate.plans.release import Gate, Release, release
from relgate.plans.queries import QUERIES
from relgate.session import scratch_path
from relgate.sources import publish as p
from relgate.sources.datasets import read_dataset


def frame(spark, n, tag="a"):
    return spark.createDataFrame([(i, tag) for i in range(n)], "k int, v string")


def test_build_replaces_and_writes_all_formats(spark, tmp_path):
    staging = str(tmp_path / "staging")
    p.build(frame(spark, 9), staging, ("parquet", "json"))
    built = p.build(frame(spark, 4), staging, ("parquet", "json"))
    assert built.count() == 4
    as_json = p.read_built(spark, staging, "json", built)
    assert as_json.schema == built.schema and as_json.exceptAll(built).isEmpty()


def test_a_published_version_is_immutable(spark, tmp_path):
    root = str(tmp_path)
    p.publish(frame(spark, 5), root, "d", "1.0.0")
    with pytest.raises(GateError) as failed:
        p.publish(frame(spark, 7), root, "d", "1.0.0")
    assert failed.value.code == 106
    assert p.publish(frame(spark, 7), root, "d", "1.0.0", skip_existing=True).count() == 5
    p.publish(frame(spark, 7), root, "d", "1.10.0")
    assert sorted(p.published_versions(spark, root, "d")) == ["1.0.0", "1.10.0"]
    assert p.published_versions(spark, root, "none") == []
    assert read_dataset(spark, root, "d", "1.10.0", ["k"]).columns == ["k"]
    assert read_dataset(spark, root, "d").count() == 12


def test_an_unfinished_version_can_be_replaced(spark, tmp_path):
    root = str(tmp_path)
    left = tmp_path / "d" / "version=1.0.0"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"cut short")
    assert p.published_versions(spark, root, "d") == []
    with pytest.raises(GateError):
        p.publish(frame(spark, 5), root, "d", "1.0.0")
    assert p.publish(frame(spark, 5), root, "d", "1.0.0", replace_unfinished=True).count() == 5
    with pytest.raises(GateError):
        p.publish(frame(spark, 7), root, "d", "1.0.0", replace_unfinished=True)


def names(path):
    return sorted(f.name for f in path.iterdir()) if path.exists() else []


def test_one_of_several_writers_publishes_a_version(spark, tmp_path):
    root, writers = str(tmp_path), 6
    start = threading.Barrier(writers)

    def write(tag):
        start.wait()
        try:
            return p.publish(frame(spark, 50, tag).repartition(4), root, "d", "1.0.0").select("v").distinct().collect()
        except GateError as error:
            return error.code

    with ThreadPoolExecutor(writers) as pool:
        results = list(pool.map(write, "abcdef"))
    won = [r for r in results if r != 106]
    assert len(won) == 1 and len(results) == writers
    kept = read_dataset(spark, root, "d", "1.0.0")
    assert kept.count() == 50 and kept.select("v").distinct().collect() == won[0]
    assert names(tmp_path / "d/_runs") == [] and names(tmp_path / "d/_claims") in (["version=1.0.0"], [".version=1.0.0.crc", "version=1.0.0"])


def test_a_second_writer_that_may_skip_reads_the_first_ones_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    claim = p._claim

    def late(spark, path, run):  # another writer is faster by a moment
        assert claim(spark, path, "other")
        return claim(spark, path, run)

    frame(spark, 3, "other").write.parquet(f"{root}/d/_runs/other")
    monkeypatch.setattr(p, "_claim", late)
    kept = p.publish(frame(spark, 9), root, "d", "1.0.0", skip_existing=True)
    assert kept.select("v").distinct().first().v == "other" and kept.count() == 3
    assert names(tmp_path / "d/_runs") == []


def test_a_claim_publishes_even_if_its_writer_is_lost(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with monkeypatch.context() as lost:
        lost.setattr(p, "_settle", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            p.publish(frame(spark, 5), root, "d", "1.0.0")
    assert p.published_versions(spark, root, "d") == ["1.0.0"]
    with pytest.raises(GateError):
        p.publish(frame(spark, 7), root, "d", "1.0.0", replace_unfinished=True)
    assert p.read_version(spark, root, "d", "1.0.0").count() == 5
    assert p.publish(frame(spark, 7), root, "d", "1.0.0", skip_existing=True).count() == 5


def test_a_writer_lost_before_its_claim_has_published_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with monkeypatch.context() as lost:
        lost.setattr(p, "_claim", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            p.publish(frame(spark, 5), root, "d", "1.0.0")
    assert p.published_versions(spark, root, "d") == []
    assert p.publish(frame(spark, 7), root, "d", "1.0.0").count() == 7
    assert read_dataset(spark, root, "d").count() == 7


def test_a_finished_folder_without_a_claim_is_not_replaced(spark, tmp_path):
    root = str(tmp_path)
    frame(spark, 4).write.parquet(f"{root}/d/version=1.0.0")
    assert p.published_versions(spark, root, "d") == ["1.0.0"]
    with pytest.raises(GateError):
        p.publish(frame(spark, 7), root, "d", "1.0.0", replace_unfinished=True)
    assert p.publish(frame(spark, 7), root, "d", "1.0.0", skip_existing=True).count() == 4


def test_scratch_goes_with_its_run(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr(session, "_shared_folder", lambda _: str(shared))
    with session.scratch_scope(spark) as outer:
        kept = session.written(frame(spark, 3), "kept")
        with pytest.raises(RuntimeError):
            with session.scratch_scope(spark) as inner:
                session.written(frame(spark, 5), "gone")
                assert inner.startswith(outer) and len(list(Path(inner).iterdir())) == 1
                raise RuntimeError
        assert not Path(inner).exists() and kept.count() == 3
        assert scratch_path(spark, "x").startswith(outer)
    assert names(shared) == []
    assert not scratch_path(spark, "x").startswith(outer)


def test_a_query_leaves_no_scratch(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr(session, "_shared_folder", lambda _: str(shared))
    with session.scratch_scope(spark):
        for name in ("p1_build", "p3_publish", "q9_near_duplicates", "r1_release_published", "x2_windowed_gate"):
            assert QUERIES[name][0](spark, "/root/testdata/sf0.001").count() > 0
        assert len(list(shared.rglob("*.parquet"))) > 20
    assert names(shared) == []


def test_new_rows(spark):
    found = p.new_rows(frame(spark, 6), frame(spark, 4, "b"), ["k"])
    assert sorted(r.k for r in found.collect()) == [4, 5]


def test_scratch_follows_the_session(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second


def test_heavy_hitters_are_bounded(spark):
    stats = spark.range(5000).selectExpr("id AS k", "id + 1 AS n")
    hot = heavy_hitters(stats, "k", "n", hot_min=10, max_hot=3).collect()
    assert [r.k for r in hot] == [4999, 4998, 4997]


def plan(spark, root, candidate, previous, verdicts=((1, 0, None),), **given):
    gates = given.pop("gates", [0.0])
    return Release(
        name="d",
        root=f"{root}/published",
        staging=f"{root}/staging",
        candidate=candidate,
        previous=previous,
        keys=["k"],
        verdicts=spark.createDataFrame(list(verdicts), "id int, code int, message string"),
        verdict_key="id",
        gates=[
            Gate(f"g{i}", spark.createDataFrame([(m,)], "m double"), "m", 1.0)
            for i, m in enumerate(gates)
        ],
        **given,
    )


def outcome(report):
    return [(r.name, r.pct, r.status, r.code) for r in report.orderBy("step").collect()]


def test_a_release_builds_on_the_published_one(spark, tmp_path):
    root = str(tmp_path)
    empty = frame(spark, 1).filter("false")
    first = release(spark, plan(spark, root, frame(spark, 3), empty))
    assert outcome(first) == [
        ("validation", 20, "passed", 0),
        ("quality", 40, "passed", 0),
        ("changes", 60, "passed", 0),
        ("version", 80, "passed", 0),
        ("publish", 100, "passed", 0),
    ]
    assert p.published_versions(spark, f"{root}/published", "d") == ["0.2.0"]
    previous = read_dataset(spark, f"{root}/published", "d", "0.2.0")
    second = release(spark, plan(spark, root, frame(spark, 3, "b"), previous))
    assert second.filter("name = 'version'").first().message == "0.2.0 -> 0.2.1"
    # A new column alone is a change, too.
    wider = frame(spark, 3).selectExpr("*", "1 AS extra")
    grown = release(spark, plan(spark, root, wider, frame(spark, 3), current_version="0.9.9"))
    assert grown.filter("name = 'version'").first().message == "0.9.9 -> 0.10.0"
    # Nothing changed since: the run ends at the change step, and nothing is written.
    latest = read_dataset(spark, f"{root}/published", "d", "0.2.1")
    third = release(spark, plan(spark, root, frame(spark, 3, "b"), latest))
    assert outcome(third)[2:] == [
        ("changes", 40, "failed", 107),
        ("version", 40, "skipped", None),
        ("publish", 40, "skipped", None),
    ]
    versions = sorted(p.published_versions(spark, f"{root}/published", "d"))
    assert versions == ["0.10.0", "0.2.0", "0.2.1"]


def test_gate_limits_come_from_the_settings(spark, tmp_path):
    old, new = frame(spark, 3), frame(spark, 4)

    def quality(settings, measured):
        gates = [Gate("dup", spark.createDataFrame([(measured,)], "m double"), "m", "max_duplicates")]
        made = plan(spark, str(tmp_path), new, old, settings=settings, current_version="x")
        made.gates = gates
        row = release(spark, made).filter("name = 'quality'").first()
        return row.code, row.message

    assert quality("{}", 1.0) == (0, "1 gates passed")
    assert quality("{}", 1.01) == (102, "dup 1.01 above 1.00")
    assert quality('{"quality": {"max_duplicates": 20}}', 19.5) == (0, "1 gates passed")
    assert quality('{"quality": {"max_duplicates": null}}', 0.0)[0] == 101
    assert quality('{"quality": 3}', 0.0) == (101, "invalid settings: quality")
    assert quality("{", 0.0) == (101, "invalid settings: not JSON")


def test_a_release_ends_at_its_first_failure(spark, tmp_path):
    root = str(tmp_path)
    old, new = frame(spark, 3), frame(spark, 4)
    bad = [(2, 114, "second"), (1, 112, "first"), (3, 0, None)]

    invalid = release(spark, plan(spark, root, new, old, bad)).first()
    assert (invalid.status, invalid.code, invalid.message) == ("failed", 112, "first")
    tolerant = release(spark, plan(spark, root, new, old, bad, max_invalid_pct=70.0)).first()
    assert (tolerant.status, tolerant.message) == ("passed", "2 of 3 records failed")
    repeated = release(spark, plan(spark, root, new.union(old), old)).first()
    assert (repeated.code, repeated.message) == (112, "keys of the candidate rows are not unique: k")

    gated = release(spark, plan(spark, root, new, old, gates=[1.0, 1.5, 9.0])).collect()
    assert (gated[1].code, gated[1].message) == (102, "g1 1.50 above 1.00")
    unmeasured = release(spark, plan(spark, root, new, old, gates=[None])).collect()
    assert (unmeasured[1].code, unmeasured[1].message) == (102, "g0 is unmeasured")

    odd = release(spark, plan(spark, root, new, old, current_version="1.2")).collect()
    assert (odd[3].code, odd[3].status, odd[4].status) == (109, "failed", "skipped")
    unknown = release(spark, plan(spark, root, new, old, drift=old)).collect()
    assert (unknown[2].code, unknown[2].status) == (100, "failed")
    # Only the tolerant run got as far as writing.
    assert p.published_versions(spark, f"{root}/published", "d") == ["0.2.0"]

    p.publish(new, f"{root}/published", "d", "2.0.0")
    clash = release(spark, plan(spark, root, new, old, current_version="1.9.0")).collect()
    assert clash[3].message == "1.9.0 -> 1.10.0"
    taken = release(spark, plan(spark, root, old, new, current_version="1.9.0")).collect()
    assert (taken[3].message, taken[4].code) == ("1.9.0 -> 2.0.0", 106)
