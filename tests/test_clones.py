"""Clone operators against brute force, with and without heavy keys."""

import random
from collections import Counter, defaultdict

import pytest

from relgate.operators import clones

HOT = [100_000, 2]


def texts(seed=7, n=120):
    """A third of the texts are one text; others share blocks or repeat a line."""
    rng = random.Random(seed)
    common = "\n".join(f"licence {i}" for i in range(9))
    blocks = ["\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(12)]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            text = common
        elif i % 10 == 1:
            text = "\n".join(["same"] * rng.randint(1, 20))
        else:
            text = "\n".join(rng.choice(blocks) for _ in range(rng.randint(1, 5))) + f"\n{i % 40}"
        rows.append((i, text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "")]


def covered_lines(rows, k):
    windows = defaultdict(list)
    for key, text in rows:
        lines = text.split("\n") if text is not None else []
        for start in range(len(lines) - k + 1):
            windows[tuple(lines[start : start + k])].append((key, start))
    return {
        (key, start + offset)
        for places in windows.values()
        if len(places) > 1
        for key, start in places
        for offset in range(k)
    }


@pytest.mark.parametrize("hot_min", HOT)
@pytest.mark.parametrize("k", [1, 3, 6])
def test_window_clones(spark, k, hot_min):
    rows = texts()
    df = spark.createDataFrame(rows, "id int, text string")
    found = clones.window_clones(df, "id", "text", k, hot_min).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == covered_lines(rows, k)


@pytest.mark.parametrize("hot_min", HOT)
def test_exact_clones(spark, hot_min):
    rows = texts()
    df = spark.createDataFrame(rows, "id int, text string")
    sizes = Counter(t for _, t in rows if t is not None)
    lowest = {}
    for key, text in rows:
        lowest.setdefault(text, key)
    expected = sorted((lowest[t], key, sizes[t]) for key, t in rows if sizes.get(t, 0) > 1)
    found = clones.exact_clones(df, "id", "text", hot_min)
    assert sorted(map(tuple, found.select("group_id", "id", "n").collect())) == expected


@pytest.mark.parametrize("hot_min", HOT)
def test_duplication_percent(spark, hot_min):
    rows = texts()
    df = spark.createDataFrame(rows, "id int, text string")
    total = sum(len(t.split("\n")) for _, t in rows if t is not None)
    dup = len(covered_lines(rows, 6))
    row = clones.duplication(df, "id", "text", 6, hot_min).first()
    assert (row.dup_lines, row.total_lines) == (dup, total)
    assert row.pct == pytest.approx(100 * dup / total, abs=1e-9)


def test_gate_without_lines_fails_as_unmeasured(spark):
    df = spark.createDataFrame([], "id int, text string")
    row = clones.duplication_gate(df, "id", "text").first()
    assert (row.dup_lines, row.pct, row.failed, row.code) == (0, None, True, 102)


def test_percent_at_the_limit_passes(spark):
    block = "\n".join(f"line {i}" for i in range(6))
    filler = "\n".join(f"other {i}" for i in range(12))
    df = spark.createDataFrame([(1, block), (2, block), (3, filler)], "id int, text string")
    assert not clones.duplication_gate(df, "id", "text", max_pct=50.0).first().failed
    assert clones.duplication_gate(df, "id", "text", max_pct=49.9).first().failed
