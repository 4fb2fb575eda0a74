"""Near duplicates against a plain comparison of all pairs."""

import random
from collections import Counter, defaultdict

import pytest
from compare import DATA
from pyspark.sql import functions as F

from relgate.operators import similar
from relgate.plans.queries import QUERIES
from relgate.session import scratch_scope


def plain_sets(rows, width):
    sets = []
    for key, text in rows:
        words = (text or "").lower().split()
        n = min(width, len(words))
        sets.append((key, frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()))
    return sets


def plain_links(rows, width, num, den):
    """[(id, class id, links, representative)] of (id, text) rows."""
    sets = plain_sets(rows, width)
    names = defaultdict(list)
    for key, s in sets:
        names[s].append(key)
    out = []
    for at, (key, s) in enumerate(sets):
        if not s:
            out.append((key, key, 0, True))
            continue
        links = sum(
            1
            for other, (_, t) in enumerate(sets)
            if other != at and t and den * len(s & t) >= num * (len(s) + len(t) - len(s & t))
        )
        name = min((k for k in names[s] if k is not None), default=None)
        out.append((key, name, links, key == name))
    return out


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(draw, n):
    """Copies and near copies of a few texts, and others."""
    stems = [[f"w{draw.randint(0, 300)}" for _ in range(draw.randint(3, 40))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(draw.choice(stems))
        for _ in range(draw.choice([0, 0, 1, 2, 5])):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 20)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("width, threshold", [(5, (7, 10)), (2, (8, 10)), (1, (1, 2)), (3, (1, 1))])
@pytest.mark.parametrize("options", [{}, {"hot_posting": 3, "grid": 2, "hot": 3}])
def test_links_equal_those_of_all_pairs(spark, width, threshold, options):
    rows = texts(random.Random(width), 150)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    with scratch_scope(spark):
        found = listed(similar.near_duplicates(df, "id", "text", width, threshold, **options))
    assert found == sorted(plain_links(rows, width, *threshold), key=repr)


def test_edges(spark):
    body = " ".join(f"w{i}" for i in range(30))
    rows = [
        (1, body), (1, body), (None, body.upper()), (2, None), (3, ""), (4, " \n\t"), (5, "one two"), (6, "One\ntwo"),
        (7, body + " x"), (None, "only null"), (None, "only null"), (8, " ".join(f"v{i % 5000}" for i in range(60_000))),
    ]
    df = spark.createDataFrame(rows, "id long, text string")
    extra = df.select("*", *(F.lit(1).alias(c) for c in ("class", "n", "key", "shingles", "block", "links", "members")))
    with scratch_scope(spark):
        for run in (similar.near_duplicates, similar.near_duplicates_banded):
            found = run(extra, "id", "text")
            assert found.columns == ["id", "class_id", "n_links", "representative"]
            expected = [(*r[:3], r[0] == r[1]) for r in plain_links(rows, 5, 7, 10)]
            assert listed(found) == sorted(expected, key=repr)
            assert run(extra.limit(0), "id", "text").collect() == []


def test_a_large_group_and_a_passage_in_many_texts(spark):
    draw = random.Random(11)
    body = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):  # near copies: most of each other, not all
        words = list(body)
        for _ in range(draw.randint(1, 3)):
            words[draw.randrange(60)] = f"y{i}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(12))
    rows += [(1000 + i, " ".join(f"z{i}_{j}" for j in range(draw.choice([2, 3, 40]))) + " " + passage) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(8)
    with scratch_scope(spark):
        found = listed(similar.near_duplicates(df, "id", "text"))
        banded = {r[0]: r[2] for r in listed(similar.near_duplicates_banded(df, "id", "text"))}
    assert found == sorted(plain_links(rows, 5, 7, 10), key=repr)
    links = {r[0]: r[2] for r in found}
    assert all(banded[i] <= n for i, n in links.items())
    assert sum(banded.values()) >= 0.95 * sum(links.values())


def test_banded_links_are_a_part_of_the_exact_ones(spark):
    with scratch_scope(spark):
        exact, banded = (
            {r.doc_id: r for r in QUERIES[name][0](spark, f"{DATA}/sf0.01").collect()}
            for name in ("q9_near_duplicates", "q9b_near_duplicates_banded")
        )
    assert {i: r.class_id for i, r in exact.items()} == {i: r.class_id for i, r in banded.items()}
    assert all(banded[i].n_links <= r.n_links for i, r in exact.items())
    links = sum(r.n_links for r in exact.values())
    assert sum(r.n_links for r in banded.values()) >= 0.95 * links
    sizes = Counter(r.class_id for r in exact.values())
    assert (links // 2, sum(n * (n - 1) // 2 for n in sizes.values())) == (134, 91)


def test_no_python_and_no_cross_join(spark):
    df = spark.createDataFrame(texts(random.Random(1), 20), "id long, text string")
    with scratch_scope(spark):
        sets = similar.shingle_sets(df, "id", "text")
        names = similar._names(sets, "shingles")
        for frame in (
            sets,
            similar._prefix_postings(names, similar.THRESHOLD, 2),
            sets.withColumn("keys", similar._band_keys(10, 3)),
            similar.near_duplicates(df, "id", "text"),
        ):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_classes_that_nothing_can_be_linked_with_go_no_further(spark):
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, " ".join(f"u{i}_{j}" for j in range(150)) + " " + passage) for i in range(200)]  # no links, a shared passage
    rows += [(1000 + i, text) for i, text in texts(draw, 60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    linked = {r[0] for r in plain_links(rows, 5, 7, 10) if r[2]}
    with scratch_scope(spark):
        sets = similar.written(similar.shingle_sets(df, "id", "text"), "sets")
        names = similar.written(similar._names(sets), "names")
        one = similar.written(similar._one_per_class(sets, names), "one")
        left = similar.written(similar._linkable(one, similar.THRESHOLD), "left")
        assert one.count() == names.count() == left.select("number").union(one.select("number")).distinct().count()
        kept = {r.id for r in names.join(left, "number").join(sets.select("class", "id"), "class").select("id").collect()}
        found = listed(similar.near_duplicates(df, "id", "text"))
    members = Counter(frozenset(s) for _, s in plain_sets(rows, 5))
    by_id = dict(plain_sets(rows, 5))
    assert all(i in kept for i in linked if members[by_id[i]] <= next(r[2] for r in found if r[0] == i))
    assert sum(i < 1000 for i in kept) <= 20  # a part of all shingles decides, so some may stay
    assert found == sorted(plain_links(rows, 5, 7, 10), key=repr)


def test_band_keys_are_those_of_the_shingles_and_their_minima_compiled(spark):
    df = spark.createDataFrame(texts(random.Random(2), 80), "id long, text string").repartition(3)
    with scratch_scope(spark):
        sets = similar.written(similar.shingle_sets(df, "id", "text"), "sets")
        names = similar.written(similar._names(sets), "names")
        postings = similar._band_postings(similar._one_per_class(sets, names), 10, 3)
        plain = names.join(sets.select("number", "shingles"), "number").select("number", F.explode(similar._band_keys(10, 3)).alias("key"))
        assert listed(postings.select("number", "key")) == listed(plain)
        plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "array_min" not in plan and "partial_min" in plan and "ObjectHash" not in plan and "SortAggregate" not in plan
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("shingle" in line for line in exchanged)
