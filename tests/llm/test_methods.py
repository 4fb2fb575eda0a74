"""Risks by finite differences, vectors of several lengths, and rows that repeat an id."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relgate.llm import ann, common, mixing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def side(rng, n, v):
    found = [np.flatnonzero(rng.random(v) < 0.4) for _ in range(n)]
    return np.concatenate(found), np.repeat(np.arange(n), [len(f) for f in found]), n


@pytest.mark.parametrize("prior, bias", [(0.1, 0.5), (0.9, -4.0)], ids=["above", "below"])
def test_risk_gradient_by_finite_differences(prior, bias):
    rng = np.random.default_rng(5)
    pos, unl = side(rng, 7, 6), side(rng, 11, 6)
    theta = np.append(rng.normal(size=6), bias)
    if bias < 0:  # positives score high and unlabelled rows low
        theta[:6], pos, unl = 2.0, side(rng, 7, 6), (np.zeros(0, int), np.zeros(0, int), 11)
    positive, negative, grad = toxicity.risk_and_gradient(theta, pos, unl, prior)
    assert (negative < 0) == (bias < 0)

    def risk(t):
        p = toxicity.risk_and_gradient(t, pos, unl, prior)
        return p[0] + p[1] if negative >= 0 else -p[1]

    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        assert grad[i] == pytest.approx((risk(theta + step) - risk(theta - step)) / 2e-6, abs=1e-6)
    scores = [sum(theta[pos[0][pos[1] == r]]) + bias for r in range(7)]
    assert positive == pytest.approx(prior * np.mean([np.log1p(np.exp(-s)) for s in scores]))


def test_sample_holds_the_smallest_hashes(spark):
    rows = spark.range(50_000).select("id", F.xxhash64("id", F.lit("sample")).alias("h")).toPandas()
    found = common.hashed_sample(spark.range(50_000), "id", 1000).toPandas()
    assert sorted(found.id) == sorted(rows.nsmallest(1000, "h").id)
    assert common.hashed_sample(spark.range(10), "id", 50).count() == 10
    assert common.hashed_sample(spark.range(0), "id", 50).count() == 0


def test_nearest_within_each_length(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(120)]
    rows += [(200, [1.0]), (None, [1.0, 2.0, 3.0]), (300, None), (400, []), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, df.filter("vec_id % 10 = 0"), "vec_id", "embedding").toPandas()
    good = [(i, np.array(v)) for i, v in rows[:120]]
    for q in range(0, 120, 10):
        mine = found[found.query_id == q].sort_values("rank")
        same = [(np.sqrt(((v - good[q][1]) ** 2).sum()), i) for i, v in good if i != q and len(v) == len(good[q][1])]
        assert set(mine.vec_id) <= {i for _, i in same}
        if q:  # key 0 is repeated, so its rows search twice
            assert mine.vec_id.tolist() == [i for _, i in sorted(same)[:10]]
    assert found[found.query_id == 200].empty


def documents(seed, n):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{j}" for j in rng.integers(0, 500, 40)) for _ in range(n)]


def test_rows_of_one_id_with_other_texts_stay(spark):
    a, b, c, d = documents(1, 4)
    rows = [
        (1, a, "en", "x", 1), (1, a, "de", "x", 1), (1, b, "en", "x", 1), (2, c, "en", "x", 1),
        (3, b + " more", "en", "x", 1), (4, None, "en", "x", 0), (4, "", "en", "x", 0), (4, d, "en", "x", 1),
        (None, a, "en", "x", 1), (None, a, "en", "x", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for part in (docs, docs.repartition(5)):
        kept = [(r.doc_id, r.text, r.lang) for r in corpus_pipeline.near_dedup_stage(spark, part, "").collect()]
        ids = Counter(k[0] for k in kept)
        assert ids[None] == 2 and ids[2] == 1 and ids[4] == 3
        assert (1, a, "de") in kept and (1, a, "en") not in kept
        # b stands under the ids 1 and 3: one of the two stays.
        assert sum(t in (b, b + " more") for _, t, _ in kept) == 1 and len(kept) == 8


def test_mixed_rows_are_those_that_the_mix_takes(spark):
    texts = documents(2, 3000)
    rows = [(i % 2900, t[: 3 + i % 190], "en", "abc"[i % 7 % 3], i) for i, t in enumerate(texts)]
    rows += [(5000, None, None, None, 0), (5001, "", "en", "a", 0), (5002, "one two", None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, "doc_id", "source", "text").toPandas()
    out = mixing.mixed_rows(docs, "doc_id", "source", "text")
    assert out.columns == docs.columns
    out = out.toPandas()
    out["words"] = out.text.map(lambda t: len(brute.words(t)))
    by_source = out.groupby(out.source.fillna("")).words.sum().to_dict()
    assert by_source == mixed.groupby(mixed.source.fillna("")).taken.sum().to_dict()
    taken = out.groupby("doc_id").words.sum()
    expected = mixed.groupby("doc_id").taken.sum()
    assert (taken.reindex(expected.index, fill_value=0) == expected).all()
    assert {5000, 5001} <= set(out.doc_id)
    assert mixing.mixed_rows(docs.limit(0), "doc_id", "source", "text").count() == 0

