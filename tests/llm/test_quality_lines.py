"""Lines told apart inside documents, and the chain's sums against all labelings."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from relgate.llm import quality

WORDS = "the river ran past a quiet mill and every evening its owner walked home along old stones".split()


def prose(rng):
    return " ".join(rng.choice(WORDS, int(rng.integers(9, 18)))) + "."


def junk(rng):
    return " ".join(rng.choice(["$$", "##", "buy", "buy", "|", "%%", "99"], int(rng.integers(9, 18))))


def planted(n, seed):
    """Documents of ten lines, of which the fewer kind fills one to three; (text, label, good lines)."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        label = i % 2
        odd = set(rng.choice(10, int(rng.integers(1, 4)), replace=False).tolist())
        kinds = [label if k not in odd else 1 - label for k in range(10)]
        out.append(("\n".join(prose(rng) if g else junk(rng) for g in kinds), label, kinds))
    return out


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(3)
    scores = [rng.normal(size=n) for n in (1, 4, 6)]
    chain = rng.normal(size=(2, 2))
    good, pairs, log_z, _ = quality.marginals(scores, chain)
    for i, s in enumerate(scores):
        weight, ones, both = 0.0, np.zeros(len(s)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(s)):
            steps = list(zip(labels, labels[1:]))
            p = np.exp(np.dot(labels, s) + sum(chain[a, b] for a, b in steps))
            weight += p
            ones += p * np.array(labels)
            for a, b in steps:
                both[a, b] += p
        assert log_z[i] == pytest.approx(np.log(weight))
        assert good[i, : len(s)] == pytest.approx(ones / weight)
        assert pairs[i].ravel() == pytest.approx((both / weight).ravel())


def test_expected_lines_meet_the_share_and_leave_the_rest():
    scores = [np.array([0.2, -1.0, 0.5]), np.array([4.0, 4.0, 4.0]), np.array([1.0, 2.0])]
    lengths = [np.array([1.0, 0.5, 0.2]), np.ones(3), np.array([0.3, 1.0])]
    labels, chain = np.array([1, 1, 0]), np.array([[0.7, -0.7], [-0.7, 0.7]])
    good, _ = quality.expected_lines(scores, lengths, labels, chain, 0.8)
    shares = [g[: len(n)] @ n / n.sum() for g, n in zip(good, lengths)]
    assert 0.8 <= shares[0] < 0.82 and 0.18 < shares[2] <= 0.2
    assert good[1] == pytest.approx(quality.marginals(scores, chain)[0][1])


def test_planted_lines_are_told_apart(spark):
    train, held = planted(300, 1), planted(100, 2)
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(train)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(train)], "doc_id long, quality int")
    field = quality.fit(docs, labels, "doc_id", "text", "quality", F.lit(True))
    rows = [(i, t) for i, (t, _, _) in enumerate(held)] + [(None, None), (-1, " \n ")]
    found = quality.line_labels(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", field)
    found = found.toPandas()
    assert len(found) == 1000 and (found.n_chars > 0).all()
    right = [(r.good >= 0.5) == bool(held[r.doc_id][2][r.line - 1]) for r in found.itertuples()]
    assert np.mean(right) >= 0.95
    texts = [t for t, _, _ in held]
    assert [s >= 0.5 for s in quality.quality(texts, field)] == [bool(y) for _, y, _ in held]
