"""Deleted interpolation against plain counts, and texts longer than a chunk."""

import math
import tracemalloc
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relgate.llm import lm


def plain_scores(rows):
    """{index: (tokens, known, N, base, score)} of (key, text, held out) rows, from plain counts."""
    streams = [[*brute.words(text), None] for _, text, _ in rows]
    pairs, words, contexts = Counter(), Counter(), Counter()
    for (_, _, held), tokens in zip(rows, streams):
        if not held:
            for h, w in zip([b"<s>", *tokens[:-1]], tokens):
                pairs[h, w] += 1
                words[w] += 1
                contexts[h] += 1
    n, floor = sum(words.values()), 1 / (len(words) + 1)
    most, steps = lm.STEPS * lm.FACTORS + 1, Counter()

    def step(top, bottom):
        return most if top <= 0 or bottom <= 0 else min(round(-lm.STEPS * math.log2(top / bottom)), most)

    for (_, _, held), tokens in zip(rows, streams):
        if not held:
            for h, w in zip([b"<s>", *tokens[:-1]], tokens):
                rest = contexts[h] - 1
                cell = (lm.bucket(np.array([rest]))[0], step(pairs[h, w] - 1, rest), step(words[w] - 1, n - 1))
                steps[cell] += 1
    histogram = np.array([(*map(float, cell), float(count)) for cell, count in steps.items()]).reshape(-1, 4)
    weights = lm.learn(histogram, floor)
    out = []
    for tokens in streams:
        base = total = 0.0
        for h, w in zip([b"<s>", *tokens[:-1]], tokens):
            uniform, unigram, bigram = weights[lm.bucket(np.array([contexts[h]]))[0]]
            p = uniform * floor + unigram * words[w] / n
            p += bigram * (pairs[h, w] / contexts[h] if contexts[h] else floor)
            base += math.log10((words[w] + 1) / (n + len(words) + 1))
            total += math.log10(p)
        out.append((len(tokens), sum(words[w] > 0 for w in tokens), n, base, total))
    return out


ROWS = [(i, " ".join(f"w{(i * j * j + j) % 13}" for j in range(3 + 4 * i)), i % 4 == 3) for i in range(12)]
ROWS += [(50, "only here held", True), (51, "", False), (52, None, True), (53, "w1 W1 w1\tw1", False)]
ROWS += [(54, " ".join(f"w{j % 5}" for j in range(90)), False), (55, " ".join(f"w{j % 7}" for j in range(95)), True)]


@pytest.mark.parametrize("tokens", [2, 5, 18, 250_000])
def test_scores_equal_plain_counts_whatever_the_chunk(spark, tokens):
    df = spark.createDataFrame(ROWS, "k long, t string, out boolean").coalesce(2)
    found = lm.scored(df, "k", "t", F.col("out"), chunk_tokens=tokens)
    assert found.columns == ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r.k: r for r in found.collect()}
    assert len(rows) == len(ROWS)
    for (key, _, held), expected in zip(ROWS, plain_scores(ROWS)):
        r = rows[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, *expected[:3])
        assert (r.base_score, r.score) == pytest.approx(expected[3:], rel=1e-9)


def test_chunks_are_bounded_and_texts_go_on_with_their_context(spark):
    df = spark.createDataFrame(ROWS, "key long, text string, held boolean")
    df = df.select("key", "held", F.col("text").cast("binary").alias("text")).coalesce(1)
    chunks = [lm._Chunk(r.asDict()) for r in lm.coded(df, 20).orderBy("chunk").collect()]
    assert max(len(c.token) for c in chunks) <= 20
    assert sum(len(c.token) for c in chunks) == sum(len(brute.words(t)) + 1 for _, t, _ in ROWS)


def test_repeated_and_null_keys_of_long_texts_stay_apart(spark):
    text = " ".join(f"w{j % 5}" for j in range(90))
    df = spark.createDataFrame([(None, text), (None, text), (1, text), (1, text)], "k long, t string")
    found = lm.scored(df, "k", "t", F.lit(False), chunk_tokens=20).collect()
    assert sorted((r.k is None, r.n_tokens) for r in found) == [(False, 91)] * 2 + [(True, 91)] * 2
    counts = defaultdict(set)
    for r in found:
        counts[r.n_tokens].add(round(r.score, 9))
    assert all(len(scores) == 1 for scores in counts.values())


def test_words_of_a_text_in_runs(monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT", 3)
    text = "Aa bbbbbb\n\nc\t\x00d   ee".encode()
    assert [w for run in lm._words(text) for w in run] == [b"aa", b"bbbbbb", b"c", b"\x00\x00d", b"ee"]


def test_rows_between_stages_hold_codes_and_answers_compressed(spark):
    text = " ".join(f"w{(j * j) % 211}" for j in range(20_000))
    df = spark.createDataFrame([(0, False, text.encode())], "key long, held boolean, text binary")
    chunks = lm.coded(df, 100_000).cache()
    row = chunks.first()
    assert len(row.codes) < 2 * 20_001  # four bytes a token are what the row held before
    chunk = lm._Chunk(row.asDict())
    answers = lm._counts(chunks, 1).collect()
    assert sum(len(a.answer) for a in answers) < 2 * (len(chunk.pairs) + len(chunk.hashes))
    chunks.unpersist()


def requests(hashes, counts, words):
    """The table of one part: one row per chunk of rising hashes, their counts and which are words."""
    return pa.table(
        {
            "chunk": pa.array(range(len(hashes)), pa.int64()),
            "part": pa.array([0] * len(hashes), pa.int32()),
            "hashes": pa.array([lm._packed(h) for h in hashes], pa.binary()),
            "counts": pa.array([lm._planes(c) for c in counts], pa.binary()),
            "word": pa.array([np.packbits(w).tobytes() for w in words], pa.binary()),
        }
    )


def test_sums_of_a_part_whatever_the_range_of_a_hash():
    edges = [k * (1 << 61) + d for k in range(8) for d in (0, 1, 2, (1 << 61) - 2, (1 << 61) - 1)]
    some = np.random.default_rng(1).integers(0, 1 << 64, 300, np.uint64)
    pool = np.unique(np.concatenate([np.array(edges, np.uint64), some]))
    rng = np.random.default_rng(2)
    hashes = [np.sort(rng.choice(pool, n, replace=False)) for n in (300, 1, 170, 40)]
    hashes.append(hashes[0][:1])  # in one range alone
    is_word = {int(h): bool(h % np.uint64(3) == 0) for h in pool}
    words = [np.array([is_word[int(h)] for h in hs]) for hs in hashes]
    counts = [rng.integers(0, 3, len(h)).astype(np.uint32) for h in hashes]
    counts[0][5], counts[2][:] = (1 << 32) - 1, (1 << 32) - 1  # sums above 32 bits
    sums = Counter()
    for hs, cs, ws in zip(hashes, counts, words):
        for h, c, w in zip(hs, cs, ws):
            sums[int(h) >> 1, bool(w)] += int(c)
    out = lm._answered(requests(hashes, counts, words)).to_pylist()
    assert [o["chunk"] for o in out] == list(range(5)) and any(o["wide"] for o in out)
    for o, hs, ws in zip(out, hashes, words):
        found = lm._from_planes(o["answer"], "<u8" if o["wide"] else "<u4").tolist()
        assert found == [sums[int(h) >> 1, bool(w)] for h, w in zip(hs, ws)]
    assert sum(o["known"] for o in out) == sum(n > 0 for (_, word), n in sums.items() if word)


def test_memory_of_a_part_is_not_many_times_its_requests():
    rng = np.random.default_rng(3)
    hashes = [np.unique(rng.integers(0, 1 << 64, 100_000, np.uint64)) for _ in range(16)]
    n = sum(map(len, hashes))
    group = requests(hashes, [np.ones(len(h), np.uint32) for h in hashes], [np.zeros(len(h), bool) for h in hashes])
    tracemalloc.start()
    try:
        lm._answered(group)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 45 * n  # 70 bytes an n-gram when all were sorted at once
