"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features describe the line and its two neighbours, and the
chain ties adjacent labels. The marginals of all lines, by forward-backward and weighted
by the lines' lengths, are the quality of the document.

Only documents are labelled for training, so line labels are hidden. A document's label says
that its good lines hold a large share of its length, or a small one. Training alternates
between the distribution over line labels nearest to the field's that keeps to those shares
(the field's own scores, tilted by length until the share is met) and fitting the field to
its expectations. A document that meets its share is left as the field sees it, so a bad
document may hold good lines and a good one bad lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgate.llm.common import hashed_sample

SPACE, LOWER, UPPER, DIGIT, SYMBOL = range(5)
FEATURES = 14
#: Chains that are computed side by side.
TOGETHER = 512
#: Halvings by which the tilt that meets a document's share is found, and the largest tilt.
HALVINGS, STEEPEST = 10, 40.0


@dataclass(frozen=True)
class Settings:
    """``documents`` bounds the sample of labelled rows that the field is fitted on.

    ``share``: of a good document, good lines hold at least so much of the length; of a bad
    one, bad lines do. ``steps`` are taken towards the line labels of each of ``rounds``; in
    the first ``alone`` rounds a line is judged by its own features, so that what it has in
    common with lines of the other kind of document is not put down to its neighbours.
    """

    documents: int = 4000
    rounds: int = 16
    steps: int = 10
    share: float = 0.7
    alone: int = 10
    rate: float = 0.1
    decay: float = 1e-4


@dataclass(frozen=True)
class Field:
    """``unary``: weights of a good line; ``chain[a, b]``: label a before label b (1 is good)."""

    unary: np.ndarray
    chain: np.ndarray
    prior: float = 0.5


@cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, SYMBOL, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isspace():
            table[code] = SPACE
        elif c.isdigit():
            table[code] = DIGIT
        elif c.isalpha():
            table[code] = UPPER if c.isupper() else LOWER
    return table


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines that hold more than white space, and their lengths."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    line_of = np.cumsum(codes == 10) - (codes == 10)
    lines = text.split("\n")
    kinds = np.bincount(line_of * 5 + _classes()[codes], minlength=5 * len(lines))
    kinds = kinds.reshape(-1, 5)[: len(lines)].astype(float)
    seen: set[str] = set()
    rows, lengths, use = [], [], []
    for number, line in enumerate(lines):
        words = line.split()
        if not words:
            continue
        distinct = set(words)
        n = len(words)
        rows.append(
            (
                np.log1p(n) / 5,
                min(len(line) / n, 30) / 10,
                len(distinct) / n,
                sum(map(str.__eq__, words, words[1:])) / n,
                float(line in seen),
                float(words[-1][-1] in ".!?"),
                sum(len(w) == 1 and not w.isalnum() for w in words) / n,
                float(len(distinct) < 0.5 * n),
            )
        )
        seen.add(line)
        use.append(number)
        lengths.append(len(line))
    counts = kinds[use]
    total = np.maximum(counts[:, LOWER:].sum(axis=1, keepdims=True), 1)
    shares = counts[:, LOWER:] / total
    symbol = shares[:, 3:]
    return np.hstack([np.array(rows).reshape(-1, 8), shares, symbol > 0.08, symbol > 0.2]), np.array(lengths)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it, and a constant."""
    edge = np.zeros((1, x.shape[1]))
    before, after = np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge])
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def marginals(scores: list[np.ndarray], chain: np.ndarray):
    """Forward-backward on chains of one length class: ``good`` marginals, pair sums, log Z.

    ``scores`` are the unary scores of a good line; shorter chains are padded and masked.
    """
    n, most = len(scores), max(map(len, scores))
    mask = np.arange(most)[None] < np.array([len(s) for s in scores])[:, None]
    unary = np.zeros((n, most, 2))
    for i, s in enumerate(scores):
        unary[i, : len(s), 1] = s
    forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    forward[:, 0] = unary[:, 0]
    for t in range(1, most):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + chain, axis=1) + unary[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    for t in range(most - 2, -1, -1):
        step = np.logaddexp.reduce(chain + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
    log_z = np.logaddexp.reduce(forward[:, -1], axis=1)
    good = np.exp(forward[:, :, 1] + backward[:, :, 1] - log_z[:, None]) * mask
    joint = (
        forward[:, :-1, :, None] + chain + (unary[:, 1:] + backward[:, 1:])[:, :, None, :]
        - log_z[:, None, None, None]
    )
    pairs = (np.exp(joint) * mask[:, 1:, None, None]).sum(axis=(1,)) if most > 1 else np.zeros((n, 2, 2))
    return good, pairs, log_z, mask


def by_length(sizes: list[int]) -> Iterator[np.ndarray]:
    """Indexes of non-empty chains, similar lengths together."""
    order = [i for i in np.argsort(sizes, kind="stable") if sizes[i]]
    start = 0
    while start < len(order):
        # Fewer long chains at once, so that a batch stays small.
        end = start + max(1, min(TOGETHER, 200_000 // max(sizes[order[min(start + TOGETHER, len(order)) - 1]], 1)))
        yield np.array(order[start:end])
        start = end


def _tilted(scores: list[np.ndarray], weights: list[np.ndarray], tilt: np.ndarray, chain: np.ndarray):
    """Marginals and pair sums with ``tilt`` times its weight added to each line's score, and the shares."""
    good, pairs, _, mask = marginals([s + t * w for s, w, t in zip(scores, weights, tilt)], chain)
    share = np.array([g[: len(w)] @ w / w.sum() for g, w in zip(good, weights)])
    return good, pairs, mask, share


def expected_lines(
    scores: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, chain: np.ndarray, share: float
) -> tuple[np.ndarray, np.ndarray]:
    """``good`` marginals and pair sums nearest to the field's that give each document its share.

    Tilting each score by the line's weight is the projection; the least tilt that meets the
    share is found by halving. Documents that meet it already are not tilted.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    good, pairs, _, found = _tilted(scores, weights, np.zeros(len(scores)), chain)
    short = np.flatnonzero(np.where(labels == 1, found, 1 - found) < share)
    if len(short):
        some, their = [scores[i] for i in short], [weights[i] for i in short]
        low, high = np.zeros(len(short)), np.full(len(short), STEEPEST)
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            met = _tilted(some, their, sign[short] * middle, chain)[3]
            enough = np.where(labels[short] == 1, met, 1 - met) >= share
            high, low = np.where(enough, middle, high), np.where(enough, low, middle)
        tilted = _tilted(some, their, sign[short] * high, chain)
        good[short, : tilted[0].shape[1]], pairs[short] = tilted[0], tilted[1]
    return good, pairs


def fit_field(
    chains: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, settings: Settings
) -> Field:
    """Line labels as hidden, each document's label a bound on their length-weighted share.

    A document weighs the same whatever its number of lines.
    """
    prior = float(labels.mean()) if len(labels) else 0.5
    batches = list(by_length([len(c) for c in chains]))
    # The longest line of a document has weight 1.
    weights = [n / n.max() if len(n) else n for n in lengths]
    width = 3 * FEATURES + 1
    theta = np.zeros(width + 4)
    own = np.zeros(width + 4, bool)
    own[:FEATURES] = own[width - 1] = True
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(settings.rounds * settings.steps if batches else 0):
        grad = settings.decay * theta
        chain = theta[width:].reshape(2, 2)
        if step % settings.steps == 0:
            wanted = [
                expected_lines(
                    [chains[i] @ theta[:width] for i in batch], [weights[i] for i in batch],
                    labels[batch], chain, settings.share,
                )
                for batch in batches
            ]
        for batch, (target, joint) in zip(batches, wanted):
            scores = [chains[i] @ theta[:width] for i in batch]
            good, pairs, _, mask = marginals(scores, chain)
            lines = mask.sum(axis=1)
            weight = 1 / (lines * len(chains))
            error = (good - target) * mask * weight[:, None]
            stacked = np.concatenate([chains[i] for i in batch])
            grad[:width] += np.concatenate([e[:n] for e, n in zip(error, lines)]) @ stacked
            grad[width:] += ((pairs - joint) * weight[:, None, None]).sum(axis=0).ravel()
        if step < settings.alone * settings.steps:
            grad = np.where(own, grad, 0)
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad**2 - square)
        theta -= settings.rate * (mean / (1 - 0.9 ** (step + 1))) / (np.sqrt(square / (1 - 0.999 ** (step + 1))) + 1e-8)
    return Field(theta[:width], theta[width:].reshape(2, 2), prior)


def good_lines(texts: list[str | None], field: Field) -> list[tuple[np.ndarray, np.ndarray]]:
    """The probability that each line with more than white space is good, and its length, by text."""
    described = [line_features(t or "") for t in texts]
    out = [(np.zeros(0), lengths) for _, lengths in described]
    for batch in by_length([len(n) for _, n in described]):
        good = marginals([with_neighbours(described[i][0]) @ field.unary for i in batch], field.chain)[0]
        for i, row in zip(batch, good):
            out[i] = (row[: len(out[i][1])], out[i][1])
    return out


def quality(texts: list[str | None], field: Field) -> list[float]:
    """Length-weighted share of good lines of each text; the prior where there is no line."""
    return [
        float(min(max(good @ lengths / lengths.sum(), 0.0), 1.0)) if len(lengths) else field.prior
        for good, lengths in good_lines(texts, field)
    ]


def fit(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, training: Column,
    settings: Settings = Settings(),
) -> Field:
    """A field from at most ``settings.documents`` labelled rows for which ``training`` holds."""
    known = labels.filter(training & F.col(label).isNotNull() & F.col(key).isNotNull())
    # The limit bounds what is broadcast.
    asked = hashed_sample(known.select(key, F.col(label).cast("int").alias("label")), key, settings.documents)
    rows = docs.select(key, F.col(text).cast("string").alias("text")).join(F.broadcast(asked), key)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(t or "") for t in batch.column(1).to_pylist()]
            lines = pa.array([x.astype(np.float32).tobytes() for x, _ in found], pa.binary())
            lengths = pa.array([n.astype(np.int64).tobytes() for _, n in found], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lines, lengths], names=["label", "lines", "lengths"]
            )

    described = rows.select("label", "text").mapInArrow(describe, "label int, lines binary, lengths binary")
    chains, sizes, marks = [], [], []
    for row in described.toLocalIterator():
        chains.append(with_neighbours(np.frombuffer(row.lines, np.float32).reshape(-1, FEATURES).astype(float)))
        sizes.append(np.frombuffer(row.lengths, np.int64).astype(float))
        marks.append(int(row.label == 1))
    return fit_field(chains, sizes, np.array(marks, int), settings)


def line_labels(df: DataFrame, key: str, text: str, field: Field) -> DataFrame:
    """``key, line, n_chars, good``: each line that holds more than white space, numbered from 1
    among those of its text, and the probability that it is good.

    A null text and one of white space alone have no lines; null keys and repeated rows are
    kept; other columns are dropped; an empty table gives no rows.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = good_lines(batch.column(1).to_pylist(), field)
            at = np.repeat(np.arange(len(found)), [len(n) for _, n in found])
            taken = batch.take(pa.array(at, pa.int64()))
            number = [i for _, n in found for i in range(1, len(n) + 1)]
            size = [int(c) for _, n in found for c in n]
            good = [float(g) for marks, _ in found for g in marks]
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), pa.array(number, pa.int32()), pa.array(size, pa.int64()), pa.array(good, pa.float64())],
                names=["key", "line", "n_chars", "good"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    lines = rows.mapInArrow(run, f"key {key_type}, line int, n_chars long, good double")
    return lines.withColumnRenamed("key", key)


def score(df: DataFrame, key: str, text: str, field: Field) -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every row.

    A null text, or one of white space alone, has the good share of the training rows;
    null keys and repeated rows are kept; other columns are dropped; an empty table gives
    no rows.
    """
    schema = f"key {df.schema[key].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = quality(batch.column(1).to_pylist(), field)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"]
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
