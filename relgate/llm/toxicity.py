"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are used. With the class prior p, the
risk of a classifier f on the negatives is estimated from unlabelled text less the part
that the positives contribute, and held at zero or above, so that a flexible model cannot
drive it below zero by learning the unlabelled rows by heart:

    p R_pos(f, +1) + max(0, R_unl(f, -1) - p R_pos(f, -1))
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgate.llm.common import hashed_sample, worker_cache

LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``unlabelled`` bound the sample of rows that the model is fitted on."""

    positives: int = 2000
    unlabelled: int = 4000
    least_documents: int = 3
    least_excess: float = 4.0
    vocabulary: int = 20_000
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-2
    least_weight: float = 0.02


#: Leading letters that words of one origin share, and the words a worker remembers.
STEMS = (4, 5, 6)
CACHED_WORDS = 100_000


@dataclass
class Model:
    """A linear score of the distinct words and word stems of a text."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -5.0
    cache: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        cache, found = self.cache, set()
        for word in set(words(text)):
            known = cache.get(word)
            if known is None:
                known = tuple(f for f in features(word) if f in self.weights)
                if len(cache) < CACHED_WORDS and len(word) <= 64:
                    cache[word] = known
            found.update(known)
        total = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(-min(max(total, -500), 500)))


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word, and its stems marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


@dataclass
class Numbered:
    """Documents as the sorted numbers of their features: far smaller than sets of words."""

    number: dict[str, int] = field(default_factory=dict)
    by_word: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def of(self, doc: Iterable[str]) -> np.ndarray:
        found: set[int] = set()
        for word in doc:
            known = self.by_word.get(word)
            if known is None:
                known = [self.number.setdefault(f, len(self.number)) for f in features(word)]
                self.by_word[word] = known
            found.update(known)
        return np.array(sorted(found), np.int32)


def risk_and_gradient(
    theta: np.ndarray, positive: tuple, unlabelled: tuple, prior: float
) -> tuple[float, float, np.ndarray]:
    """Risk of the positives, that of the negatives, and the gradient of the non-negative risk.

    A side is the features and the rows they stand in, and the number of rows. Where the
    negatives' risk is below zero, the gradient is that of its ascent alone.
    """
    (pi, pr, n_pos), (ui, ur, n_unl), v = positive, unlabelled, len(theta) - 1
    f_pos = np.bincount(pr, theta[pi], n_pos) + theta[v]
    f_unl = np.bincount(ur, theta[ui], n_unl) + theta[v]
    s_pos, s_unl = 0.5 + 0.5 * np.tanh(f_pos / 2), 0.5 + 0.5 * np.tanh(f_unl / 2)
    negative = np.logaddexp(0, f_unl).mean() - prior * np.logaddexp(0, f_pos).mean()
    sign = 1.0 if negative >= 0 else -1.0
    g_pos = (prior * (s_pos - 1) * (sign > 0) - sign * prior * s_pos) / n_pos
    g_unl = sign * s_unl / n_unl
    grad = np.append(
        np.bincount(pi, g_pos[pr], v) + np.bincount(ui, g_unl[ur], v), g_pos.sum() + g_unl.sum()
    )
    return prior * np.logaddexp(0, -f_pos).mean(), negative, grad


def fit_weights(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], numbered: Numbered, prior: float, settings: Settings
) -> Model:
    """Minimises the non-negative risk with logistic loss, by Adam on all rows at once."""
    if not positive or not unlabelled:
        return Model()
    names = list(numbered.number)
    in_pos = np.bincount(np.concatenate(positive), minlength=len(names))
    in_unl = np.bincount(np.concatenate(unlabelled), minlength=len(names))
    df_pos = {names[i]: (int(in_pos[i]), int(in_unl[i])) for i in np.flatnonzero(in_pos >= settings.least_documents)}

    def excess(w: str) -> float:
        """By how many standard errors the feature is commoner in toxic than in unlabelled text."""
        a, b = df_pos[w][0] / len(positive), df_pos[w][1] / len(unlabelled)
        spread = max(b, 1 / len(unlabelled)) * (1 / len(positive) + 1 / len(unlabelled))
        return (a - b) / spread**0.5

    scored = [(-excess(w), w) for w in df_pos]
    chosen = sorted(x for x in scored if -x[0] >= settings.least_excess)[: settings.vocabulary]
    vocabulary = {w: i for i, (_, w) in enumerate(chosen)}
    if not vocabulary:
        return Model()

    place = np.full(len(names), -1)
    place[[numbered.number[w] for w in vocabulary]] = np.arange(len(vocabulary))

    def rows(docs):
        found = [place[doc][place[doc] >= 0] for doc in docs]
        return np.concatenate(found), np.repeat(np.arange(len(docs)), [len(f) for f in found]), len(docs)

    pos, unl, v = rows(positive), rows(unlabelled), len(vocabulary)
    theta = np.zeros(v + 1)
    theta[v] = np.log(prior / (1 - prior))
    mean, square = np.zeros(v + 1), np.zeros(v + 1)
    for step in range(1, settings.steps + 1):
        grad = risk_and_gradient(theta, pos, unl, prior)[2]
        grad[:v] += settings.decay * prior * theta[:v]
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad**2 - square)
        theta -= settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    kept = {w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) >= settings.least_weight}
    return Model(kept, float(theta[v]))


def fit(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, training: Column,
    prior: float | None = None, settings: Settings = Settings(),
) -> Model:
    """A model from the rows for which ``training`` holds.

    The prior, if not given, is the toxic share of the labelled training rows. Without a
    confirmed toxic training row every text scores near 0.
    """
    known = labels.filter(training & F.col(label).isNotNull() & F.col(key).isNotNull())
    positive_ids = hashed_sample(known.filter(F.col(label) == 1).select(key), key, settings.positives)
    unlabelled_ids = hashed_sample(
        docs.filter(training & F.col(key).isNotNull()).select(key), key, settings.unlabelled
    )
    asked = positive_ids.withColumn("positive", F.lit(True)).unionByName(
        unlabelled_ids.withColumn("positive", F.lit(False))
    )
    # At most positives + unlabelled ids, by the two limits above.
    rows = docs.select(key, F.col(text).cast("string").alias("text")).join(F.broadcast(asked), key)
    if prior is None:
        share = known.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
        prior = min(max(share or 0.0, 1e-3), 0.5)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(set(words(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.string()))], names=["positive", "words"]
            )

    bagged = rows.select("positive", "text").mapInArrow(bags, "positive boolean, words array<string>")
    sides: dict[bool, list[np.ndarray]] = {True: [], False: []}
    numbered = Numbered()
    for row in bagged.toLocalIterator():
        sides[row.positive].append(numbered.of(row.words))
    return fit_weights(sides[True], sides[False], numbered, prior, settings)


def score_column(text: str, model: Model) -> Column:
    """The score of a text column, beside the other columns of its row."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        worker_cache("toxicity", dict)  # the model remembers words itself, as long as its task runs
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scores(F.col(text).cast("string"))


def score(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every row.

    A null or empty text has the score of the bias; null keys and repeated rows are kept;
    other columns are dropped; an empty table gives no rows.
    """
    return df.select(key, score_column(text, model).alias("score"))
