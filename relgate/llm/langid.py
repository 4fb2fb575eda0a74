"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs, drawn from its code point. An n-gram is the
product of its letters' vectors, each rotated by its place; a text is the sum of its
n-grams; a language is the sum of its texts; and a text is of the language whose vector has
the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMENSIONS = 1024
GRAM = 3
#: N-gram vectors that a worker remembers.
CACHED_GRAMS = 100_000


@cache
def _letters() -> np.ndarray:
    """Code point of the lower-case letter for each code point; 0 where there is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            lower = c.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


@cache
def _letter_vector(code: int) -> np.ndarray:
    bits = np.random.default_rng([7, code]).integers(0, 2, DIMENSIONS)
    return (2 * bits - 1).astype(np.int8)


class _Grams:
    """Rows of a growing matrix of n-gram vectors, by n-gram; a bounded cache."""

    def __init__(self):
        self.row: dict[int, int] = {}
        self.matrix = np.empty((1024, DIMENSIONS), np.float32)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        if len(self.row) + len(grams) > CACHED_GRAMS and self.row:
            self.__init__()
        out = np.empty(len(grams), np.int64)
        for i, gram in enumerate(grams.tolist()):
            row = self.row.get(gram)
            if row is None:
                row = self.row[gram] = len(self.row)
                if row >= len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
                value = np.ones(DIMENSIONS, np.int8)
                for place in range(GRAM):
                    code = gram >> 21 * (GRAM - 1 - place) & 0x1FFFFF
                    value = value * np.roll(_letter_vector(code), GRAM - 1 - place)
                self.matrix[row] = value
            out[i] = row
        return out

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS)
        for part in range(0, len(grams), 4096):
            rows = self.rows(grams[part : part + 4096])
            total += counts[part : part + 4096].astype(np.float32) @ self.matrix[rows]
        return total


@cache
def _grams() -> _Grams:
    return _Grams()


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and their counts.

    Letters are lower-cased; whatever stands between letters is one boundary, as is either
    end of the text. A text without letters has no n-grams.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _letters()[codes].astype(np.int64)
    keep = (found > 0) | (np.append(found[1:], 1) > 0)  # the last of each run that is no letter
    found = np.concatenate([[0], found[keep], [0]])
    if not found.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = found[:-2] << 42 | found[1:-1] << 21 | found[2:]
    return np.unique(grams, return_counts=True)


@dataclass(frozen=True)
class Profiles:
    """One unit vector per language, by name."""

    names: list[str]
    vectors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        vector = _grams().bundle(grams, counts)
        cosines = self.vectors @ (vector / (np.linalg.norm(vector) or 1.0))
        best = int(np.argmax(cosines))
        return self.names[best], float(min(max(cosines[best], 0.0), 1.0))


def fit(docs: DataFrame, text: str, lang: str, training: Column) -> Profiles:
    """Profiles from all rows for which ``training`` holds and the language is known.

    Every task bundles its n-grams by language; a task's few vectors are added up in two
    steps, so that no task reads more than a share of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            counts: dict[str, tuple[list, list]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for side, values in zip(counts.setdefault(name, ([], [])), ngrams(t)):
                    side.append(values)
            for name, (grams, times) in counts.items():
                distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
                summed = np.bincount(at, np.concatenate(times), len(distinct))
                sums[name] = sums.get(name, 0) + _grams().bundle(distinct, summed)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            names=["lang", "vector"],
        )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.float64) for v in group["vector"])
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "vector": [total.tobytes()]})

    rows = docs.filter(training & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    schema = "lang string, vector binary"
    parts = rows.mapInArrow(run, schema).withColumn("part", F.spark_partition_id() % 64)
    sums = parts.groupBy("lang", "part").applyInPandas(add, schema).groupBy("lang").applyInPandas(add, schema)
    names, vectors = [], []
    for row in sums.orderBy("lang").collect():  # one vector per language
        vector = np.frombuffer(row.vector, np.float64)
        if norm := np.linalg.norm(vector):
            names.append(row.lang)
            vectors.append(vector / norm)
    return Profiles(names, np.array(vectors))


def predict(df: DataFrame, key: str, text: str, profiles: Profiles) -> DataFrame:
    """``key, lang_pred, score`` of every row; the score is the cosine, 0 at least.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if no
    language is known; equal cosines go to the first language by name; null keys and
    repeated rows are kept; other columns are dropped; an empty table gives no rows.
    """
    schema = f"key {df.schema[key].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                names=["key", "lang_pred", "score"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
