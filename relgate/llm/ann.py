"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then kept at its leaf. A query
walks the tree best bin first: a priority queue holds the branches not taken yet by their
distance, and the nearest one is opened next. How many leaves it visits is calibrated on
sampled queries against brute force.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgate.llm.common import written
from relgate.llm.vectors import distances, kmeans, matrix, sample, usable

SAMPLE_ROWS = 20_000
BRANCHES = 8
LEAF_ROWS = 160
CALIBRATION = 200
#: Rows of a leaf that a task searches at once; a larger leaf is dealt into blocks.
BLOCK = 4096


@dataclass(frozen=True)
class Tree:
    """``centres[i]`` are the centres of node i's children ``children[i]``; a negative child
    ``-1 - leaf`` is a leaf."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaves: int
    visits: int

    def walk(self, query: np.ndarray, rows: list[int], least: int) -> list[int]:
        """Leaves, best bin first: ``visits`` of them, and on until they hold ``least`` rows."""
        queue, ticket, out, held = [(0.0, 0, 0)], 1, [], 0
        while queue and (len(out) < self.visits or held < least):
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                held += rows[-1 - node]
                continue
            d = ((self.centres[node] - query) ** 2).sum(axis=1)
            for distance, child in zip(d.tolist(), self.children[node]):
                heapq.heappush(queue, (distance, ticket, child))
                ticket += 1
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches by the nearest centre at every node."""
        node = np.zeros(len(x), int)
        while (inner := np.unique(node[node >= 0])).size:
            for n in inner:
                here = np.flatnonzero(node == n)
                near = distances(x[here], self.centres[n]).argmin(axis=1)
                node[here] = np.array(self.children[n])[near]
        return -1 - node


def grow(x: np.ndarray, branches: int, leaf_rows: int) -> Tree:
    """A tree over the sample: a node with more than ``leaf_rows`` distinct rows is split."""
    centres, children, leaves = [], [], 0
    centres.append(np.empty((0, x.shape[1])))
    children.append([])
    todo = [(0, np.unique(x, axis=0))]
    while todo:
        node, part = todo.pop()
        centres[node] = kmeans(part, branches if len(part) > leaf_rows else 1, node)
        near = distances(part, centres[node]).argmin(axis=1)
        for c in range(len(centres[node])):
            inside = part[near == c]
            if leaf_rows < len(inside) < len(part):
                centres.append(np.empty((0, x.shape[1])))
                children.append([])
                children[node].append(len(centres) - 1)
                todo.append((len(centres) - 1, inside))
            else:
                children[node].append(-1 - leaves)
                leaves += 1
    return Tree(centres, children, leaves, leaves)


def calibrated(tree: Tree, x: np.ndarray, k: int, recall: float, queries: int) -> Tree:
    """The tree with the fewest leaf visits that find ``recall`` of the sample's neighbours.

    The sample is sparser than the table, so its neighbours are farther away and the visits
    rather too many than too few.
    """
    picked = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    leaf, needed = tree.leaf_of(x), []
    whole = Tree(tree.centres, tree.children, tree.leaves, tree.leaves)
    for i in picked:
        d = distances(x[[i]], x)[0]
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        order = np.empty(tree.leaves, int)
        order[whole.walk(x[i], [1] * tree.leaves, 0)] = np.arange(1, tree.leaves + 1)
        needed += order[leaf[near]].tolist()
    visits = int(np.ceil(np.quantile(needed, recall))) if needed else tree.leaves
    return Tree(tree.centres, tree.children, tree.leaves, visits)


def nearest(
    df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, recall: float = 0.97,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows of ``df`` found per query.

    ``score`` is the Euclidean distance; ties go to the smaller key; fewer rows are returned
    if there are fewer candidates. Vectors that are null, empty, zero or not finite, and
    rows with a null key take no part; a vector is near to those of its own length only, and
    each length has its own tree; a query's own key is no candidate; rows that repeat a
    query's key search once for each distinct vector and share the ranks; an empty table
    gives no rows.
    """

    def prepared(rows: DataFrame) -> DataFrame:
        v = F.transform(vector, lambda x: x.cast("double")).alias("v")
        return rows.select(F.col(key).cast("long").alias("id"), v).filter(usable("v") & F.col("id").isNotNull())

    schema = "query_id long, rank int, vec_id long, score double"
    base = prepared(df)
    asked = prepared(queries).distinct()
    # Lengths are a property of the models that made the vectors: a few.
    widths = sorted(row.w for row in base.select(F.size("v").alias("w")).distinct().collect())
    if not widths:
        return df.sparkSession.createDataFrame([], schema)
    hits = [
        _found(base.filter(F.size("v") == w), asked.filter(F.size("v") == w), k, recall, sample_rows) for w in widths
    ]
    best = reduce(DataFrame.unionByName, hits).groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best")
    )
    return best.select("query_id", F.posexplode("best").alias("pos", "hit")).select(
        "query_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )


def _found(base: DataFrame, asked: DataFrame, k: int, recall: float, sample_rows: int) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` nearest of each visited leaf, for vectors of one length."""
    x = sample(base, "id", "v", sample_rows)
    tree = calibrated(grow(x, BRANCHES, LEAF_ROWS), x, k, recall, CALIBRATION)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaf_of(matrix(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaf, pa.int32())], names=["id", "v", "leaf"]
                )

    kept = written(base.mapInArrow(keep, "id long, v array<double>, leaf int"), "leaves")
    held = [0] * tree.leaves
    for row in kept.groupBy("leaf").count().collect():  # one row per leaf of the bounded tree
        held[row.leaf] = row["count"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, leaves = [], []
                for i, q in enumerate(matrix(batch.column(1).to_pylist())):
                    # One more than k: the query's own row may be among them.
                    found = [n for n in tree.walk(q, held, k + 1) if held[n]]
                    at += [i] * len(found)
                    leaves += found
                taken = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(leaves, pa.int32())], names=["query_id", "q", "leaf"]
                )

    asked = asked.mapInArrow(search, "query_id long, q array<double>, leaf int")
    # Large leaves are searched in blocks; the counts are those of the bounded tree.
    blocks = F.element_at(F.array(*[F.lit(-(-n // BLOCK) or 1) for n in held]), F.col("leaf") + 1)
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))

    def compare(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows):
            ids, y = rows["id"].to_numpy(), matrix(list(rows["v"]))
            for query_id, q in zip(asking["query_id"], asking["q"]):
                score = np.sqrt(((y - np.asarray(q)) ** 2).sum(axis=1))
                score[ids == query_id] = np.inf
                best = np.lexsort((ids, score))[:k] if len(ids) <= 4 * k else _smallest(score, ids, k)
                best = best[np.isfinite(score[best])]
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return (
        asked.groupBy("leaf", "block")
        .cogroup(dealt.groupBy("leaf", "block"))
        .applyInPandas(compare, "query_id long, vec_id long, score double")
    )


def _smallest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest by (score, id), all ties with the last one considered."""
    limit = np.partition(score, k - 1)[k - 1]
    near = np.flatnonzero(score <= limit)
    return near[np.lexsort((ids[near], score[near]))[:k]]
