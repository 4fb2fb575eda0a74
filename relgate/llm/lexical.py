"""Ranked lexical search by branch and bound over FP-trees of documents.

The terms of the searched items, most frequent first, are the order of all vectors: a
document is the sequence of those of them that it holds. Documents of a block, sorted by
these sequences, form a trie in which equal beginnings share a path. A node knows, of all
documents below it, the most occurrences of each term and the smallest length norm ``m``;
both together bound the score of any of them. Each item descends depth first, best bound
first, and leaves what cannot come among its best.

Blocks are bounded, are searched where their documents lie, and lend each other the score
to beat. A task gives at most ``k`` documents per item, and these meet in two rounds.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heapreplace
from itertools import repeat
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relgate.llm.common import written
from relgate.operators.skew import join_key_stats
from relgate.session import scratch_path

#: What a term is made of: ASCII letters and digits, and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of the items that are searched together, about; more items take further passes.
ITEM_TERMS = 16_384
#: Documents, and entries of their vectors, that form one tree.
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1_000_000
#: Documents below which a node is not divided but scored.
LEAF = 32
#: Bytes of a text that are cut into terms at once.
SEGMENT = 1 << 22
#: Tasks whose best documents meet in the first round.
TASKS = 512

#: Lower-cases A-Z and makes a blank of every ASCII character that is no letter or digit.
_PLAIN = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 if b < 128 else b for b in range(256)
)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in runs."""
    plain, start = text.translate(_PLAIN), 0
    while start < len(plain):
        stop = plain.find(b" ", start + SEGMENT)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


@dataclass(frozen=True)
class Search:
    """What tasks need of the items and the corpus. Ranks: 0 is the most frequent term."""

    rank_of: np.ndarray  # of a term's code
    weights: np.ndarray  # of a rank
    items: list[np.ndarray]  # ranks of each item's terms
    documents: int
    length: int
    k: int

    def norms(self, n: np.ndarray) -> np.ndarray:
        """``m`` of documents with ``n`` terms."""
        if 50 * int(n.max(initial=0)) * self.documents >= 1 << 63:
            return np.array([50 + 50 * int(x) * self.documents // self.length for x in n], np.int64)
        return 50 + 50 * n * self.documents // self.length


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of its weight, in millionths: it rises with ``tf`` and falls with ``m``."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``key, n, codes, tf``: the terms of each document that some item holds, and all it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        for batch in batches:
            n, codes, counts = [], [], []
            for text in batch.column(1):
                total, found = 0, []
                for terms in terms_of(text.as_py() or b""):
                    total += len(terms)
                    run_codes = np.fromiter(map(vocabulary.get, terms, repeat(size)), np.int32, len(terms))
                    found.append(run_codes[run_codes < size])
                held, tf = np.unique(np.concatenate(found or [np.empty(0, np.int32)]), return_counts=True)
                n.append(total)
                codes.append(held)
                counts.append(tf.astype(np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
            flat = [np.concatenate(x) if x else np.empty(0, np.int32) for x in (codes, counts)]
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, pa.int32())) for x in flat]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *lists], names=["key", "n", "codes", "tf"]
            )

    return docs.mapInArrow(run, "key long, n long, codes array<int>, tf array<int>")


class Tree:
    """The FP-tree of a block of documents.

    ``starts`` parts ``ranks`` and ``tf`` (ascending ranks) by document. Documents are kept in
    the order of their sequences; a node is a range of them.
    """

    def __init__(self, starts: np.ndarray, ranks: np.ndarray, tf: np.ndarray, m: np.ndarray, terms: int):
        paths = ranks.astype(">u4").tobytes()
        path = [paths[4 * a : 4 * b] for a, b in zip(starts[:-1], starts[1:])]
        self.order = np.array(sorted(range(len(path)), key=path.__getitem__), np.int64)
        self.path = [path[i] for i in self.order]
        sizes = np.diff(starts)[self.order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        entries = np.arange(len(ranks)) + np.repeat(starts[:-1][self.order] - self.starts[:-1], sizes)
        self.ranks, tf, self.m = ranks[entries], tf[entries], m[self.order]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.shares = saturated(tf, self.m[owner])
        self.children: list[list[int]] = []
        self.range: list[tuple[int, int]] = []
        parents = self._grow()
        leaf_of = np.empty(len(sizes), np.int64)
        most = np.zeros((len(self.range), terms), np.int32)
        least = np.full(len(self.range), np.iinfo(np.int64).max)
        for node, (low, high) in enumerate(self.range):
            if not self.children[node]:
                leaf_of[low:high] = node
                least[node] = self.m[low:high].min()
        np.maximum.at(most, (leaf_of[owner], self.ranks), tf)
        for node in range(len(self.range) - 1, 0, -1):  # children come after their parents
            np.maximum(most[parents[node]], most[node], out=most[parents[node]])
            least[parents[node]] = min(least[parents[node]], least[node])
        #: By rank and node, the most that a document below can have of the term's weight.
        self.bounds = np.ascontiguousarray(saturated(most, least[:, None]).T)

    def _grow(self) -> list[int]:
        """Makes the nodes, the root first; returns the parent of each."""
        parents, self.children, self.range = [-1], [[]], [(0, len(self.path))]
        todo = [0]
        while todo:
            node = todo.pop()
            for low, high, divided in self._parts(*self.range[node]):
                child = len(self.range)
                parents.append(node)
                self.children.append([])
                self.range.append((low, high))
                self.children[node].append(child)
                if divided:
                    todo.append(child)
        return parents

    def _parts(self, low: int, high: int) -> Iterator[tuple[int, int, bool]]:
        """The subtrees below a node: those of one next term, small neighbours taken together."""
        if high - low <= LEAF:
            return
        shared = len(commonprefix([self.path[low], self.path[high - 1]])) // 4 * 4
        start = at = low
        while at < high:
            branch = self.path[at][shared : shared + 4]
            if branch:
                after = self.path[at][:shared] + (int.from_bytes(branch, "big") + 1).to_bytes(4, "big")
                stop = bisect_left(self.path, after, at, high)
            else:  # paths that end here are equal, and come first
                stop = bisect_left(self.path, self.path[at] + bytes(4), at, high)
            if stop - at > LEAF:
                if at > start:
                    yield start, at, False
                if branch:
                    yield at, stop, True
                else:
                    yield from ((i, min(i + LEAF, stop), False) for i in range(at, stop, LEAF))
                start = stop
            elif stop - start > LEAF:
                yield start, at, False
                start = at
            at = stop
        if start < high:
            yield start, high, False

    def search(self, item: np.ndarray, weights: np.ndarray, best: list, k: int, keys: list) -> int:
        """Puts the item's best documents into the heap ``best``; returns how many were scored."""
        bounds = weights[item] @ self.bounds[item]
        own = np.zeros(len(weights), np.int64)
        own[item] = weights[item]
        scored, todo = 0, [0]
        while todo:
            node = todo.pop()
            floor = best[0][0] if len(best) == k else 1
            if bounds[node] < floor:
                continue
            if self.children[node]:
                todo += sorted((c for c in self.children[node] if bounds[c] >= floor), key=bounds.__getitem__)
                continue
            low, high = self.range[node]
            scored += high - low
            first, last = self.starts[low], self.starts[high]
            sums = np.concatenate([[0], np.cumsum(own[self.ranks[first:last]] * self.shares[first:last])])
            scores = np.diff(sums[self.starts[low : high + 1] - first])
            for at in np.flatnonzero(scores >= floor):
                key = keys[self.order[low + at]]
                # Of equal scores the smaller key is better, and a null is the worst.
                entry = (int(scores[at]), key is not None, -(key or 0))
                if len(best) < k:
                    heappush(best, entry)
                elif entry > best[0]:
                    heapreplace(best, entry)
        return scored


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Keys, lengths, starts, codes and occurrences of bounded numbers of documents."""
    for batch in batches:
        keys, n = batch.column(0).to_pylist(), np.asarray(batch.column(1))
        offsets = np.asarray(batch.column(2).offsets).astype(np.int64)
        offsets = offsets - offsets[0]
        codes, tf = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten())
        start = 0
        while start < len(keys):
            stop = int(np.searchsorted(offsets, offsets[start] + BLOCK_ENTRIES, "right")) - 1
            stop = min(max(stop, start + 1), start + BLOCK_DOCS, len(keys))
            a, b = offsets[start], offsets[stop]
            yield keys[start:stop], n[start:stop], offsets[start : stop + 1] - a, codes[a:b], tf[a:b]
            start = stop


def _found(vectors: DataFrame, search: Search) -> DataFrame:
    """``item, task, score, key``: the best documents of each task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in search.items]
        for keys, n, starts, codes, tf in _blocks(batches):
            ranks = search.rank_of[codes]
            owner = np.repeat(np.arange(len(keys)), np.diff(starts))
            order = np.lexsort((ranks, owner))
            tree = Tree(starts, ranks[order], tf[order], search.norms(n), len(search.weights))
            for item, heap in zip(search.items, best):
                tree.search(item, search.weights, heap, search.k, keys)
        rows = [(i, score, -key if known else None) for i, heap in enumerate(best) for score, known, key in heap]
        task = TaskContext.get().partitionId()
        columns = [[r[0] for r in rows], [task] * len(rows), [r[1] for r in rows], [r[2] for r in rows]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["item", "task", "score", "key"]
        )

    return vectors.filter(F.size("codes") > 0).mapInArrow(run, "item long, task long, score long, key long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``item, rank, score, key``: the best ``k`` of each item, met in groups of tasks first."""
    order = [F.desc("score"), F.asc_nulls_last("key")]
    some = Window.partitionBy("item", F.floor(F.col("task") / TASKS)).orderBy(*order)
    fewer = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return fewer.withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "rank", "score", "key")


def _searched(docs: DataFrame, texts: list[bytes], k: int) -> DataFrame:
    """The best documents of each of some texts, by its index."""
    spark = docs.sparkSession
    held = [sorted({t for run in terms_of(text) for t in run}) for text in texts]
    vocabulary = {term: code for code, term in enumerate(sorted({t for terms in held for t in terms}))}
    vectors = written(_vectors(docs, vocabulary), "vectors")
    documents, length = vectors.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    # One row per term of the searched texts.
    holders = np.zeros(len(vocabulary), np.int64)
    for code, count in vectors.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
        holders[code] = count
    order = np.lexsort((np.arange(len(holders)), -holders))
    rank_of = np.empty(len(holders), np.int64)
    rank_of[order] = np.arange(len(holders))
    weights = np.array([weight(documents, int(h)) for h in holders[order]], np.int64)
    items = [np.sort(rank_of[[vocabulary[t] for t in terms]]) for terms in held if terms]
    search = Search(rank_of, weights, items, documents, length or 1, k)
    numbers = [i for i, terms in enumerate(held) if terms]
    found = _ranked(_found(vectors, search), k)
    named = spark.createDataFrame(list(enumerate(numbers)), "item long, number long")
    return found.join(F.broadcast(named), "item").select("number", "rank", "score", "key")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def ranked_search(
    docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, k: int = 50
) -> DataFrame:
    """``item, rank, key, score``: the ``k`` documents of the highest score above 0 for each item.

    Equal scores rank by ascending key, null keys last; each row of ``docs`` is a document, so
    a repeated key can come twice. Null texts have no terms. Each row of ``items`` gets its own
    list, those that repeat an item too; an item without a hit has no rows; other columns are dropped.

    Equal item texts are searched once. Texts are searched in blocks of some ``ITEM_TERMS``
    terms, each in one pass over the documents; only one block is on the driver at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text"))
    asked = asked.withColumn("digest", _digest(F.col("text")))
    texts = asked.filter("text is not null").groupBy("digest").agg(F.any_value("text").alias("text"))
    texts = written(texts.withColumn("terms", F.regexp_count("text", F.lit(TERM))), "items")
    blocks = math.ceil((texts.agg(F.sum("terms")).first()[0] or 0) / ITEM_TERMS)
    path = scratch_path(spark, "found")
    for block in range(max(1, blocks)):
        chosen = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(max(1, blocks))) == block)
        some = chosen.select("digest", F.col("text").cast("binary")).orderBy("digest").collect()
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(some)], "number long, digest string")
        found = _searched(rows, [bytes(r[1]) for r in some], k).join(F.broadcast(names), "number")
        listed = found.groupBy("digest").agg(F.collect_list(F.struct("rank", "key", "score")).alias("list"))  # k at most
        listed.write.mode("append").option("compression", "zstd").parquet(path)
    lists = asked.groupBy("digest").agg(F.count("*").alias("rows")).join(spark.read.parquet(path), "digest")
    answered = join_key_stats(asked.select("item", "digest"), lists, "digest", "rows").select("item", F.explode("list").alias("l"))
    return answered.select(
        F.col("item").alias(item), F.col("l.rank").cast("int").alias("rank"), F.col("l.key").alias(key), F.col("l.score").alias("score")
    )
