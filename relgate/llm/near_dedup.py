"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one class. Class signatures are read in several
orders, the trees; in a tree, classes that share a prefix of the order form a region, and a
region with too many classes is taken at a greater depth. In each region the neighbours in
sorted order, which share the longest prefixes, and the region's first class are the
candidates. Candidates are confirmed on full shingle sets.

The forest is searched in rounds: first two trees, then all, then all with more neighbours
and with every pair of a region. A pair that earlier links connect already is not taken
again, as it cannot change a component; so a large group costs each class a few pairs.

Regions of more classes than a region holds are not searched whole. Their classes, the
crowded ones, are joined exactly at the end: by the prefix filter on their rarest shingles,
with bounds on sizes and positions, for every pair that is not connected by then.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgate.llm.common import pieces, worker_cache, written
from relgate.llm.components import components
from relgate.operators.skew import join_key_stats

SIGNATURE = 128
TREES = 10
#: Values of a tree's order that a region shares: the first depth, and the deeper ones for
#: regions that would hold more than ``REGION`` classes.
DEPTHS = (3, 6, 12, 24)
REGION = 128
#: Trees, and neighbours before a class in sorted order, of each round of the search.
ROUNDS = ((2, 1), (TREES, 1), (TREES, 4))
#: A pair whose signatures agree in fewer places than this share has a similarity of 0.8 or
#: more with a probability below 1e-5 (128 places, 4.4 standard deviations).
SIGNATURE_FLOOR = 0.64
#: Shingles of the sets of a block, about, in the exact join.
BLOCK_SHINGLES = 16_384
#: Shingles of a component's sets, and sets that hold one shingle, from which they are spread over tasks.
HOT_SHINGLES, HOT_POSTING = 65_536, 512
CACHED_WORDS = 400_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    Letters A-Z are lower-cased, words part at blanks and ASCII white space; a text of fewer
    words is one shingle, a text without words has none.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    known = worker_cache("near_dedup", _WordHashes)
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    value = np.full(n, width, np.uint64)
    for i in range(width):
        value = _mixed(value * _MIX[0] + hashes[i : i + n])
    return np.unique(value)


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229).integers(1, 1 << 63, (2, SIGNATURE), np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each of the permutations, the upper half of the smallest permuted hash."""
    a, b = _permutations()
    low = np.full(SIGNATURE, ~np.uint64(0))
    for part in range(0, len(shingles), 2048):
        permuted = shingles[None, part : part + 2048] * a[:, None] + b[:, None]
        low = np.minimum(low, permuted.min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _described(docs: DataFrame, words: int) -> DataFrame:
    """``id, n_shingles, digest, sig`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, digests, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, words)
                sizes.append(len(found))
                digests.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sigs, pa.binary()),
                ],
                names=["id", "n_shingles", "digest", "sig"],
            )

    return docs.mapInArrow(run, "id long, n_shingles long, digest binary, sig binary")


def _prefixes(classes: DataFrame) -> DataFrame:
    """One row per class and tree: hashes of the prefixes of its order, and the order's rest."""
    fields = ", ".join(f"k{d} long" for d in DEPTHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = SIGNATURE // TREES
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, SIGNATURE)
            doubled = np.concatenate([sigs, sigs], axis=1)
            for tree in range(TREES):
                order = doubled[:, tree * step : tree * step + DEPTHS[-1]]
                value, keys = np.full(n, tree + 1, np.uint64), []
                for d in range(DEPTHS[-1]):
                    value = _mixed(value * _MIX[0] + order[:, d])
                    if d + 1 in DEPTHS:
                        keys.append(pa.array(value.view(np.int64)))
                rest = order[:, DEPTHS[0] : DEPTHS[0] + 6].astype(">u4").tobytes()
                rest = [rest[i : i + 24] for i in range(0, len(rest), 24)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, tree, np.int32)), *keys, pa.array(rest, pa.binary())],
                    names=["id", "tree", *(f"k{d}" for d in DEPTHS), "rest"],
                )

    return classes.select("id", "sig").mapInArrow(run, f"id long, tree int, {fields}, rest binary")


def _regions(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``tree, region, above, first, id, rest``: regions of 2 to ``REGION`` classes.

    A larger region is left for the next depth. Its ``head``, the smallest id, stays known
    there, so that its parts are still compared through it. What is too large at the last
    depth agrees in 24 values of the order and is dealt into parts, in each tree by another
    hash of the id. Second, the ``id``
    of each class of a larger region, for the exact join; None if there is none.
    """
    crowded = None
    found, rows = [], _prefixes(classes).withColumn("above", F.lit(None).cast("long"))
    for depth in DEPTHS:
        key = f"k{depth}"
        sizes = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("first"))
        if depth == DEPTHS[0]:
            sizes = sizes.filter("n > 1")  # deeper, one that is alone still has the head above
        known = written(rows.join(sizes, key), "regions")
        head = F.coalesce("above", "first")
        found.append(
            known.filter(F.col("n") <= REGION).select("tree", F.col(key).alias("region"), "above", "first", "id", "rest")
        )
        rows = known.filter(F.col("n") > REGION).withColumn("above", head).drop("first")
        if depth != DEPTHS[-1]:
            rows = rows.drop("n")
            if rows.isEmpty():
                break
        if crowded is None:  # whatever is too large deeper has been too large here
            crowded = rows.select("id").distinct()
    else:
        part = F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / REGION))
        dealt = rows.withColumn("region", F.xxhash64(key, part))
        firsts = dealt.groupBy("region").agg(F.min("id").alias("first"))
        found.append(dealt.join(firsts, "region").select("tree", "region", "above", "first", "id", "rest"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return written(out, "regions"), crowded if crowded is None else written(crowded, "crowded")


def _named(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``regions`` with the component of each class and of the head above."""
    if labels is None:
        return regions.withColumn("component", F.col("id")).withColumn("c_above", F.col("above"))
    known = regions.join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = known.join(labels.select(F.col("node").alias("above"), F.col("component").alias("c_above")), "above", "left")
    return known.withColumns(
        {"component": F.coalesce("component", "id"), "c_above": F.coalesce("c_above", "above")}
    )


def _candidates(named: DataFrame, reach: int) -> DataFrame:
    """``a, b``: each class with those before it and its region's first, if not connected yet.

    A region's first class alone is compared with the head of the region above it.
    """
    order = Window.partitionBy("region").orderBy("rest", "id")
    me = F.struct("id", "component")
    head = F.struct(F.col("above").alias("id"), F.col("c_above").alias("component"))
    near = named.select(
        "id",
        "component",
        F.concat(
            F.collect_list(me).over(order.rowsBetween(-reach, -1)),
            F.array(F.min(me).over(Window.partitionBy("region"))),
            F.when((F.col("id") == F.col("first")) & F.col("above").isNotNull(), F.array(head)).otherwise(F.array()),
        ).alias("others"),
    )
    apart = F.filter("others", lambda o: o["component"] != F.col("component"))
    return (
        near.select("id", F.explode(F.array_distinct(F.transform(apart, lambda o: o["id"]))).alias("other"))
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        .distinct()
    )


def _inside(named: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, close``: of the pairs of a region that are not connected yet, those whose
    signatures agree in enough places.

    A region is bounded, so its signatures are compared where its rows meet, and pairs
    that fail are never rows.
    """
    mixed = named.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    mixed = named.join(mixed.filter("x <> y").select("region"), "region", "left_semi")
    rows = mixed.select("region", "id", "component").join(classes.select("id", "sig"), "id")
    rows = rows.repartition("region").sortWithinPartitions("region", "id")

    def compare(columns: list[np.ndarray]) -> pa.RecordBatch:
        ids, components, sigs = columns
        i, j = np.triu_indices(len(ids), 1)
        apart = components[i] != components[j]
        i, j = i[apart], j[apart]
        close = np.empty(len(i))
        for part in range(0, len(i), 4096):
            run = slice(part, part + 4096)
            close[run] = (sigs[i[run]] == sigs[j[run]]).mean(axis=1)
        keep = close >= SIGNATURE_FLOOR
        low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        found = (pa.array(low[keep]), pa.array(high[keep]), pa.array(close[keep]))
        return pa.RecordBatch.from_arrays(list(found), names=["a", "b", "close"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held = None, []  # of the region at hand, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.asarray(batch.column("region"))
            ids, components = np.asarray(batch.column("id")), np.asarray(batch.column("component"))
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1), len(names)]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                if held and names[start] != region:
                    yield compare([np.concatenate(c) for c in zip(*held)])
                    held = []
                region = names[start]
                held.append((ids[start:stop], components[start:stop], sigs[start:stop]))
        if held:
            yield compare([np.concatenate(c) for c in zip(*held)])

    return rows.mapInArrow(run, "a long, b long, close double")


def _agreement(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, close``: pairs whose signatures agree in enough places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(n, SIGNATURE)
                for i in (2, 3)
            )
            close = (left == right).mean(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(close)], names=["a", "b", "close"]
            ).filter(pa.array(close >= SIGNATURE_FLOOR))

    sides = [classes.select(F.col("id").alias(s), F.col("sig").alias(f"sig_{s}")) for s in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b")
    return rows.mapInArrow(run, "a long, b long, close double")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, digest, shingles`` of the rows whose id is among ``ids``: all sets of an id, each once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            digests = [blake2b(f, digest_size=16).digest() if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.binary())],
                names=["id", "digest", "shingles"],
            )

    full = docs.join(ids, "id", "left_semi").mapInArrow(sets, "id long, digest binary, shingles binary")
    return written(full.filter("digest is not null").dropDuplicates(["id", "digest"]), "sets")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of which some full shingle sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = [full.select(F.col("id").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "set_a", "set_b")
    return written(rows.mapInArrow(compare, "a long, b long").distinct(), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _blocks(named: DataFrame) -> DataFrame:
    """``named`` with ``block``: sets of about ``BLOCK_SHINGLES`` shingles, one component's together.

    A component of more shingles is cut into parts by a hash. Some blocks get several parts,
    and a longer set is a block's by itself or beside others.
    """
    sizes = named.groupBy("component").agg(F.sum("n").alias("weight"))
    total = sizes.agg(F.sum("weight")).first()[0] or 0
    dealt = join_key_stats(named, sizes, "component", "weight", HOT_SHINGLES)
    part = F.pmod(F.xxhash64("id", "digest"), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    return dealt.withColumn("block", F.pmod(F.xxhash64("component", part), F.lit(blocks))).drop("weight")


def _asked(blocks: DataFrame) -> DataFrame:
    """``block, shingle, holders, x, y``: a block's distinct shingles, once each.

    With the number of its sets that hold it, and their smallest and largest component.
    """

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.int64) for s in table.column("shingles").to_pylist()]
        component = np.repeat(np.asarray(table.column("component")), [len(s) for s in sets])
        shingle = np.concatenate(sets)
        order = np.lexsort((component, shingle))
        shingle, component = shingle[order], component[order]
        first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        last = np.r_[first[1:], len(shingle)]
        return pa.table(
            {
                "block": np.full(len(first), key[0].as_py(), np.int64),
                "shingle": shingle[first],
                "holders": last - first,
                "x": component[first],
                "y": component[last - 1],
            }
        )

    schema = "block long, shingle long, holders long, x long, y long"
    return blocks.groupBy("block").applyInArrow(ask, schema)


def _prefix_postings(blocks: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """``id, component, n, shingle, place``: the early shingles of each set among the ``shared`` ones.

    ``shared`` has ``block, shingle, holders``. The others come before them, in no order.
    """

    def place(key: tuple[pa.Scalar, ...], sets: pa.Table, answers: pa.Table) -> pa.Table:
        known, holders = np.asarray(answers.column("shingle")), np.asarray(answers.column("holders"))
        order = np.argsort(known)
        known, holders = known[order], holders[order]
        rows = [np.empty((5, 0), np.int64)]
        columns = (sets.column(c).to_pylist() for c in ("id", "component", "shingles"))
        for id_, component, shingles in zip(*columns) if len(known) else ():
            found = np.frombuffer(shingles, np.int64)
            n = len(found)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = known[at] == found
            found, held = found[hit], holders[at[hit]]
            early = max(0, len(found) - (n * percent + 99) // 100 + 1)
            found = found[np.lexsort((found, held))[:early]]
            places = n - int(hit.sum()) + 1 + np.arange(len(found))
            rows.append(np.stack([*(np.full(len(found), v) for v in (id_, component, n)), found, places]))
        return pa.table(list(np.concatenate(rows, axis=1)), names=["id", "component", "n", "shingle", "place"])

    schema = "id long, component long, n long, shingle long, place long"
    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(place, schema)


def _apart(full: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``a, b``: every pair of the sets that can be similar enough and is not connected yet.

    Only shingles whose holders are of several components can be common to such a pair; in
    the order of shingles they come last, by the number of sets that hold them. Two sets of a
    similarity of ``percent`` have their first common shingle early in both. Of the sets that
    hold it, those of the most frequent component are not compared with each other.

    Shingles are looked up by blocks of sets, each once for a block, and those of near copies
    are mostly the same. The sets that hold a shingle meet in a grid of tasks.
    """
    named = full.join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.select(
        "id",
        "digest",
        F.coalesce("component", "id").alias("component"),
        (F.length("shingles") / 8).cast("long").alias("n"),
        "shingles",
    )
    blocks = written(_blocks(named), "blocks")
    asked = written(_asked(blocks), "asked")
    shared = asked.groupBy("shingle").agg(
        F.sum("holders").alias("holders"), F.min("x").alias("x"), F.max("y").alias("y")
    )
    shared = asked.select("block", "shingle").join(shared.filter("x <> y").select("shingle", "holders"), "shingle")
    known = written(_prefix_postings(blocks, shared, percent), "prefixes")
    held_by = known.groupBy("shingle", "component").agg(F.count("*").alias("sets"))
    most = held_by.groupBy("shingle").agg(
        F.max_by("component", F.struct("sets", "component")).alias("most"),
        F.sum("sets").alias("postings"),
        F.count("*").alias("parts"),
    )
    most = most.filter("parts > 1").drop("parts")
    mixed = written(join_key_stats(known, most, "shingle", "postings", HOT_POSTING), "mixed")
    sides = F.ceil(F.col("postings") / HOT_POSTING)
    own = F.pmod(F.xxhash64("id", "n"), sides)
    across = F.explode(F.sequence(F.lit(0).cast("long"), sides - 1))

    def side(rows: DataFrame, s: str, mine: str, other: str) -> DataFrame:
        columns = (F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "place", "component"))
        return rows.select("shingle", "most", *columns, own.alias(mine), across.alias(other))

    left = side(mixed.filter("component <> most"), "x", "i", "j")
    right = side(mixed, "y", "j", "i").drop("most")
    common = 1 + F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    pairs = left.join(right, ["shingle", "i", "j"]).filter(
        (F.col("component_x") != F.col("component_y"))
        & ((F.col("component_y") == F.col("most")) | (F.col("id_x") < F.col("id_y")))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & ((100 + percent) * common >= percent * (F.col("n_x") + F.col("n_y")))
    )
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, key: str, text: str, words: int = 5, percent: int = 80
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row, for integer keys.

    ``component_id`` is the smallest key that can be reached by links of ``percent`` or
    more similarity. A null or empty text is linked with nothing. A null key is linked with
    nothing and is its own, null, component, and kept; rows that repeat a key with different
    texts are linked through their key; other columns are dropped; an empty table gives none.
    """
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    described = written(_described(docs, words), "described")
    usable = described.filter("id is not null and digest is not null")
    # One row per class of equal sets; members meet again through the digest.
    classes = written(
        usable.groupBy("digest").agg(F.min_by(F.struct("id", "sig"), "id").alias("r")).select("digest", "r.*"),
        "classes",
    ).select("digest", "id", "sig")
    regions, crowded = _regions(classes)
    links = tried = labels = None
    for trees, reach in ROUNDS:
        last = (trees, reach) == ROUNDS[-1]
        named = _named(regions.filter(F.col("tree") < trees), labels)
        pairs = _candidates(named, reach)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        close = _agreement(pairs, classes)
        if last:
            close = close.unionByName(_inside(named, classes)).select("a", "b").distinct()
            close = close.join(tried, ["a", "b"], "left_anti")
        else:
            close = written(close, "candidates")
            # The closest candidate of each class: these join most of what belongs together,
            # and a later round finds the others again.
            close = (
                close.select(F.explode(F.array("a", "b")).alias("id"), "a", "b", "close")
                .groupBy("id")
                .agg(F.max_by(F.struct("a", "b"), F.struct("close", -F.col("a"), -F.col("b"))).alias("p"))
                .select("p.*")
                .distinct()
            )
        close = written(close, "pairs")
        more = _confirmed(close, _sets(docs, _ends(close), words), percent)
        if labels is not None:  # what is known is a star per component, and soon merged again
            more = more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        links = more
        tried = close if tried is None else tried.unionByName(close)
        if not last:
            labels = written(components(links), "labels")
    same_key = (
        usable.join(classes.select("digest", F.col("id").alias("a")), "digest")
        .filter("a <> id")
        .select("a", F.col("id").alias("b"))
        .distinct()
    )
    final = components(links.unionByName(same_key))
    if crowded is not None:
        labels = written(final, "labels")
        full = _sets(docs, crowded, words)
        pairs = _apart(full, labels, percent).join(tried, ["a", "b"], "left_anti")
        more = _confirmed(written(pairs, "pairs"), full, percent)
        final = components(
            more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        )
    final = final.withColumnRenamed("node", "id")
    by_class = classes.select("digest", "id").join(final, "id", "left")
    by_class = by_class.select("digest", F.coalesce("component", "id").alias("component"))
    out = described.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    out = out.join(by_class, "digest", "left").select(
        F.col("id").alias(key),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
