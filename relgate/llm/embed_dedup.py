"""Near-duplicate embeddings by an inverted multi-index.

Two codebooks, one per half of the vector, form a grid of cells. A vector is kept in the
cell of its nearest centroids. To find its neighbours it visits cells in the multi-sequence
order, by the sum of both halves' bounds, and stops where the sum leaves the radius: a
bound is the distance to the nearest point of a centroid's territory, so what lies beyond
cannot hold a neighbour and the recall is 1. What the visits find is verified by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgate.llm.common import written
from relgate.llm.components import components
from relgate.llm.vectors import distances, kmeans, matrix, sample, usable

#: Rows that the codebooks are fitted on, at most; centroids of a half, at most.
SAMPLE_ROWS = 20_000
CENTROIDS = 32
#: Vectors of a cell that a task compares at once; a larger cell is dealt into blocks.
BLOCK = 2048


def bounds(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared lower bounds of each row's distance to each centroid's territory."""
    d = distances(half, centres)
    apart = np.sqrt(distances(centres, centres))
    out = np.zeros_like(d)
    for c in range(len(centres)):
        # The territory of c lies beyond the plane midway to every other centroid.
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (d[:, [c]] - d) / (2 * apart[c])[None]
        beyond[:, apart[c] == 0] = 0
        out[:, c] = np.maximum(beyond.max(axis=1), 0) ** 2
    return out


def visits(left: np.ndarray, right: np.ndarray, radius2: float) -> list[tuple[int, int]]:
    """Cells by ascending sum of two bounds, as long as the sum is within ``radius2``.

    The multi-sequence algorithm: both halves' centroids are sorted, and a queue holds the
    frontier of pairs whose two predecessors have been visited.
    """
    i_of, j_of = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    queue, seen, out = [(left[i_of[0]] + right[j_of[0]], 0, 0)], {(0, 0)}, []
    while queue:
        total, i, j = heapq.heappop(queue)
        if total > radius2:
            break
        out.append((int(i_of[i]), int(j_of[j])))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(i_of) and b < len(j_of) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(queue, (left[i_of[a]] + right[j_of[b]], a, b))
    return out


def spanning(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """The smallest index connected with each of ``n`` nodes by the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[rows], root[columns])
        new = root.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, columns, low)
        np.minimum.at(new, root[rows], low)
        np.minimum.at(new, root[columns], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(
    df: DataFrame, key: str, vector: str, label: str, cosine: float = 0.98,
    sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS,
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row, for integer keys.

    Vectors of equal, non-null labels are linked at ``cosine`` or more. Vectors that are
    null, empty, zero or not finite, those without a label, and rows with a null key are
    linked with nothing; vectors of another length than most are compared among their own
    length; equal vectors are one class and count each other as links; rows that repeat a
    key are one component; other columns are dropped; an empty table gives no rows.
    """
    rows = df.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("string").alias("label"),
        F.transform(vector, lambda x: x.cast("double")).alias("v"),
    )
    rows = written(rows, "vectors")
    fit = rows.filter(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = written(
        fit.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes"
    )
    widths = [r.w for r in classes.select(F.size("v").alias("w")).distinct().collect()]  # one per length
    found = None
    for width in widths:
        part = _links(classes.filter(F.size("v") == width), cosine, sample_rows, centroids)
        found = part if found is None else found.unionByName(part)
    if found is None:
        out = rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return out.withColumn("kept", F.lit(True))
    found = written(found, "vector-links")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = found.filter("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b"))
    members = fit.join(
        classes.select("label", "v", F.col("id").alias("class"), "n"), ["label", "v"]
    ).select("id", "class", "n")
    members = written(members, "members")
    repeated = members.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b")
    final = components(roots.unionByName(repeated.select("a", "b")))
    linked = (
        members.join(counted.withColumnRenamed("id", "class"), "class", "left")
        .join(final.withColumnRenamed("node", "class"), "class", "left")
        .select(
            "id",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "class").alias("component_id"),
        )
    )
    rest = rows.filter(
        ~(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    ).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(rest).withColumnRenamed("id", key)
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, cosine: float, sample_rows: int, centroids: int) -> DataFrame:
    """``id, links, root``: what each class finds in each pair of blocks of cells."""
    x = sample(classes, "id", "v", sample_rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half = x.shape[1] // 2
    # Smaller tables get fewer cells: a cell should hold some vectors of a label.
    k = int(min(centroids, max(1, round((len(x) / 64) ** 0.5))))
    books = kmeans(x[:, :half], k, 1), kmeans(x[:, half:], k, 2)
    radius2 = 2 - 2 * cosine + 1e-9
    grid = len(books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the cell that a vector is kept in, and one for each further one it visits."""
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(2).to_pylist())
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            left, right = bounds(unit[:, :half], books[0]), bounds(unit[:, half:], books[1])
            own_l, own_r = distances(unit[:, :half], books[0]), distances(unit[:, half:], books[1])
            own = own_l.argmin(axis=1) * grid + own_r.argmin(axis=1)
            at, cells = [], []
            for i in range(len(v)):
                cells.append(int(own[i]))
                at.append(i)
                # Either vector of a pair finds the other, so visiting later cells is enough.
                more = [c for a, b in visits(left[i], right[i], radius2) if (c := a * grid + b) > own[i]]
                cells += more
                at += [i] * len(more)
            taken = batch.take(pa.array(at))
            home = [c == own[i] for i, c in zip(at, cells)]
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(cells, pa.int32()), pa.array(home)],
                names=[*batch.schema.names, "cell", "home"],
            )

    schema = "label string, id long, v array<double>, n long, cell int, home boolean"
    placed = written(classes.select("label", "id", "v", "n").mapInArrow(place, schema), "placed")
    cells = placed.groupBy("label", "cell").agg(
        F.count(F.when(F.col("home"), 1)).alias("kept"), F.count(F.when(~F.col("home"), 1)).alias("visiting")
    )
    # Blocks of members (m) against blocks of members and visitors (w): a grid per cell.
    blocks = cells.filter("kept > 0").select(
        "label", "cell",
        F.ceil(F.col("kept") / BLOCK).alias("m"),
        F.ceil((F.col("kept") + F.col("visiting")) / BLOCK).alias("w"),
    )
    dealt = placed.join(blocks, ["label", "cell"]).withColumn("h", F.xxhash64("id"))
    as_member = dealt.filter("home").select(
        "label", "cell", F.pmod("h", "m").alias("bm"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("bw"),
        "id", "v", "n", F.lit(True).alias("member"), "home",
    )
    as_other = dealt.select(
        "label", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("bm"), F.pmod("h", "w").alias("bw"),
        "id", "v", "n", F.lit(False).alias("member"), "home",
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        members, others = group[group["member"]], group[~group["member"]]
        empty = pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        if members.empty or others.empty:
            return empty
        a, b = matrix(list(members["v"])), matrix(list(others["v"]))
        near = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None]
        ids_a, ids_b = members["id"].to_numpy(), others["id"].to_numpy()
        hit = (near >= cosine) & (ids_a[:, None] != ids_b[None])
        # Two members of the cell meet twice, once in either role; each counts its own side.
        at_home = others["home"].to_numpy()
        links_a = hit @ others["n"].to_numpy()
        links_b = (hit & ~at_home[None]).T @ members["n"].to_numpy()
        ids, where = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
        r, c = np.nonzero(hit)
        root = ids[spanning(where[r], where[len(ids_a) + c], len(ids))]
        out = pd.DataFrame(
            {
                "id": np.concatenate([ids_a, ids_b]),
                "links": np.concatenate([links_a, links_b]),
                "root": np.concatenate([root[where[: len(ids_a)]], root[where[len(ids_a) :]]]),
            }
        )
        return out[(out["links"] > 0) | (out["root"] != out["id"])]

    pairs = as_member.unionByName(as_other).groupBy("label", "cell", "bm", "bw")
    return pairs.applyInPandas(compare, "id long, links long, root long")
