"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgate.llm.common import written

#: Links of whole numbers that one task settles, some 3 MB; more are settled by rounds over all tasks.
FEW_LINKS = 200_000


def _settled(edges: DataFrame) -> DataFrame:
    """``node, component`` of few ``edges`` (``hi``, ``lo``), by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(node: int) -> int:
            while (up := above.setdefault(node, node)) != node:
                above[node] = node = above[up]
            return node

        for batch in batches:
            for x, y in zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist()):
                x, y = root(x), root(y)
                above[max(x, y)] = min(x, y)
        nodes = list(above)
        columns = [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b``, comparable ids).

    The component is its smallest node. Each round ties every node to the smallest node in
    its neighbourhood, by aggregation and a join; links shrink to stars around the smallest
    nodes. A round is written to the shared folder, and only its count and checksum come
    to the driver. Nulls and loops are dropped; no links give no rows. Once the links are
    counted as few, one task settles them, with the same result.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    whole = all(kind == "bigint" for _, kind in edges.dtypes)
    before = None
    while True:  # every round makes ends smaller or removes links, until nothing changes
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        if whole and now[0] <= FEW_LINKS:
            return written(_settled(edges), "components")
        before = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi <> lo").distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lowest, "hi")
            .select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
            .select("e.hi", F.col("e.m").alias("lo"))
        )
        edges = written(small.filter("hi <> lo").distinct(), "links")
    stars = edges.groupBy("hi").agg(F.min("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return stars.withColumnRenamed("hi", "node").unionByName(roots.select("node", F.col("node").alias("component")))
