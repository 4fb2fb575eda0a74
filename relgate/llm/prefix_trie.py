"""The prefix trie of conversations, found by hashing blocks of turns first.

A conversation is cut into blocks of a fixed number of turns. Conversations are grouped by
successive block digests: equal blocks behind equal prefixes are one row from then on, with
the number of conversations and the smallest of them. Only where different blocks follow the
same prefix are their turns compared one by one; elsewhere the turns of a block are nodes as
they stand.

A node is named by its depth and the digest of its prefix, the exclusive or of the salted
digests of its turns, in 128 bits. Exclusive ors of runs combine, so a long conversation is
read in spans and none is held by one task.

For sums over subtrees the trie is a forest of chains: the nodes of which one conversation is
the smallest member follow each other. A chain hangs on a node of another one. Totals of
whole chains are summed towards the root by pointer doubling, and then along each chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relgate.llm.common import written
from relgate.operators.skew import join_key_stats

#: Turns of a block.
BLOCK = 4
#: Neighbours, as a power of two, that one task puts in order at a time; also the ids whose
#: texts make one piece of a digested list.
SPAN_BITS = 10
#: Children of a node, or turns of a conversation, from which its rows are spread in a join.
HOT = 2_000
NODE = ("depth", "x1", "x2")


def numbered(df: DataFrame, conv: str, turn: str, role: str, text: str, span_bits: int = SPAN_BITS) -> DataFrame:
    """``conv, at, d1, d2, length`` of every turn: its place from 0, the digest of its role and
    text, and the code points of its text.

    Turns are ordered by ``turn``, nulls first, and turns of one number by their digests. A
    null role or text is empty; rows without a conversation are no turns. Texts are read
    where they lie and never shuffled. Turns are numbered in spans of ``turn``, so a long
    conversation is dealt over many tasks.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    whole = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"), 256)
    rows = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.shiftright(F.col(turn).cast("long"), span_bits), F.lit(-(1 << 63))).alias("span"),
        F.xxhash64(F.lit(1), whole).alias("d1"),
        F.xxhash64(F.lit(2), whole).alias("d2"),
        F.length(text_).cast("long").alias("length"),
    )
    earlier = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv", "span").agg(F.count("*").alias("n"))
    spans = spans.select("conv", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("conv", "span").orderBy(F.asc_nulls_first("turn"), "d1", "d2")
    at = F.col("before") + F.row_number().over(order) - 1
    return rows.join(spans, ["conv", "span"]).select("conv", at.alias("at"), "d1", "d2", "length")


def _running(
    df: DataFrame, group: str, at: str, totals: dict[str, tuple], span_bits: int, later: bool = False
) -> DataFrame:
    """``df`` with, for each name, an aggregate over the group's rows before (or after) the row.

    ``totals``: name to ``(aggregate, combination, column, nothing)``. ``at`` is unique in a group. Spans
    are aggregated first, and then the rows of a span, so no group is in one task. ``df``
    is read twice: let it be a table.
    """
    rows = df.withColumn("_span", F.shiftright(at, span_bits))
    order = (lambda c: F.desc(c)) if later else (lambda c: F.asc(c))
    outer = Window.partitionBy(group).orderBy(order("_span")).rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(group, "_span").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(group, "_span").agg(*(f(c).alias(n) for n, (f, _, c, _) in totals.items()))
    carried = spans.select(group, "_span", *(f(n).over(outer).alias(f"_{n}") for n, (f, *_) in totals.items()))
    found = rows.join(carried, [group, "_span"])
    values = {
        n: both(F.coalesce(f(c).over(inner), F.lit(none)), F.coalesce(F.col(f"_{n}"), F.lit(none)))
        for n, (f, both, c, none) in totals.items()
    }
    return found.select(*df.columns, *(v.alias(n) for n, v in values.items()))


def _xor(*values: str) -> dict[str, tuple]:
    return {f"p{i}": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), c, 0) for i, c in enumerate(values, 1)}


def _sums(**values: str) -> dict[str, tuple]:
    return {n: (F.sum, lambda a, b: a + b, c, 0) for n, c in values.items()}


def _salted(turns: DataFrame) -> DataFrame:
    """Digests that also depend on the place, so that their exclusive or keeps the order."""
    salted = (F.xxhash64(F.lit(i), "d1", "d2", "at").alias(f"s{i}") for i in (1, 2))
    return turns.select("conv", "at", "length", *salted)


def _block_rows(turns: DataFrame, block: int, span_bits: int) -> DataFrame:
    """``block, p1, p2, turns, n, conv``: the distinct blocks behind each prefix."""
    by_block = turns.withColumn("block", F.floor(F.col("at") / block).cast("long"))
    blocks = by_block.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "s1", "s2", "length"))).alias("turns"),  # ``block`` at most
        F.bit_xor("s1").alias("b1"),
        F.bit_xor("s2").alias("b2"),
    )
    behind = _running(written(blocks, "blocks"), "conv", "block", _xor("b1", "b2"), span_bits)
    return behind.groupBy("block", "p1", "p2", "b1", "b2").agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), F.any_value("turns").alias("turns")
    )


def _turn_nodes(blocks: DataFrame, block: int) -> DataFrame:
    """The nodes along each block: ``depth, x1, x2, q1, q2, conv, n, length``; q is the parent's prefix."""

    def prefix(name: str, start: str, size: Column) -> Column:
        return F.aggregate(F.slice("turns", 1, size), F.col(start), lambda x, t: x.bitwiseXOR(t[name]))

    def node(turn: Column, i: Column) -> Column:
        x1, x2 = prefix("s1", "p1", i + 1), prefix("s2", "p2", i + 1)
        return F.struct(
            (turn["at"] + 1).alias("depth"),
            x1.alias("x1"),
            x2.alias("x2"),
            x1.bitwiseXOR(turn["s1"]).alias("q1"),
            x2.bitwiseXOR(turn["s2"]).alias("q2"),
            turn["length"].alias("length"),
        )

    return blocks.select("conv", "n", F.explode(F.transform("turns", node)).alias("t")).select("t.*", "conv", "n")


def _nodes(turns: DataFrame, convs: DataFrame, block: int, span_bits: int, hot: int) -> DataFrame:
    """One row per node of the trie, the root included."""
    blocks = _block_rows(turns, block, span_bits).withColumn("prefix", F.struct("block", "p1", "p2"))
    blocks = written(blocks, "blocks")
    kinds = blocks.groupBy("prefix").agg(F.count("*").alias("kinds"))
    known = join_key_stats(blocks, kinds, "prefix", "kinds", hot)
    alone = _turn_nodes(known.filter("kinds = 1"), block)
    apart = _turn_nodes(known.filter("kinds > 1"), block).groupBy(*NODE, "q1", "q2", "length")
    apart = apart.agg(F.min("conv").alias("conv"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).filter("n > 0")
    root = root.select(*(zero.alias(c) for c in (*NODE, "q1", "q2", "length")), "conv", "n")
    return written(alone.unionByName(apart).unionByName(root), "nodes")


def _hung(nodes: DataFrame, hot: int) -> DataFrame:
    """One row per chain: ``conv, top, end, leaves, saved`` and the ``parent`` chain it hangs on.

    ``leaves`` is 1 where nothing hangs on the chain's end; the sums are of its own nodes.
    The root's chain has no parent.
    """
    chains = nodes.groupBy("conv").agg(
        F.min_by(F.struct((F.col("depth") - 1).alias("depth"), F.col("q1").alias("x1"), F.col("q2").alias("x2")), "depth").alias("hook"),
        F.max_by(F.struct(*NODE), "depth").alias("last"),
        F.sum((F.col("n") - 1) * F.col("length")).alias("saved"),
    )
    chains = written(chains, "chains")
    hooks = chains.filter("hook.depth >= 0").groupBy("hook").agg(F.count("*").alias("hanging"))
    named = nodes.select(F.struct(*NODE).alias("hook"), F.col("conv").alias("parent")).join(hooks, "hook")
    named = written(named, "hooks")
    below = join_key_stats(chains.filter("hook.depth >= 0"), named, "hook", "hanging", hot).drop("hanging")
    top = chains.filter("hook.depth < 0").withColumn("parent", F.lit(None).cast("long"))
    ends = named.select(F.col("hook").alias("last"), F.lit(0).cast("long").alias("leaf"))
    out = below.unionByName(top).join(ends, "last", "left")
    return out.select(
        "conv",
        "parent",
        (F.col("hook.depth") + 1).alias("top"),
        F.col("last.depth").alias("end"),
        F.coalesce("leaf", F.lit(1).cast("long")).alias("leaves"),
        "saved",
    )


def _totals(chains: DataFrame, hot: int) -> DataFrame:
    """``conv, leaves, saved`` of each chain with all that hangs on it, directly or not.

    After round i a chain holds what is less than 2^i hooks below it and points to the
    chain 2^i hooks above, so the rounds are the logarithm of the most hooks on a path.
    """
    state = written(chains.select("conv", F.col("parent").alias("up"), "leaves", "saved"), "totals")
    while not state.filter("up is not null").isEmpty():
        below = state.filter("up is not null").groupBy(F.col("up").alias("conv"))
        below = below.agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("pointing"))
        known = written(state.join(below, "conv", "left"), "below")
        above = known.filter("pointing > 0").select(F.col("conv").alias("up"), F.col("up").alias("next"), "pointing")
        moved = join_key_stats(state.filter("up is not null").select("conv", "up"), above, "up", "pointing", hot)
        state = written(
            known.join(moved.select("conv", "next"), "conv", "left").select(
                "conv",
                F.col("next").alias("up"),
                (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            ),
            "totals",
        )
    return state.select("conv", "leaves", "saved")


def listed_digests(members: DataFrame, group: tuple[str, ...], member: str, span_bits: int = SPAN_BITS) -> DataFrame:
    """``group, sha256``: digest of each group's distinct integers, ascending, as text with commas.

    The digest is one over the whole list, so a group's list passes one task; it passes as
    a stream of pieces that other tasks have written, and is never held.
    """
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda i: i.cast("string")), ",")
    pieces = members.groupBy(*group, F.shiftright(member, span_bits).alias("span")).agg(piece.alias("piece"))
    ordered = pieces.repartition(*group).sortWithinPartitions(*group, "span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], pa.int64()) for i in range(len(group))]
            digests = pa.array([d.hexdigest() for _, d in done], pa.string())
            return pa.RecordBatch.from_arrays([*columns, digests], names=[*group, "sha256"])

        current, digest = None, None
        for batch in batches:
            done = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in [*group, "piece"])):
                if key != current:
                    if current is not None:
                        done.append((current, digest))
                    current, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield out(done)
        if current is not None:
            yield out([(current, digest)])

    return ordered.select(*group, "piece").mapInArrow(run, ", ".join(f"{c} long" for c in group) + ", sha256 string")


def prefix_trie(
    turns: DataFrame, convs: DataFrame, block: int = BLOCK, span_bits: int = SPAN_BITS, hot: int = HOT
) -> DataFrame:
    """The trie of all prefixes: one row per node.

    ``turns`` has ``conv, at, d1, d2, length`` as ``numbered`` gives them, places gapless from
    0; ``convs`` has every ``conv`` once, those without turns too. A node is turn ``depth`` of
    conversation ``conv_id``, the smallest of its members, after the turns before it. Returned
    are ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``:
    members, children, childless nodes of the subtree, the code points that its members share
    with an earlier one, and the digest of the members that end in the node. The root has depth
    0 and no parent; without conversations there is no node.
    """
    salted = written(_salted(turns), "salted")
    ended = salted.groupBy("conv").agg(
        F.count("*").alias("depth"), F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2")
    )
    ended = convs.join(ended, "conv", "left").select("conv", *(F.coalesce(c, F.lit(0)).alias(c) for c in NODE))
    nodes = _nodes(salted, convs, block, span_bits, hot)
    chains = written(_hung(nodes, hot), "hung")
    totals = _totals(chains, hot)
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    hanging = chains.filter("parent is not null").select("conv", "parent", "top").join(totals, "conv")
    on_nodes = hanging.select(
        F.col("parent").alias("conv"), (F.col("top") - 1).alias("depth"), F.lit(1).alias("hanging"), "leaves", "saved", none.alias("parent")
    )
    ends = chains.select("conv", F.col("end").alias("depth"), F.lit(0).alias("hanging"), "leaves", zero.alias("saved"), none.alias("parent"))
    tops = chains.select("conv", F.col("top").alias("depth"), F.lit(0).alias("hanging"), zero.alias("leaves"), zero.alias("saved"), "parent")
    gained = on_nodes.unionByName(ends).unionByName(tops).groupBy("conv", "depth")
    gained = gained.agg(F.sum("hanging").alias("hanging"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("gained"), F.max("parent").alias("parent"), F.max(F.col("parent").isNotNull()).alias("is_top"))
    whole = nodes.join(listed_digests(ended, NODE, "conv", span_bits), list(NODE), "left").join(gained, ["conv", "depth"], "left")
    whole = whole.select(
        "conv",
        "depth",
        "n",
        "sha256",
        F.coalesce("hanging", F.lit(0)).alias("hanging"),
        F.coalesce("leaves", F.lit(0)).alias("leaves"),
        ((F.col("n") - 1) * F.col("length") + F.coalesce("gained", F.lit(0))).alias("saved"),
        F.when(F.col("is_top"), F.col("parent")).when(F.col("depth") > 0, F.col("conv")).alias("parent"),
        F.lit(1).alias("one"),
    )
    sums = _sums(more_leaves="leaves", more_saved="saved", more="one")
    summed = _running(written(whole, "trie"), "conv", "depth", sums, span_bits, later=True)
    return summed.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.col("hanging") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("n_children"),
        (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("more_saved")).alias("saved_tokens"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def grafted(turns: DataFrame, convs: DataFrame, hot: int = HOT) -> DataFrame:
    """``turns`` with the first turns of each conversation taken from that of its hundred.

    Of ``h``, the crc32 of the id modulo 6: the first ``h`` turns come from the conversation whose id is the
    hundred (all if it has fewer, none if it is absent), the own turns after the first ``h`` follow.
    """
    hundred = F.col("conv") - F.col("conv") % 100
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    firsts = turns.filter("at < 5 and conv % 100 = 0").groupBy(F.col("conv").alias("hundred"))
    firsts = firsts.agg(F.array_sort(F.collect_list(F.struct("at", "d1", "d2", "length"))).alias("firsts"))
    asked = convs.select("conv", hundred.alias("hundred"), h.cast("int").alias("h"))
    lent = asked.join(firsts, "hundred").select("conv", F.explode(F.slice("firsts", 1, F.col("h"))).alias("t"))
    own = turns.withColumns({"hundred": hundred, "h": h}).filter("at >= h")
    stats = own.groupBy("hundred").agg(F.count("*").alias("rows")).join(firsts, "hundred", "left")
    stats = stats.select("hundred", "rows", F.coalesce(F.size("firsts"), F.lit(0)).alias("there"))
    own = join_key_stats(own, stats, "hundred", "rows", hot)
    at = F.least(F.col("h"), F.col("there").cast("long")) + F.col("at") - F.col("h")
    return lent.select("conv", "t.*").unionByName(own.select("conv", at.alias("at"), "d1", "d2", "length"))
