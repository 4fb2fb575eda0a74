"""Near duplicates: records whose word shingles are nearly the same sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relgate.functions.text import words_of
from relgate.operators.skew import join_key_stats
from relgate.session import written

SHINGLE = 5
#: A similarity of 7/10, kept as integers so that no rounding decides.
THRESHOLD = (7, 10)
#: Classes in one posting from which its classes are compared in blocks.
HOT_POSTING = 256
#: A block's classes and shingles, about: it is one row where blocks are compared.
BLOCK_CLASSES, BLOCK_SHINGLES = 96, 65_536
#: Blocks in one posting from which its block pairs are dealt over several tasks.
GRID = 256
#: Rows of one join key from which they are spread.
HOT_ROWS = 2_000
#: One class in so many is counted to find common shingles, which are those that so many of the counted ones hold.
SAMPLED, COMMON = 32, 8
#: The common shingles that are told apart, at most.
MAX_COMMON = 4096
#: Rows that are sent to all tasks to choose sets by, so that these are not shuffled, at most: some 64 MB.
BROADCAST_ROWS = 1_000_000
#: Minhash bands and the values of each: at a similarity of 0.7 a pair is missed with 1.5 %.
BANDS, BAND_VALUES = 10, 3


def shingle_sets(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``id, number, n, shingles, class``: the distinct shingles of each text, as sorted 64-bit hashes.

    Words are lower-cased and stand between white space. A text of fewer words than a
    shingle is one shingle; a null text, or one without words, has none, and no class. Equal sets are
    of one class, a digest of the set in 128 bits. ``number`` is the row's own: write the table before it is used.
    """
    words = df.select(
        F.col(id_col).alias("id"),
        F.array_remove(words_of(F.coalesce(F.col(text_col), F.lit(""))), "").alias("words"),
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - shingle, F.lit(0)))
    hashed = F.transform(starts, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(shingle))))
    none = F.array().cast("array<bigint>")
    found = words.select("id", F.when(F.size("words") > 0, F.sort_array(F.array_distinct(hashed))).otherwise(none).alias("shingles"))
    n = F.size("shingles").cast("bigint")
    halves = (F.hex(F.xxhash64(F.lit(i), "shingles")) for i in (1, 2))
    return found.select(
        "id", F.monotonically_increasing_id().alias("number"), n.alias("n"), "shingles",
        F.when(n > 0, F.concat_ws("-", *halves)).alias("class"),
    )


def _names(sets: DataFrame, *more: str) -> DataFrame:
    """``class, class_id, members, number, n``: one row per distinct set, and ``more`` of what its members share.

    A class is known by the smallest number of its members where its digest would be long.
    """
    return sets.filter("n > 0").groupBy("class").agg(
        F.min("id").alias("class_id"), F.count("*").alias("members"), F.min("number").alias("number"),
        *(F.any_value(c).alias(c) for c in ("n", *more)),
    )


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, a written table, to be joined by: sent to all tasks if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _short_key(shingle: Column) -> Column:
    return F.shiftrightunsigned(shingle, 24)


def _common_keys(classes: DataFrame) -> DataFrame:
    """``common``: one row, short keys of the shingles that most of the sampled classes hold."""
    drawn = classes.filter(F.pmod(F.xxhash64(F.lit(4), "number"), F.lit(SAMPLED)) == 0)
    held = drawn.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("holders"))
    most = held.filter(F.col("holders") >= COMMON).orderBy(F.col("holders").desc(), "key").limit(MAX_COMMON)
    return most.agg(F.collect_list(_short_key(F.col("key"))).alias("common"))


def _one_per_class(sets: DataFrame, names: DataFrame) -> DataFrame:
    """``number, n, shingles`` of one set per class: ``sets`` without what are copies, and not shuffled for it."""
    first = F.struct("class", "number")
    some = sets.filter("n > 0")
    copies = some.select("class", "number").join(names.select(first.alias("first")), F.col("first") == first, "left_anti")
    copies = written(copies.select("number"), "copies")
    return some.select("number", "n", "shingles").join(_few(copies), "number", "left_anti")


def _linkable(classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``classes`` without those that nothing can be linked with.

    A set lacks at most ``n - ceil(t n)`` of its shingles in one it is linked with. So it has no link if more of its
    shingles below a bound are in no other class: a part of all shingles, the same for all sets, is counted, by 40 bits of
    each. Equal keys of two shingles, and the common ones, which are not counted, only leave more classes.
    """
    num, den = threshold
    below = min(-(1 << 63) + (1 << 64) * (40 * (den - num) + den) // (32 * den), (1 << 63) - 1)
    common = written(_common_keys(classes), "common").scalar()
    drawn = F.transform(F.filter("shingles", lambda s: s < F.lit(below)), _short_key)
    keys = classes.select("number", "n", F.array_except(drawn, common).alias("keys"))
    lacking = F.col("n") - F.floor((F.col("n") * num + den - 1) / den)
    asked = keys.select("number", "keys", (F.size("keys") - lacking).alias("wanted"))
    # A negative key of its own for each class, so that those without keys are found as well.
    rows = asked.select("number", "wanted", F.explode(F.array_append("keys", -1 - F.col("number"))).alias("key"))
    met = rows.withColumn("holders", F.count("*").over(Window.partitionBy("key"))).filter("holders > 1 OR key < 0")
    found = met.groupBy("number").agg(F.any_value("wanted").alias("wanted"), F.count_if(F.col("key") >= 0).alias("found"))
    left = found.filter("found >= wanted").select("number")
    return classes.join(_few(written(left, "left")), "number", "left_semi")


def _prefix_postings(classes: DataFrame, threshold: tuple[int, int], hot: int) -> DataFrame:
    """``number, n, key, rest``: the rarest shingles of each set, as many as a link needs one of.

    Shingles are ordered by the number of sets that hold them. Two sets that share enough
    share one of their first ``n - ceil(t n) + 1``; ``rest`` is what comes after it. A shingle
    of one set alone links nothing, it only moves the others back.
    """
    num, den = threshold
    held = classes.select("number", "n", F.explode("shingles").alias("key"))
    shared = written(held.groupBy("key").agg(F.count("*").alias("holders")).filter("holders > 1"), "shared")
    mine = Window.partitionBy("number")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("holders", "key"))
    placed = join_key_stats(held, shared, "key", "holders", hot).withColumn("place", place)
    needed = F.floor((F.col("n") * num + den - 1) / den)
    early = placed.filter(F.col("place") <= F.col("n") - needed + 1)
    return early.select("number", "n", "key", (F.col("n") - F.col("place")).alias("rest"))


def _band_keys(bands: int, values: int, signature: Column | None = None) -> Column:
    """One key per band of the minhash ``signature``, by default that of ``shingles``."""
    if signature is None:
        places = F.sequence(F.lit(1), F.lit(bands * values))
        signature = F.transform(places, lambda i: F.array_min(F.transform("shingles", lambda s: F.xxhash64(i, s))))
    band = F.sequence(F.lit(0), F.lit(bands - 1))
    # The signature is bound once: each band would work it out again.
    return F.get(
        F.transform(F.array(signature), lambda x: F.transform(band, lambda b: F.xxhash64(b, F.slice(x, b * values + 1, values)))), F.lit(0)
    )


def _band_postings(classes: DataFrame, bands: int, values: int) -> DataFrame:
    """``number, n, key, rest``: one key per minhash band.

    Minima are taken as aggregates over shingles as rows, which are compiled; only minima are shuffled.
    """
    least = {f"least{i}": F.min(F.xxhash64(F.lit(i), "shingle")) for i in range(1, bands * values + 1)}
    rows = classes.select("number", "n", F.explode("shingles").alias("shingle"))
    signed = rows.groupBy("number", "n").agg(*(c.alias(name) for name, c in least.items()))
    keys = F.explode(_band_keys(bands, values, F.array(*least)))
    return signed.select("number", "n", keys.alias("key"), F.col("n").alias("rest"))


def _blocks(live: DataFrame, hot_posting: int, hot: int) -> DataFrame:
    """``number, block`` of every class in ``live`` postings.

    A class of a hot posting lies in a block with others of its hottest one; any other is
    a block of its own. Two blocks with one number would only be compared as one.
    """
    home = live.groupBy("number").agg(
        F.max_by("key", F.struct("size", "key")).alias("home"), F.max("size").alias("size"), F.any_value("n").alias("n")
    )
    crowded = home.filter(F.col("size") > hot_posting)
    parts = crowded.groupBy("home").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"),
        F.count("*").alias("rows"),
    )
    dealt = join_key_stats(crowded, parts, "home", "rows", hot)
    block = F.xxhash64(F.lit(1), "home", F.pmod(F.xxhash64(F.lit(2), "number"), "parts"))
    single = home.filter(F.col("size") <= hot_posting)
    return dealt.select("number", block.alias("block")).unionByName(
        single.select("number", F.xxhash64(F.lit(3), "number").alias("block"))
    )


def _block_pairs(live: DataFrame, blocks: DataFrame, threshold: tuple[int, int], grid: int) -> DataFrame:
    """``a, b``: blocks, ``a <= b``, that can hold two linked classes; each pair once.

    A posting's blocks meet in a grid of tasks. Its bounds hold for a block's most favourable classes.
    """
    num, den = threshold
    listed = live.join(blocks, "number").groupBy("key", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"), F.count("*").alias("held")
    )
    listed = written(listed, "postings")
    sides = F.ceil(F.count("*") / grid).cast("int").alias("sides")
    grids = listed.groupBy("key").agg(sides, F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    dealt = listed.join(grids, "key").withColumn("own", F.pmod(F.xxhash64("block"), F.col("sides").cast("bigint")))
    across = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides").cast("bigint") - 1))
    columns = ("block", "low", "high", "rest")
    left = dealt.select("key", F.col("own").alias("i"), across.alias("j"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = dealt.select("key", F.col("own").alias("j"), across.alias("i"), *(F.col(c).alias(f"{c}_b") for c in columns))
    common = 1 + F.least("rest_a", "rest_b")
    pairs = left.join(right, ["key", "i", "j"]).filter(
        (F.col("block_a") < F.col("block_b"))
        & (den * F.col("high_a") >= num * F.col("low_b"))
        & (den * F.col("high_b") >= num * F.col("low_a"))
        & ((num + den) * common >= num * (F.col("low_a") + F.col("low_b")))
    )
    within = listed.filter("held > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    return pairs.select(F.col("block_a").alias("a"), F.col("block_b").alias("b")).unionByName(within).distinct()


def _link_counts(sets: DataFrame, names: DataFrame, postings: DataFrame, threshold: tuple[int, int], hot_posting: int, grid: int, hot: int) -> DataFrame:
    """``number, links``: the records that each class is linked with, itself left out.

    ``postings`` has ``number, n, key, rest``; candidates are classes that share a key. Every pair is compared once, on whole
    sets, where its two blocks meet; only sums leave the row of two blocks.
    """
    num, den = threshold
    postings = written(postings, "postings")
    sizes = written(postings.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    live = written(join_key_stats(postings, sizes, "key", "size", hot), "live")
    blocks = written(_blocks(live, hot_posting, hot), "blocks")
    pairs = written(_block_pairs(live, blocks, threshold, grid), "pairs")
    entry = F.struct("number", "n", "members", "shingles")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("block")).distinct()
    wanted = written(blocks.join(paired, "block", "left_semi").join(names.select("number", "members"), "number"), "wanted")
    alike = sets.select("number", "n", "shingles").join(_few(wanted), "number")
    held = alike.groupBy("block").agg(F.collect_list(entry).alias("held"))  # a block is bounded
    held = written(held, "held")
    rows = pairs.join(held.select(F.col("block").alias("a"), F.col("held").alias("x")), "a")
    rows = rows.join(held.select(F.col("block").alias("b"), F.col("held").alias("y")), "b")

    def linked(x: Column, y: Column) -> Column:
        alike = (den * F.least(x["n"], y["n"]) >= num * F.greatest(x["n"], y["n"])) & (x["number"] != y["number"])
        common = F.size(F.array_intersect(x["shingles"], y["shingles"]))
        return F.when(alike, (num + den) * common >= num * (x["n"] + y["n"])).otherwise(False)

    table = F.transform("x", lambda x: F.transform("y", lambda y: linked(x, y)))
    zero = F.lit(0).cast("bigint")

    def total(flags: Column, others: str) -> Column:
        counted = F.zip_with(flags, F.col(others), lambda f, o: F.when(f, o["members"]).otherwise(0))
        return F.aggregate(counted, zero, lambda s, m: s + m)

    def entries(side: str, other: str, flags) -> Column:
        return F.transform(side, lambda e, i: F.struct(e["number"].alias("number"), total(flags(i), other).alias("links")))

    compared = rows.select("a", "b", "x", "y", table.alias("t"))
    of_x = entries("x", "y", lambda i: F.get("t", i))
    of_y = entries("y", "x", lambda i: F.transform("t", lambda r: F.get(r, i)))
    sums = compared.select(
        F.explode(F.when(F.col("a") == F.col("b"), of_x).otherwise(F.concat(of_x, of_y))).alias("e")
    )
    return sums.select("e.*").filter("links > 0").groupBy("number").agg(F.sum("links").alias("links"))


def _answer(sets: DataFrame, names: DataFrame, links: DataFrame, id_col: str, hot: int) -> DataFrame:
    known = names.select("class", "class_id", "members", "number").join(links, "number", "left").drop("number")
    met = join_key_stats(sets.select("id", "class"), known, "class", "members", hot)
    alone = sets.filter("class is null").select(
        "id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    n_links = F.coalesce("links", F.lit(0)) + F.col("members") - 1
    out = met.select("id", "class_id", n_links.alias("n_links")).unionByName(alone)
    return out.select(
        F.col("id").alias(id_col), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("representative")
    )


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    shingle: int = SHINGLE,
    threshold: tuple[int, int] = THRESHOLD,
    hot_posting: int = HOT_POSTING,
    grid: int = GRID,
    hot: int = HOT_ROWS,
) -> DataFrame:
    """One row per record: ``(id, class_id, n_links, representative)``, exact.

    Records with equal shingle sets are one class, named by its smallest id. ``n_links``
    counts the other records whose sets have a similarity (shared by all shingles) of ``threshold`` or more, those
    of the same class among them. Links are looked for with an inverted index of each
    set's rarest shingles, cut by sizes and places, and counted on whole sets.

    A record without words is linked with nothing. A null id is a record like others and
    names a class only if no other id does; a repeated id is as many records. Members of a
    class are never paired, and pairs of different sets never leave the row they are compared in.
    """
    sets = written(shingle_sets(df, id_col, text_col, shingle), "sets")
    names = written(_names(sets), "names")
    classes = written(_linkable(_one_per_class(sets, names), threshold), "classes")
    postings = _prefix_postings(classes, threshold, hot)
    links = _link_counts(classes, names, postings, threshold, hot_posting, grid, hot)
    return _answer(sets, names, links, id_col, hot)


def near_duplicates_banded(
    df: DataFrame,
    id_col: str,
    text_col: str,
    shingle: int = SHINGLE,
    threshold: tuple[int, int] = THRESHOLD,
    bands: int = BANDS,
    values: int = BAND_VALUES,
    hot_posting: int = HOT_POSTING,
    grid: int = GRID,
    hot: int = HOT_ROWS,
) -> DataFrame:
    """As ``near_duplicates``, with candidates from equal minhash bands: a link may be missed.

    Every link that is counted was checked on whole sets, so ``n_links`` is never too high.
    No shingle is shuffled: a set sends ``bands`` keys.
    """
    sets = written(shingle_sets(df, id_col, text_col, shingle), "sets")
    names = written(_names(sets), "names")
    postings = _band_postings(_one_per_class(sets, names), bands, values)
    links = _link_counts(sets, names, postings, threshold, hot_posting, grid, hot)
    return _answer(sets, names, links, id_col, hot)
