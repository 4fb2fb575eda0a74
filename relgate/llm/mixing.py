"""Mixing sources to target weights by hash-threshold histograms.

A document's place is a hash of its key. Per source, tokens are summed by leading hash
bits, and the largest prefix of buckets that fits the budget is found from those sums;
only the bucket in which the budget ends is refined, until it holds few documents. Whether
a document is taken is then a comparison of its hash with its source's threshold: the
documents themselves are never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relgate.llm.common import WORD, written

#: Hash bits by which a histogram refines a bucket, and how many in all.
BITS, ALL_BITS = 8, 56
#: A boundary bucket of at most so many documents is not refined any further.
FEW = 512
#: Rows of a repeated key that one row of a written count stands for.
RUN = 10_000


def sized(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``key``, ``source``, number of words and hash place of every row; a null text has 0 words."""
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD))
    return df.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        words.cast("long").alias("size"),
        place_of(key).alias("place"),
    )


def place_of(key: str) -> Column:
    """The key's hash, by which documents are taken."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("mix")), 64 - ALL_BITS)


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of every source.

    Sources by code point, nulls last, have the given weights, repeating. A target is
    weight x level, at most ``most`` times the source's size, and the level is the one at
    which the targets share all sizes: the fixed point of resharing what is above. One row
    per source is sorted here, after all rows have been summed.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn(
        "weight", F.element_at(weight, (F.row_number().over(named) - 1) % len(weights) + 1)
    ).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(after)
    )
    leveled = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # The first source, by cap, that stays below its cap has the level of all that do.
    final = F.first(fits, ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least("cap", F.coalesce(F.col("weight") * final, F.col("cap")))
    return leveled.select("source", "source_size", target.alias("target"))


def _thresholds(sizes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Per source: whole passes, and where in hash order the budget of the last pass ends.

    ``low``: all places below are taken; ``bits``: leading bits of the boundary bucket, which
    starts at ``low``; ``budget``: words still to be taken from it; ``few``: its documents.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    passes = F.least(F.floor(ratio), F.lit(int(most)))
    counts = sizes.groupBy("source").agg(F.count("*").alias("few"))
    counts = counts.withColumnRenamed("source", "counted")
    state = targets.join(counts, F.col("source").eqNullSafe(F.col("counted"))).select(
        "source",
        "source_size",
        "target",
        passes.cast("long").alias("passes"),
        F.floor(F.col("target") - passes * F.col("source_size") + 0.5).cast("long").alias("budget"),
        F.lit(0).cast("long").alias("low"),
        F.lit(0).alias("bits"),
        "few",
    )
    state = written(state, "mix-state")
    for bits in range(BITS, ALL_BITS + 1, BITS):
        open_ = state.filter((F.col("few") > FEW) & (F.col("bits") == bits - BITS))
        if open_.isEmpty():
            break
        shift = ALL_BITS - bits
        bucket = F.shiftright("place", shift)
        asked = open_.select(F.col("source").alias("asked"), "low", "budget")
        inside = sizes.join(asked, F.col("source").eqNullSafe(F.col("asked"))).filter(
            F.shiftright("place", shift + BITS) == F.shiftright("low", shift + BITS)
        )
        sums = inside.groupBy("source", "budget", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("docs")
        )
        # A histogram has 256 buckets per source at most, whatever the documents.
        order = Window.partitionBy("source").orderBy("bucket")
        run = sums.withColumn("upto", F.sum("words").over(order))
        ends = run.filter(F.col("upto") > F.col("budget")).groupBy("source").agg(
            F.min_by(F.struct("bucket", "upto", "words", "docs"), "bucket").alias("end")
        )
        ends = ends.withColumnRenamed("source", "ended")
        past = F.coalesce(F.col("end.bucket"), F.shiftright("low", shift) + 256)
        moved = state.join(ends, F.col("source").eqNullSafe(F.col("ended")), "left").withColumn(
            "moves", (F.col("few") > FEW) & (F.col("bits") == bits - BITS)
        )
        take = F.col("budget") - F.coalesce(F.col("end.upto") - F.col("end.words"), F.lit(0))

        def either(new, old):
            return F.when(F.col("moves"), new).otherwise(F.col(old)).alias(old)

        state = written(
            moved.select(
                "source",
                "source_size",
                "target",
                "passes",
                either(F.when(F.col("end").isNull(), F.lit(0)).otherwise(take), "budget"),
                either(F.shiftleft(past, shift), "low"),
                either(F.lit(bits), "bits"),
                either(F.coalesce(F.col("end.docs"), F.lit(0)), "few"),
            ),
            "mix-state",
        )
    return state


def mix(
    df: DataFrame,
    key: str,
    source: str,
    text: str,
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3,
) -> DataFrame:
    """``key, source, size, source_size, target, taken`` of every row.

    ``taken`` is the words that the mix takes: the size times a whole number, the same in
    every run. In the boundary bucket, of ``FEW`` documents, those that fit the rest of the
    budget are taken in hash order, so a source misses its target by less than its smallest
    left-out document there. A null source is a source of its own, the last; a null text
    has size 0; rows that repeat a key share its place and are taken or left alike, except
    in the boundary bucket; where more than ``FEW`` rows share one place, as those of a repeated
    or null key do, as many as fit are taken, short ones first; other columns are dropped; an empty table gives no rows.
    """
    sizes = written(sized(df, key, source, text), "mix-sizes")
    rows, inside = _placed(sizes, _thresholds(sizes, source_targets(sizes, weights, most), most))
    base = F.col("passes") * F.col("size")
    plain = rows.filter(~inside).select(
        "key", "source", "size", "source_size", "target",
        (base + F.when(F.col("place") < F.col("low"), F.col("size")).otherwise(0)).alias("taken"),
    )
    return plain.unionByName(_ends(rows, inside)).withColumnsRenamed({"key": key, "source": source})


def mixed_rows(
    df: DataFrame,
    key: str,
    source: str,
    text: str,
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3,
) -> DataFrame:
    """All columns of ``df``, each row as many times as :func:`mix` takes it; wordless rows once.

    A row's place is compared with its source's threshold, so rows stay where they are; only
    those of the boundary buckets meet the list of what is taken there. Where more than ``FEW``
    rows share one place, rows of equal key, source and size are taken alike, as often as the
    most taken of them. Nulls, repeated rows and empty tables are treated as in :func:`mix`.
    """
    sizes = written(sized(df, key, source, text), "mix-sizes")
    state = _thresholds(sizes, source_targets(sizes, weights, most), most)
    decided, end = _placed(sizes, state)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    carried = df.select(
        whole,
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        place_of(key).alias("place"),
        words.rlike(WORD).alias("worded"),
        F.regexp_count(words, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(words).alias("mark"),
    )
    rows, inside = _placed(carried, state)
    # Without "size", so that words are counted again in the boundary buckets only.
    plain = rows.filter(~inside).select(
        "row",
        F.when(F.col("worded"), F.col("passes") + (F.col("place") < F.col("low")).cast("long"))
        .otherwise(1).alias("times"),
    )
    same = ("key", "source", "size")
    few, crowd = F.col("few") <= FEW, F.col("few") > FEW
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1)

    def asked(condition: Column) -> DataFrame:
        mine = [F.col(c).alias(f"r_{c}") for c in same]
        return rows.filter(inside & condition).select("row", *mine, "mark")

    on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in same]
    # At most FEW rows a source: rows of equal key and size are told apart by their order.
    listed = _ends(decided, end & few).select(*same, times.alias("times"))
    listed = listed.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("times"))))
    by_mark = Window.partitionBy(*[f"r_{c}" for c in same]).orderBy("mark")
    ordered = asked(few).withColumn("r_nth", F.row_number().over(by_mark))
    ends = ordered.join(listed, [*on, F.col("nth") == F.col("r_nth")]).select("row", "times")
    alike = _ends(decided, end & crowd).groupBy(*same).agg(F.max(times).alias("times"))
    crowded = asked(crowd).join(alike, on).select("row", "times")
    both = plain.unionByName(ends).unionByName(crowded)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    return both.filter("times > 0").select("row", copies.alias("copy")).select("row.*")


def _placed(rows: DataFrame, state: DataFrame):
    """Rows beside their source's threshold, and the condition of a boundary bucket."""
    known = state.withColumnRenamed("source", "known")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("known")), "left").drop("known")
    bucket_end = F.expr(f"low + shiftleft(1L, {ALL_BITS} - bits)")
    inside = (F.col("place") >= F.col("low")) & (F.col("place") < bucket_end)
    return rows, inside & (F.col("few") > 0) & (F.col("bits") <= ALL_BITS)


def _ends(rows: DataFrame, inside: Column) -> DataFrame:
    """What is taken of the rows in the boundary buckets."""
    key_type = rows.schema["key"].dataType.simpleString()
    boundary = inside & (F.col("few") <= FEW)

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "key", "size"], kind="stable")
        left, extra = int(group["budget"].iloc[0]), []
        for size in group["size"].to_numpy(np.int64):
            extra.append(int(size) if size <= left else 0)
            left -= extra[-1]
        group["taken"] = group["passes"] * group["size"] + extra
        return group[["key", "source", "size", "source_size", "target", "taken"]]

    filled = (
        rows.filter(boundary)
        .groupBy("source")
        .applyInPandas(
            fill,
            f"key {key_type}, source string, size long, source_size long, target double, taken long",
        )
    )
    # Beyond FEW rows all bits are used up: rows of equal key and size are counted, not listed.
    counts = rows.filter(inside & (F.col("few") > FEW)).groupBy(
        "source", "size", "key", "source_size", "target", "passes", "budget"
    ).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("size", "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum(F.col("size") * F.col("rows")).over(before), F.lit(0))
    fit = F.least("rows", F.greatest(F.lit(0).cast("long"), F.floor(left / F.greatest("size", F.lit(1)))))
    split = counts.withColumn("fit", fit.cast("long")).select(
        "key", "source", "size", "source_size", "target",
        F.explode(
            F.array(
                F.struct(F.col("fit").alias("rows"), (F.col("passes") + 1).alias("times")),
                F.struct((F.col("rows") - F.col("fit")).alias("rows"), F.col("passes").alias("times")),
            )
        ).alias("part"),
    )
    one = F.lit(1).cast("long")
    runs = split.filter("part.rows > 0").withColumn("start", F.explode(F.sequence(one, "part.rows", F.lit(RUN).cast("long"))))
    crowd = runs.repartition("key", "source", "size", "start").select(
        "key", "source", "size", "source_size", "target",
        (F.col("size") * F.col("part.times")).alias("taken"),
        F.explode(F.sequence("start", F.least(F.col("start") + RUN - 1, F.col("part.rows")))).alias("row"),
    )
    filled = filled.unionByName(crowd.drop("row"))
    return filled
