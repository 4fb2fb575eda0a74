"""Change detection between two releases, and what the changes amount to."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from relgate.functions import codes
from relgate.functions.text import digest, lines_of
from relgate.operators.skew import HOT_MIN, join_key_stats

RECORD_FIELDS = ("title", "description", "bump_type")
#: Types of a fixed width: an aggregate keeps their values in its hash table.
FIXED = r"(tinyint|smallint|int|bigint|float|double|boolean|date|timestamp|timestamp_ntz|decimal\(\d+,\d+\))\Z"
TITLE_PATTERN = r"\A([a-z]+)(\(([^)]*)\))?(!)?: "


def union_changes(sources: Sequence[tuple]) -> DataFrame:
    """All change sources in one frame, duplicates kept, tagged ``source, priority``.

    A source is ``(name, frame)`` or ``(name, frame, priority)``; without a priority
    it takes its position. Sources of one priority count as one.
    """
    tagged = None
    for position, (name, frame, *given) in enumerate(sources):
        rows = frame.withColumn("source", F.lit(name)).withColumn(
            "priority", F.lit(given[0] if given else position)
        )
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged


def first_non_empty(
    changes: DataFrame, group: Sequence[str] = (), hot_min: int = HOT_MIN
) -> DataFrame:
    """Rows of the first source that has any, overall or per group; NULL is a group too."""
    if not group:
        return changes.filter(F.col("priority") == changes.agg(F.min("priority")).scalar())
    keyed = changes.withColumn("_group", F.struct(*group))
    # The count is always positive; the filter keeps it in both uses of the aggregate,
    # so that its shuffle is made once and reused.
    firsts = (
        keyed.groupBy("_group")
        .agg(F.min("priority").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 0")
    )
    matched = join_key_stats(keyed, firsts, "_group", "_n", hot_min)
    return matched.filter("priority = _first").select(*changes.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, or NULL; a snapshot to be diffed must have none."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    unset = F.lit(False)
    for key in keys:
        unset = unset | F.col(key).isNull()
    return counts.filter((F.col("n_rows") > 1) | unset)


def keyed_diff(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str] | None = None,
    carry: Sequence[str] = (),
    by_digest: Sequence[str] | None = None,
) -> DataFrame:
    """Every key of either snapshot: ``(keys, carry, op, changed_cols, old_rows, new_rows)``.

    As ``snapshot_diff``, with the rows that each snapshot has of the key. Both are tagged and put
    together, and one aggregate by key finds the operation, the changed columns and
    repeated keys: the keys are shuffled once. A null key is one key, and where a key is
    repeated its operation means nothing.
    """
    if cols is None:
        before = dict(old.dtypes)
        cols = [c for c, dtype in new.dtypes if c not in keys and before.get(c) == dtype]
    kinds = dict(new.dtypes)
    digested = {
        c for c in cols if kinds[c] in ("string", "binary") and (by_digest is None or c in by_digest)
    }

    def parts(c: str) -> list[Column]:
        """What stands for a value; all of it NULL for a NULL, or a struct that never is."""
        if c in digested:
            # Two halves as numbers, which an aggregate can keep in its hash table.
            return [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(half), c)) for half in (1, 2)]
        if re.match(FIXED, kinds[c]):
            return [F.col(c)]
        # Maps cannot be compared, but their entries in order can.
        return [F.struct(F.array_sort(F.map_entries(c)) if kinds[c].startswith("map<") else F.col(c))]

    named = {(c, i): f"_{at}_{i}" for at, c in enumerate(cols) for i in range(len(parts(c)))}
    values = [parts(c)[i].alias(name) for (c, i), name in named.items()]
    carried = [F.struct(*carry).alias("_carry")] if carry else []

    def side(df: DataFrame, is_new: bool) -> DataFrame:
        return df.select(*keys, F.lit(is_new).alias("_new"), *values, *carried)

    def kept(name: str, is_new: bool) -> Column:
        value = F.when(F.col("_new") == is_new, F.col(name))
        simple = not name.startswith("_carry") and re.match(FIXED, types[name])
        return F.max(value) if simple else F.first(value, ignorenulls=True)

    both = side(old, False).unionByName(side(new, True))
    types = dict(both.dtypes)
    rows = [F.count_if(F.col("_new") == is_new).alias(n) for n, is_new in (("old_rows", False), ("new_rows", True))]
    states = [kept(n, is_new).alias(f"{n}_{is_new}") for n in named.values() for is_new in (False, True)]
    latest = [kept("_carry", is_new).alias(f"_carry_{is_new}") for is_new in (False, True)] if carry else []
    met = both.groupBy(*keys).agg(*rows, *states, *latest)

    in_both = (F.col("old_rows") > 0) & (F.col("new_rows") > 0)

    def differs(c: str) -> Column:
        halves = [~F.col(f"{n}_False").eqNullSafe(F.col(f"{n}_True")) for (of, _), n in named.items() if of == c]
        return reduce(or_, halves)

    differing = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in cols]))
    none = F.array().cast("array<string>")
    found = met.withColumn("changed_cols", F.when(in_both, differing).otherwise(none) if cols else none)
    op = (
        F.when(F.col("old_rows") == 0, "added")
        .when(F.col("new_rows") == 0, "removed")
        .when(F.size("changed_cols") > 0, "modified")
        .otherwise("same")
    )
    last = F.coalesce("_carry_True", "_carry_False") if carry else None
    return found.select(
        *keys, *(last[c].alias(c) for c in carry), op.alias("op"), "changed_cols", "old_rows", "new_rows"
    )


def snapshot_diff(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str] | None = None,
    carry: Sequence[str] = (),
    by_digest: Sequence[str] | None = None,
) -> DataFrame:
    """Every key of either snapshot: ``(keys, carry, op, changed_cols)``.

    ``op`` is added, removed, modified or same. ``cols`` are compared null-safely
    (default: all non-key columns both have with one type; see ``schema_drift`` for
    the others). ``carry`` columns are taken from the new
    row, or the old one if removed. Texts and binaries (or those in ``by_digest``)
    are shuffled and compared as digests of 128 bits. Keys must be unique in each snapshot
    (``keyed_diff`` counts those that are not).
    """
    return keyed_diff(old, new, keys, cols, carry, by_digest).drop("old_rows", "new_rows")


def line_diff(old: DataFrame, new: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines added and removed per text, as bags: ``(id, added, removed)``, changed ids only.

    Both sides are summed with opposite signs on a line digest: one shuffle of
    digests, partly summed beforehand, and no join.
    """

    def signed(df: DataFrame, sign: int) -> DataFrame:
        lines = df.select(id_col, F.explode(lines_of(F.col(text_col))).alias("_line"))
        return lines.select(
            id_col, digest(F.col("_line")).alias("_digest"), F.lit(sign).alias("_sign")
        )

    net = (
        signed(new, 1)
        .unionByName(signed(old, -1))
        .groupBy(id_col, "_digest")
        .agg(F.sum("_sign").alias("_net"))
        .filter("_net <> 0")
    )
    return net.groupBy(id_col).agg(
        F.sum(F.greatest("_net", F.lit(0))).cast("bigint").alias("added"),
        F.sum(F.greatest(-F.col("_net"), F.lit(0))).cast("bigint").alias("removed"),
    )


def json_type(value: Column) -> Column:
    """Plain type name of a variant."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema == "BIGINT", "int")
        .when(schema.startswith("DECIMAL") | (schema == "DOUBLE"), "double")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "VOID", "null")
        .otherwise(F.lower(schema))
    )


def json_fields(df: DataFrame, json_col: str) -> DataFrame:
    """Top-level fields of every JSON object: ``(field, type)``; one parse per record."""
    parsed = df.select(F.try_parse_json(json_col).alias("_record"))
    fields = df.sparkSession.tvf.variant_explode(F.col("_record").outer())
    # Scalars give no rows and array items no key, so only objects' fields are left.
    return parsed.lateralJoin(fields).filter(F.col("key").isNotNull()).select(
        F.col("key").alias("field"), json_type(F.col("value")).alias("type")
    )


def field_drift(old: DataFrame, new: DataFrame, json_col: str) -> DataFrame:
    """Counts per field and type on each side:
    ``(field, old_type, new_type, old_n, new_n, op)``.

    ``op``: added or removed if only one side has the field, retyped if only one
    side has it with this type, else same. Both sides are counted in one
    aggregation, partly on the map side.
    """
    tagged = (
        json_fields(old, json_col)
        .withColumn("_new", F.lit(0))
        .unionByName(json_fields(new, json_col).withColumn("_new", F.lit(1)))
    )
    counts = tagged.groupBy("field", "type").agg(
        F.sum(1 - F.col("_new")).alias("_old_n"), F.sum("_new").alias("_new_n")
    )
    per_field = counts.groupBy("field").agg(
        F.sum("_old_n").alias("_field_old"),
        F.sum("_new_n").alias("_field_new"),
        # A field has at most one entry per type name.
        F.collect_list(F.struct("type", "_old_n", "_new_n")).alias("_types"),
    )
    rows = per_field.select("field", "_field_old", "_field_new", F.inline("_types"))
    has_old, has_new = F.col("_old_n") > 0, F.col("_new_n") > 0
    return rows.select(
        "field",
        F.when(has_old, F.col("type")).alias("old_type"),
        F.when(has_new, F.col("type")).alias("new_type"),
        F.col("_old_n").cast("bigint").alias("old_n"),
        F.col("_new_n").cast("bigint").alias("new_n"),
        F.when(F.col("_field_old") == 0, "added")
        .when(F.col("_field_new") == 0, "removed")
        .when(has_old & has_new, "same")
        .otherwise("retyped")
        .alias("op"),
    )


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or retyped: ``(field, old_type, new_type, op)``.

    Compares the two schemas only; no data is read.
    """
    before, after = dict(old.dtypes), dict(new.dtypes)
    changed = [f for f in {**before, **after} if before.get(f) != after.get(f)]
    rows = [
        (
            field,
            before.get(field),
            after.get(field),
            "added" if field not in before else "removed" if field not in after else "retyped",
        )
        for field in changed
    ]
    schema = "field string, old_type string, new_type string, op string"
    return new.sparkSession.createDataFrame(rows, schema)


def parse_change_record(df: DataFrame, json_col: str) -> DataFrame:
    """Add ``title, description, bump_type, code``; all three must be JSON strings.

    Other fields are ignored. A record that does not comply gives code 103 and
    three NULLs; a number is not taken for a string.
    """
    parsed = df.withColumn("_record", F.try_parse_json(json_col))
    complies = F.lit(True)
    for field in RECORD_FIELDS:
        kind = F.schema_of_variant(F.variant_get("_record", f"$.{field}", "variant"))
        complies = complies & F.coalesce(kind == "STRING", F.lit(False))
    checked = parsed.withColumn("_complies", complies)
    values = {
        field: F.when(F.col("_complies"), F.try_variant_get("_record", f"$.{field}", "string"))
        for field in RECORD_FIELDS
    }
    code = F.when(F.col("_complies"), codes.PASSED).otherwise(codes.CHANGE_RECORD_ERROR)
    return checked.withColumns({**values, "code": code}).drop("_record", "_complies")


def classify_title(df: DataFrame, col: str) -> DataFrame:
    """Add ``type, scope, breaking, bump_type`` of a conventional change title."""
    title = F.col(col)
    kind = F.nullif(F.regexp_extract(title, TITLE_PATTERN, 1), F.lit(""))
    scope = F.nullif(F.regexp_extract(title, TITLE_PATTERN, 3), F.lit(""))
    marked = F.regexp_extract(title, TITLE_PATTERN, 4) == "!"
    breaking = F.when(kind.isNotNull(), marked | title.contains("BREAKING CHANGE"))
    typed = df.withColumns({"type": kind, "scope": scope, "breaking": breaking})
    bump = (
        F.when(F.col("type").isNull(), None)
        .when(F.col("breaking"), "major")
        .when(F.col("type") == "feat", "minor")
        .otherwise("patch")
    )
    return typed.withColumn("bump_type", bump.cast("string"))


def infer_bump(diff: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """One row ``(bump_type, added, removed, modified, code)``.

    Keys or fields removed, or fields retyped: major. Keys or fields added: minor.
    Only modified: patch. No change at all: NULL and code 107.
    """

    return bump_of(change_counts(diff), drift)


def change_counts(diff: DataFrame, **more: Column) -> DataFrame:
    """One row ``(added, removed, modified)`` and ``more`` aggregates of the same pass."""
    counts = [_ops(o).alias(o) for o in ("added", "removed", "modified")]
    return diff.agg(*counts, *(c.alias(n) for n, c in more.items()))


def _ops(name: str) -> Column:
    return F.count_if(F.col("op") == name)


def bump_of(counts: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """``infer_bump`` from the counts of changes."""
    if drift is None:
        counts = counts.withColumns({"_broken": F.lit(0), "_grown": F.lit(0)})
    else:
        counts = counts.withColumns(
            {
                "_broken": drift.agg(_ops("removed") + _ops("retyped")).scalar(),
                "_grown": drift.agg(_ops("added")).scalar(),
            }
        )
    bump = (
        F.when(F.col("removed") + F.col("_broken") > 0, "major")
        .when(F.col("added") + F.col("_grown") > 0, "minor")
        .when(F.col("modified") > 0, "patch")
    )
    return counts.select(
        bump.alias("bump_type"),
        "added",
        "removed",
        "modified",
        F.when(bump.isNull(), codes.NO_CHANGES).otherwise(codes.PASSED).alias("code"),
    )


def change_summary(diff: DataFrame, by: str) -> DataFrame:
    """Title and description of the changes per value of ``by``: ``(by, title, description)``.

    The title is a conventional change title, so ``classify_title`` gives the bump.
    Changes are first counted per operation and column, so the text of a group is
    put together from a handful of counts.
    """
    columns = F.transform("changed_cols", lambda c: F.concat(F.lit("."), c))
    tags = F.array_append(columns, F.col("op"))
    counts = (
        diff.filter("op <> 'same'")
        .select(by, F.explode(tags).alias("_tag"))
        .groupBy(by, "_tag")
        .agg(F.count("*").alias("_n"))
    )

    def total(op: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_tag") == op, F.col("_n"))), F.lit(0))

    column_note = F.when(
        F.col("_tag").startswith("."),
        F.format_string("%s (%d)", F.substr("_tag", F.lit(2)), F.col("_n")),
    )
    per_group = counts.withColumn("_note", column_note).groupBy(by).agg(
        total("added").alias("_added"),
        total("removed").alias("_removed"),
        total("modified").alias("_modified"),
        F.expr("listagg(_note, ', ') WITHIN GROUP (ORDER BY _note)").alias("_notes"),
    )
    kind = (
        F.when(F.col("_removed") > 0, F.format_string("feat(%s)!", F.col(by)))
        .when(F.col("_added") > 0, F.format_string("feat(%s)", F.col(by)))
        .otherwise(F.format_string("fix(%s)", F.col(by)))
    )
    return per_group.select(
        by,
        F.concat(
            kind,
            F.format_string(
                ": %d added, %d removed, %d modified",
                F.col("_added"),
                F.col("_removed"),
                F.col("_modified"),
            ),
        ).alias("title"),
        F.concat(
            F.lit("changed columns: "), F.coalesce(F.nullif("_notes", F.lit("")), F.lit("none"))
        ).alias("description"),
    )


def change_message(title: Column, description: Column) -> Column:
    """Full message: the title, an empty line, the description."""
    return F.concat(title, F.lit("\n\n"), description)


def score_changes(
    df: DataFrame,
    keys: Sequence[str],
    text_col: str,
    scorer: Callable[[pd.Series], pd.Series],
) -> DataFrame:
    """Have ``scorer`` turn change texts into change records:
    ``(keys, title, description, bump_type, code, error)``.

    ``scorer`` gets a batch of texts and returns as many JSON texts. It runs in the
    tasks, one Arrow batch at a time. Its answers are checked by
    ``parse_change_record``. A batch it raises on, or answers in another number, is
    halved until only the rows at fault are left: they get code 103 and the reason as
    ``error``.
    """
    key_fields = [df.schema[k] for k in keys]
    schema = StructType(key_fields).add("_record_json", StringType()).add("error", StringType())

    def score(texts: pd.Series) -> list:
        try:
            answers = list(scorer(texts))
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
            return [(answer, None) for answer in answers]
        except Exception as error:
            half = len(texts) // 2
            if not half:
                return [(None, f"{type(error).__name__}: {error}")] * len(texts)
            return score(texts.iloc[:half]) + score(texts.iloc[half:])

    def score_batches(batches):
        for batch in batches:
            answers = score(batch[text_col])
            yield batch[list(keys)].assign(
                _record_json=[a for a, _ in answers], error=[e for _, e in answers]
            )

    scored = df.select(*keys, text_col).mapInPandas(score_batches, schema)
    parsed = parse_change_record(scored, "_record_json")
    return parsed.select(*keys, *RECORD_FIELDS, "code", "error")
