"""The whole run: validate, gate, diff, version, publish; the first failure ends it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relgate.functions import codes
from relgate.functions.codes import GateError
from relgate.functions.settings import MAX_COMPLEXITY, MAX_DUPLICATES, START_VERSION
from relgate.operators.diff import bump_of, change_counts, keyed_diff, schema_drift
from relgate.operators.gates import gate_result
from relgate.operators.overlay import section_type_check, settings_lookup
from relgate.operators.versions import bump_versions, latest_version
from relgate.sources.publish import build, publish, published_versions

REPORT_SCHEMA = "step int, name string, pct int, status string, code int, message string"

# Settings a gate can name as its limit: path, type and default.
LIMITS = {
    "max_complexity": ("$.quality.max_complexity", "double", MAX_COMPLEXITY),
    "max_duplicates": ("$.quality.max_duplicates", "double", MAX_DUPLICATES),
}

# Settings of the version and the publish step.
OTHERS = {
    "version": ("$.project.version", "string", START_VERSION),
    "skip_existing": ("$.publish.skip_existing", "boolean", False),
}


@dataclass
class Gate:
    """A one-row frame, its measured column and the limit it may not exceed.

    The limit is a number or the name of a quality setting.
    """

    name: str
    measure: DataFrame
    measured: str
    limit: float | str


@dataclass
class Release:
    """What to release and what it has to satisfy.

    ``verdicts`` holds ``(code, message)`` per checked record and ``verdict_key``.
    The published versions under ``root/name`` give the current version, unless
    ``current_version`` does; ``project.version`` is the start without either. ``settings``
    is a JSON text of overrides. ``drift`` adds
    field changes inside records to the column changes found by comparing schemas.
    """

    name: str
    root: str
    staging: str
    candidate: DataFrame
    previous: DataFrame
    keys: Sequence[str]
    verdicts: DataFrame
    verdict_key: str
    gates: Sequence[Gate] = ()
    drift: DataFrame | None = None
    max_invalid_pct: float = 0.0
    current_version: str | None = None
    settings: str = "{}"


def release(spark: SparkSession, plan: Release) -> DataFrame:
    """Run the steps and report them: ``(step, name, pct, status, code, message)``.

    Each step runs its own actions, fetches one row per result and hands its findings
    on to the later ones. Nothing is written before all gates have passed. Steps after
    a failure are not run; an error that has no code of its own gets code 100.
    """
    steps = {
        "validation": _validate,
        "quality": _check_quality,
        "changes": _analyse_changes,
        "version": _next_version,
        "publish": _publish,
    }
    report, found, stopped = [], {}, False
    reached = 0
    for number, (name, step) in enumerate(steps.items(), start=1):
        if stopped:
            report.append((number, name, reached, "skipped", None, None))
            continue
        try:
            message = step(spark, plan, found)
            status, code, reached = "passed", codes.PASSED, 100 * number // len(steps)
        except GateError as error:
            status, code, message = "failed", error.code, error.message
        except Exception as error:
            status, code = "failed", codes.CODES["UNKNOWN_ERROR"]
            message = f"{type(error).__name__}: {error}"
        stopped = status == "failed"
        report.append((number, name, reached, status, code, message))
    return spark.createDataFrame(report, REPORT_SCHEMA)


def _validate(spark: SparkSession, plan: Release, found: dict) -> str:
    failed = F.col("code") != codes.PASSED
    seen = plan.verdicts.agg(
        F.count("*").alias("total"),
        F.count_if(failed).alias("failed"),
        F.min_by(
            F.struct("code", "message"),
            F.when(failed, F.struct(F.col(plan.verdict_key).isNull(), plan.verdict_key)),
        ).alias("first"),
    ).first()
    if not seen.total:
        raise GateError(codes.CODES["MISSING_README"], "no record was checked")
    if plan.candidate.isEmpty():
        raise GateError(codes.INVALID_RECORD, "the candidate has no rows")
    if 100.0 * seen.failed > plan.max_invalid_pct * seen.total:
        raise GateError(seen.first.code, seen.first.message)
    found["changes"] = changes = _compared(plan)
    for side in ("candidate", "previous"):
        if changes.select(f"{side}_repeats").first()[0]:
            keys = ", ".join(plan.keys)
            raise GateError(codes.INVALID_RECORD, f"keys of the {side} rows are not unique: {keys}")
    return f"{seen.failed} of {seen.total} records failed"


def _compared(plan: Release) -> DataFrame:
    """One row: counts of changes, and of keys that are repeated or NULL on either side.

    Both come from one aggregate by key, so the keys of both sides are shuffled once for
    the validation and the analysis of changes.
    """
    unset = reduce(or_, (F.col(key).isNull() for key in plan.keys))

    def repeats(rows: str) -> Column:
        return F.count_if((F.col(rows) > 1) | (unset & (F.col(rows) > 0)))

    diff = keyed_diff(plan.previous, plan.candidate, plan.keys)
    counts = change_counts(diff, candidate_repeats=repeats("new_rows"), previous_repeats=repeats("old_rows"))
    seen = counts.first()  # one row, kept for the later steps
    return counts.sparkSession.createDataFrame([seen], counts.schema)


def release_settings(spark: SparkSession, settings: str) -> dict:
    """The settings a release reads; a section of the wrong type is code 101."""
    wanted = {**LIMITS, **OTHERS}
    row = spark.range(1).select(F.lit(settings).alias("settings"))
    checked = section_type_check(row, "settings")
    seen = settings_lookup(checked, "settings", wanted).first()
    if seen.code != codes.PASSED:
        raise GateError(seen.code, f"invalid settings: {seen.bad_section or 'not JSON'}")
    return {name: seen[name] for name in wanted}


def _check_quality(spark: SparkSession, plan: Release, found: dict) -> str:
    found["settings"] = limits = release_settings(spark, plan.settings)
    for number, gate in enumerate(plan.gates, start=1):
        limit = limits[gate.limit] if isinstance(gate.limit, str) else gate.limit
        if limit is None:
            raise GateError(codes.CONFIG_ERROR, f"{gate.limit} is no number")
        seen = gate_result(gate.measure, number, gate.name, gate.measured, limit).first()
        if seen.measured is None:
            raise GateError(seen.code, f"{gate.name} is unmeasured")
        if seen.failed:
            raise GateError(seen.code, f"{gate.name} {seen.measured:.2f} above {limit:.2f}")
    return f"{len(plan.gates)} gates passed"


def _analyse_changes(spark: SparkSession, plan: Release, found: dict) -> str:
    drift = schema_drift(plan.previous, plan.candidate).select("op")
    if plan.drift is not None:
        drift = drift.unionByName(plan.drift.select("op"))
    seen = bump_of(found["changes"], drift).first()
    if seen.code != codes.PASSED:
        raise GateError(seen.code, "no changes since the last release")
    found["bump_type"] = seen.bump_type
    counts = f"{seen.added} added, {seen.removed} removed, {seen.modified} modified"
    return f"{seen.bump_type}: {counts}"


def _next_version(spark: SparkSession, plan: Release, found: dict) -> str:
    start = found["settings"]["version"] or START_VERSION
    current = plan.current_version or _latest_published(spark, plan) or start
    bump = found["bump_type"]
    row = spark.range(1).select(F.lit(current).alias("version"), F.lit(bump).alias("bump"))
    seen = bump_versions(row, "version", "bump").first()
    if seen.code != codes.PASSED:
        raise GateError(seen.code, f"cannot bump {current} by {bump}")
    found["version"] = seen.next_version
    return f"{current} -> {seen.next_version}"


def _latest_published(spark: SparkSession, plan: Release) -> str | None:
    versions = published_versions(spark, plan.root, plan.name)
    rows = spark.createDataFrame([(v,) for v in versions], "version string")
    return latest_version(rows, [], "version").first().version


def _publish(spark: SparkSession, plan: Release, found: dict) -> str:
    counted = Observation()
    observed = plan.candidate.observe(counted, F.count(F.lit(1)).alias("n_rows"))
    try:
        built = build(observed, plan.staging)
    except Exception as error:
        raise GateError(codes.BUILD_FAILED, f"build failed: {error}") from error
    version, skip = found["version"], bool(found["settings"]["skip_existing"])
    present = skip and version in published_versions(spark, plan.root, plan.name)
    publish(built, plan.root, plan.name, version, skip_existing=skip, replace_unfinished=True)
    if present:
        return f"{version} is kept as published before"
    return f"{counted.get['n_rows']} rows as {version}"
