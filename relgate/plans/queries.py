"""The registered queries, one per operator, each with its SQL counterpart.

``QUERIES`` maps a name to ``(run, sql)``; ``run`` takes the session and the folder
of parquet tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgate.functions import codes
from relgate.functions.codes import GateError, with_code_name
from relgate.functions.settings import (
    DEFAULT_SETTINGS,
    MAX_COMPLEXITY,
    MAX_DUPLICATES,
    MIN_TEXT_LENGTH,
    REQUIRED_FIELDS,
)
from relgate.functions.text import lines_of
from relgate.operators import clones, diff, gates, overlay, similar, unused, validate, versions
from relgate.plans.release import Gate, Release, release
from relgate.session import scratch_path
from relgate.sources.datasets import parse_report, read_dataset, to_lines
from relgate.sources.publish import build, new_rows, publish, read_built
from relgate.streaming.streams import append_to, stream_dataset
from relgate.streaming.validation import judged_records, split_stream
from relgate.streaming.windows import windowed_gate, without_repeats

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def register(run):
        QUERIES[name] = (run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_dataset(spark, sf_dir, f"{name}.parquet", columns=list(columns) or None)


# --- sources ---------------------------------------------------------------------


@query(
    "a1_scan_dataset",
    """
    SELECT lang, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars
    FROM documents GROUP BY lang
    """,
)
def scan_dataset(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "lang", "n_chars")
    return documents.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars")
    )


def line_reports(spark, sf_dir) -> DataFrame:
    """A metric report per document: its lines are the blocks, words per line the metric."""
    documents = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    blocks = F.transform(
        lines_of(F.col("text")),
        lambda line, i: F.struct(
            F.concat(F.lit("L"), i.cast("string")).alias("name"),
            # Words are counted by the spaces between them; no array of words is made.
            (1 + F.length(line) - F.length(F.replace(line, F.lit(" ")))).alias("complexity"),
        ),
    )
    file = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return documents.select("doc_id", F.to_json(F.create_map(file, blocks)).alias("report_json"))


LINE_BLOCKS_SQL = """
    SELECT doc_id, source || '/' || doc_id AS file,
           unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents
"""


@query(
    "a2_parse_report",
    f"""
    WITH blocks AS ({LINE_BLOCKS_SQL})
    SELECT doc_id,
           CASE WHEN doc_id % 97 <> 0 THEN count(*) END::BIGINT AS n_blocks,
           CASE WHEN doc_id % 97 <> 0 THEN sum(len(string_split(line, ' '))) END::BIGINT
             AS complexity_sum
    FROM blocks GROUP BY doc_id
    """,
)
def parse_report_query(spark, sf_dir):
    cut = F.when(F.col("doc_id") % 97 == 0, F.expr("left(report_json, 9)"))
    reports = line_reports(spark, sf_dir).withColumn("report_json", F.coalesce(cut, "report_json"))
    blocks = F.get(F.map_values("report"), F.lit(0))
    return parse_report(reports, "report_json").select(
        "doc_id",
        F.when(F.col("report").isNotNull(), F.size(blocks)).cast("bigint").alias("n_blocks"),
        F.aggregate(
            blocks, F.lit(0).cast("bigint"), lambda total, b: total + b["complexity"]
        ).alias("complexity_sum"),
    )


@query(
    "a3_to_lines",
    """
    SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no,
           unnest(string_split(text, chr(10))) AS line
    FROM documents
    """,
)
def to_lines_query(spark, sf_dir):
    return to_lines(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


# --- validation ------------------------------------------------------------------


@query(
    "v1_missing_entities",
    """
    SELECT o_orderkey, 111 AS code FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def missing_entities_query(spark, sf_dir):
    expected = table(spark, sf_dir, "orders", "o_orderkey")
    actual = table(spark, sf_dir, "lineitem", "l_orderkey")
    return validate.missing_entities(
        expected, actual.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]
    )


def cut_props(spark, sf_dir) -> DataFrame:
    """Event properties, cut short in every 97th record, absent in every 89th."""
    events = table(spark, sf_dir, "events", "event_id", "props")
    key = F.col("event_id")
    props = (
        F.when(key % 97 == 0, F.expr("left(props, 4)"))
        .when(key % 89 == 0, F.lit(None))
        .otherwise(F.col("props"))
    )
    return events.withColumn("props", props)


@query(
    "v2_split_malformed",
    """
    SELECT event_id,
           event_id % 97 <> 0 AND event_id % 89 <> 0 AS is_valid,
           CASE WHEN event_id % 97 = 0 THEN (CASE WHEN json_valid(left(props, 4)) THEN 0 ELSE 112 END)
                WHEN event_id % 89 = 0 THEN 111 ELSE 0 END AS code
    FROM events
    """,
)
def split_malformed_query(spark, sf_dir):
    return validate.split_malformed(cut_props(spark, sf_dir), "props").drop("props")


MANIFEST_FIELDS = list(REQUIRED_FIELDS)


def manifests(spark, sf_dir) -> DataFrame:
    """A JSON manifest per customer; some lack a version, a description or both."""
    key = F.col("c_custkey")
    project = F.struct(
        F.col("c_name").alias("name"),
        F.when(key % 7 != 0, F.lit("1.0.0")).alias("version"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("description"),
        F.lit("README.md").alias("readme"),
    )
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    return customers.select(
        "c_custkey", F.to_json(F.struct(project.alias("project"))).alias("manifest")
    )


@query(
    "v3_required_fields",
    """
    WITH manifests AS (
      SELECT c_custkey, '{"project":{"name":"' || c_name || '"'
             || CASE WHEN c_custkey % 7 <> 0 THEN ',"version":"1.0.0"' ELSE '' END
             || CASE WHEN c_custkey % 5 <> 0 THEN ',"description":"' || c_mktsegment || '"' ELSE '' END
             || ',"readme":"README.md"}}' AS manifest
      FROM customer),
    keyed AS (SELECT c_custkey, json_keys(manifest, '$.project') AS keys FROM manifests)
    SELECT c_custkey,
           CASE WHEN NOT list_contains(keys, 'name') THEN 'name'
                WHEN NOT list_contains(keys, 'version') THEN 'version'
                WHEN NOT list_contains(keys, 'description') THEN 'description'
                WHEN NOT list_contains(keys, 'readme') THEN 'readme' END AS missing_field
    FROM keyed
    """,
)
def required_fields_query(spark, sf_dir):
    checked = validate.required_fields(
        manifests(spark, sf_dir), "manifest", MANIFEST_FIELDS, parent="project"
    )
    return checked.drop("manifest")


@query(
    "v4_min_length",
    "SELECT doc_id, length(text)::INTEGER AS n FROM documents WHERE length(text) < 50",
)
def min_length_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return validate.min_length(documents, "text").select("doc_id", F.length("text").alias("n"))


@query(
    "v5_required_sections",
    """
    SELECT doc_id,
           CASE WHEN NOT contains(text, '. ') THEN '. '
                WHEN NOT contains(text, ' the ') THEN ' the ' END AS missing_section
    FROM documents
    """,
)
def required_sections_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return validate.required_sections(documents, "text", [". ", " the "]).drop("text")


def text_verdicts(spark, sf_dir, *carry: str) -> DataFrame:
    return verdicts_of(table(spark, sf_dir, "documents", "doc_id", "text", *carry), *carry)


def verdicts_of(documents: DataFrame, *carry: str) -> DataFrame:
    checks = validate.text_checks("text", MIN_TEXT_LENGTH, [". "])
    return validate.verdict(documents, ["doc_id", *carry], checks)


TEXT_VERDICTS_SQL = """
    SELECT doc_id, source,
           CASE WHEN text IS NULL THEN 113 WHEN length(text) < 50 THEN 114
                WHEN NOT contains(text, '. ') THEN 114 ELSE 0 END AS code,
           CASE WHEN text IS NULL THEN 'text is absent'
                WHEN length(text) < 50 THEN 'text is shorter than 50 characters'
                WHEN NOT contains(text, '. ') THEN 'missing section: . ' END AS message
    FROM documents
"""


@query(
    "v6_verdict",
    f"SELECT doc_id, code, message FROM ({TEXT_VERDICTS_SQL})",
)
def verdict_query(spark, sf_dir):
    return text_verdicts(spark, sf_dir)


@query(
    "v6_manifest_verdict",
    """
    SELECT c_custkey,
           CASE WHEN c_custkey % 13 = 0 THEN 111 WHEN c_custkey % 11 = 0 THEN 112
                WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 112 ELSE 0 END AS code,
           CASE WHEN c_custkey % 13 = 0 THEN 'record is absent'
                WHEN c_custkey % 11 = 0 THEN 'record is not JSON'
                WHEN c_custkey % 7 = 0 THEN 'missing field: version'
                WHEN c_custkey % 5 = 0 THEN 'missing field: description' END AS message
    FROM customer
    """,
)
def manifest_verdict_query(spark, sf_dir):
    key = F.col("c_custkey")
    planted = manifests(spark, sf_dir).withColumn(
        "manifest",
        F.when(key % 13 == 0, None)
        .when(key % 11 == 0, F.expr("left(manifest, 12)"))
        .otherwise(F.col("manifest")),
    )
    checks = validate.record_checks("manifest", MANIFEST_FIELDS, "project")
    return validate.verdict(planted, ["c_custkey"], checks)


@query(
    "v7_validation_report",
    f"""
    SELECT source, code,
           CASE code WHEN 0 THEN 'PASSED' WHEN 113 THEN 'MISSING_README'
                     WHEN 114 THEN 'INVALID_README' END AS code_name,
           count(*)::BIGINT AS n_rows
    FROM ({TEXT_VERDICTS_SQL}) GROUP BY source, code
    """,
)
def validation_report_query(spark, sf_dir):
    return validate.validation_report(text_verdicts(spark, sf_dir, "source"), ["source"])


# --- gates -----------------------------------------------------------------------


@query(
    "q1_flatten_report",
    f"""
    WITH blocks AS ({LINE_BLOCKS_SQL})
    SELECT file, pos::INTEGER AS pos, 'L' || pos AS name,
           len(string_split(line, ' '))::INTEGER AS metric
    FROM blocks
    """,
)
def flatten_report_query(spark, sf_dir):
    reports = parse_report(line_reports(spark, sf_dir), "report_json")
    return gates.flatten_report(reports, "report")


def lines_per_order(spark, sf_dir) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem", "l_orderkey")
    return lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


LINES_PER_ORDER_SQL = "SELECT l_orderkey, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY 1"


@query(
    "q2_band_filter",
    f"""
    SELECT l_orderkey, n_lines,
           CASE WHEN n_lines >= 41 THEN 'F' WHEN n_lines >= 31 THEN 'E' WHEN n_lines >= 21 THEN 'D'
                WHEN n_lines >= 11 THEN 'C' ELSE 'B' END AS band
    FROM ({LINES_PER_ORDER_SQL}) WHERE n_lines >= 6
    """,
)
def band_filter_query(spark, sf_dir):
    return gates.band_filter(lines_per_order(spark, sf_dir), "n_lines", "B")


@query(
    "q2_band_counts",
    f"""
    SELECT CASE WHEN n_lines >= 41 THEN 'F' WHEN n_lines >= 31 THEN 'E' WHEN n_lines >= 21 THEN 'D'
                WHEN n_lines >= 11 THEN 'C' WHEN n_lines >= 6 THEN 'B' ELSE 'A' END AS band,
           count(*)::BIGINT AS n_blocks
    FROM ({LINES_PER_ORDER_SQL}) GROUP BY 1
    """,
)
def band_counts_query(spark, sf_dir):
    banded = gates.band_filter(lines_per_order(spark, sf_dir), "n_lines", "A")
    return banded.groupBy("band").agg(F.count("*").alias("n_blocks"))


@query(
    "q3_threshold_violations",
    f"SELECT * FROM ({LINES_PER_ORDER_SQL}) WHERE n_lines > 10",
)
def threshold_violations_query(spark, sf_dir):
    return gates.threshold_violations(lines_per_order(spark, sf_dir), "n_lines", 10)


@query(
    "q4_first_violation",
    f"SELECT * FROM ({LINES_PER_ORDER_SQL}) WHERE n_lines > 10 ORDER BY l_orderkey LIMIT 1",
)
def first_violation_query(spark, sf_dir):
    return gates.first_violation(threshold_violations_query(spark, sf_dir), ["l_orderkey"])


@query(
    "q5_metric_average",
    f"""
    SELECT *, CASE WHEN metric_avg >= 41 THEN 'F' WHEN metric_avg >= 31 THEN 'E'
                   WHEN metric_avg >= 21 THEN 'D' WHEN metric_avg >= 11 THEN 'C'
                   WHEN metric_avg >= 6 THEN 'B' WHEN metric_avg >= 1 THEN 'A' END AS band
    FROM (SELECT o_orderpriority, sum(n_lines)::BIGINT AS metric_sum, count(*)::BIGINT AS n_blocks,
                 round(sum(n_lines)::DOUBLE / count(*), 6) AS metric_avg
          FROM ({LINES_PER_ORDER_SQL}) JOIN orders ON o_orderkey = l_orderkey
          GROUP BY o_orderpriority)
    """,
)
def metric_average_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    metrics = lines_per_order(spark, sf_dir).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return gates.metric_average(metrics, "n_lines", ["o_orderpriority"])


@query(
    "q6_token_score",
    r"""
    SELECT doc_id, (1 + len(list_filter(string_split_regex(lower(text), '\s+'),
                                        lambda x: x IN ('and', 'for', 'the'))))::INTEGER AS score
    FROM documents
    """,
)
def token_score_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return gates.token_score(documents, "text", ["and", "for", "the"]).drop("text")


@query(
    "q7_exact_clones",
    """
    WITH groups AS (SELECT text, min(doc_id) AS group_id, count(*)::BIGINT AS n
                    FROM documents GROUP BY text HAVING count(*) > 1)
    SELECT group_id, doc_id, n FROM documents JOIN groups USING (text)
    """,
)
def exact_clones_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return clones.exact_clones(documents, "doc_id", "text")


NEAR_DUPLICATES_SQL = """
    WITH words AS (
      SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x09-\\x0D ]+'),
                                 lambda w: w <> '') AS w
      FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                                                    lambda i: w[i:i + 4])) AS s
      FROM words WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
      FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (
      SELECT a, b, c = x.n AND c = y.n AS equal
      FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 10 * c >= 7 * (x.n + y.n - c))
    SELECT doc_id, coalesce(least(doc_id, min(b) FILTER (WHERE equal)), doc_id) AS class_id,
           count(b)::BIGINT AS n_links,
           doc_id <= coalesce(min(b) FILTER (WHERE equal), doc_id) AS representative
    FROM documents LEFT JOIN links ON a = doc_id GROUP BY doc_id
"""


@query("q9_near_duplicates", NEAR_DUPLICATES_SQL)
def near_duplicates_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return similar.near_duplicates(documents, "doc_id", "text")


@query("q9b_near_duplicates_banded")
def near_duplicates_banded_query(spark, sf_dir):
    """Approximate, so without SQL; its links are a part of those of the exact query."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return similar.near_duplicates_banded(documents, "doc_id", "text")


@query(
    "q10_drop_clones",
    """
    SELECT doc_id, text, lang, source, n_chars FROM documents
    WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)
    """,
)
def drop_clones_query(spark, sf_dir):
    return clones.drop_clones(table(spark, sf_dir, "documents"), "doc_id", "text")


WINDOW_CLONES_SQL = """
    WITH lines AS (
      SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no,
             unnest(string_split(text, chr(10))) AS line
      FROM documents),
    windows AS (
      SELECT doc_id, line_no,
             line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w || chr(10)
                  || lead(line, 3) OVER w || chr(10) || lead(line, 4) OVER w || chr(10)
                  || lead(line, 5) OVER w AS body
      FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    repeated AS (SELECT body FROM windows WHERE body IS NOT NULL GROUP BY body HAVING count(*) > 1),
    hits AS (SELECT doc_id, line_no FROM windows WHERE body IN (SELECT body FROM repeated)),
    covered AS (SELECT DISTINCT doc_id, (line_no + i)::INTEGER AS line_no
                FROM hits, (SELECT unnest(range(6)) AS i))
"""


@query("q8_window_clones", f"{WINDOW_CLONES_SQL} SELECT doc_id, line_no FROM covered")
def window_clones_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return clones.window_clones(documents, "doc_id", "text")


@query(
    "q11_duplication_gate",
    f"""
    {WINDOW_CLONES_SQL},
    counts AS (SELECT (SELECT count(*) FROM covered)::BIGINT AS dup_lines,
                      (SELECT count(*) FROM lines)::BIGINT AS total_lines)
    SELECT dup_lines, total_lines, round(100.0 * dup_lines / total_lines, 6)::DOUBLE AS pct,
           100.0 * dup_lines / total_lines > 1.0 AS failed,
           CASE WHEN 100.0 * dup_lines / total_lines > 1.0 THEN 102 ELSE 0 END AS code
    FROM counts
    """,
)
def duplication_gate_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return clones.duplication_gate(documents, "doc_id", "text")


@query(
    "q12_scrape_metric",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no,
             unnest(string_split(text, chr(10))) AS line
      FROM documents),
    matching AS (SELECT doc_id, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM lines
                 WHERE contains(lower(line), 'license') AND contains(lower(line), 'under')
                 GROUP BY doc_id),
    scraped AS (SELECT doc_id, m.line_no,
                       try_cast(regexp_extract(line, '[Vv]ersion ([0-9]+(\.[0-9]+)*)', 1) AS DOUBLE)
                         AS value
                FROM (SELECT DISTINCT doc_id FROM lines) LEFT JOIN matching m USING (doc_id))
    SELECT *, CASE WHEN value IS NULL THEN 'unmeasured' ELSE 'measured' END AS status FROM scraped
    """,
)
def scrape_metric_query(spark, sf_dir):
    lines = to_lines(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return gates.scrape_metric(
        lines, "doc_id", ["license", "under"], r"[Vv]ersion ([0-9]+(\.[0-9]+)*)"
    )


@query(
    "q13_unreferenced_keys",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def unreferenced_keys_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    lineitem = table(spark, sf_dir, "lineitem", "l_orderkey")
    return unused.unreferenced_keys(orders, [(lineitem, ["l_orderkey"])], ["o_orderkey"])


@query(
    "q14_unreferenced_terms",
    r"""
    WITH defs AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '\s+')) AS term FROM benchmark),
    refs AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '\s+')) AS term FROM documents)
    SELECT term FROM defs WHERE term <> '' AND term NOT IN (SELECT term FROM refs)
    """,
)
def unreferenced_terms_query(spark, sf_dir):
    defs = table(spark, sf_dir, "benchmark", "text")
    refs = table(spark, sf_dir, "documents", "text")
    return unused.unreferenced_terms(defs, "text", refs, "text")


@query(
    "q15_exclude",
    """
    SELECT doc_id, source FROM documents
    WHERE NOT starts_with(source, 'src1') AND NOT regexp_full_match(source, 'src.5')
    """,
)
def exclude_query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "source")
    return gates.exclude(documents, "source", ["src1*", "src?5"])


def quality_gates(
    spark, sf_dir, max_complexity: float | str, max_duplicates: float | str, max_unused: float
) -> list[Gate]:
    """Complexity, duplication, unused: the fixed order of the quality step."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    complexity = lines_per_order(spark, sf_dir).agg(F.max("n_lines").alias("measured"))
    unused_keys = unreferenced_keys_query(spark, sf_dir).agg(F.count("*").alias("measured"))
    return [
        Gate("complexity", complexity, "measured", max_complexity),
        Gate("duplication", clones.duplication(documents, "doc_id", "text"), "pct", max_duplicates),
        Gate("unused", unused_keys, "measured", max_unused),
    ]


GATES_SQL = f"""
    {WINDOW_CLONES_SQL},
    measures AS (
      SELECT 1 AS ord, 'complexity' AS gate, 15.0::DOUBLE AS "limit",
             (SELECT max(n_lines) FROM ({LINES_PER_ORDER_SQL}))::DOUBLE AS measured
      UNION ALL SELECT 2, 'duplication', 1.0,
             round(100.0 * (SELECT count(*) FROM covered) / (SELECT count(*) FROM lines), 6)
      UNION ALL SELECT 3, 'unused', 0.0,
             (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))),
    judged AS (SELECT *, measured > "limit" AS failed FROM measures)
"""


@query(
    "q16_gate_summary",
    f"""
    {GATES_SQL}
    SELECT *, CASE WHEN failed THEN 102 ELSE 0 END AS code,
           CASE WHEN ord > (SELECT min(ord) FROM judged WHERE failed) THEN 'skipped'
                WHEN failed THEN 'failed' ELSE 'passed' END AS status
    FROM judged
    """,
)
def gate_summary_query(spark, sf_dir):
    checks = quality_gates(spark, sf_dir, MAX_COMPLEXITY, MAX_DUPLICATES, 0)
    return gates.gate_summary(
        [
            gates.gate_result(g.measure, number, g.name, g.measured, g.limit)
            for number, g in enumerate(checks, start=1)
        ]
    )


# --- settings --------------------------------------------------------------------

LABEL_DEFAULTS = {"labels": {"quality": 1, "toxic": 0}}


@query(
    "c1_overlay",
    """
    WITH defaults AS (SELECT doc_id, 'labels' AS section, unnest(['quality', 'toxic']) AS key,
                             unnest(['1', '0']) AS value FROM documents),
    overrides AS (SELECT doc_id, 'labels' AS section, unnest(['quality', 'toxic']) AS key,
                         unnest([quality::VARCHAR, toxic::VARCHAR]) AS value, true AS present
                  FROM labels)
    SELECT coalesce(d.doc_id, o.doc_id) AS doc_id, coalesce(d.section, o.section) AS section,
           coalesce(d.key, o.key) AS key,
           CASE WHEN o.present THEN o.value ELSE d.value END AS value,
           CASE WHEN o.present THEN 'override' ELSE 'default' END AS origin
    FROM defaults d FULL JOIN overrides o
      ON d.doc_id = o.doc_id AND d.section = o.section AND d.key = o.key
    """,
)
def overlay_query(spark, sf_dir):
    entities = table(spark, sf_dir, "documents", "doc_id")
    labels = table(spark, sf_dir, "labels")
    overrides = overlay.default_rows(labels, {"labels": {"quality": "", "toxic": ""}}).select(
        "doc_id",
        "section",
        "key",
        F.when(F.col("key") == "quality", F.col("quality"))
        .otherwise(F.col("toxic"))
        .cast("string")
        .alias("value"),
    )
    defaults = overlay.default_rows(entities, LABEL_DEFAULTS)
    return overlay.overlay(defaults, overrides, ["doc_id", "section", "key"])


SHIPPED_SQL = ", ".join(
    f"('{section}', '{key}', {'NULL' if value is None else repr(value)})"
    for section, keys in DEFAULT_SETTINGS.items()
    for key, value in keys.items()
)


@query(
    "c1_overlay_shipped",
    f"""
    WITH shipped(section, key, value) AS (VALUES {SHIPPED_SQL}),
    overrides AS (
      SELECT c_custkey, 'quality' AS section, 'max_complexity' AS key, (c_custkey % 30)::VARCHAR AS value
      FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT c_custkey, 'project', 'version', NULL FROM customer WHERE c_custkey % 3 = 1
      UNION ALL SELECT c_custkey, 'build', 'sign', 'true' FROM customer WHERE c_custkey % 3 = 2)
    SELECT coalesce(d.c_custkey, o.c_custkey) AS c_custkey, coalesce(d.section, o.section) AS section,
           coalesce(d.key, o.key) AS key,
           CASE WHEN o.c_custkey IS NULL THEN d.value ELSE o.value END AS value,
           CASE WHEN o.c_custkey IS NULL THEN 'default' ELSE 'override' END AS origin
    FROM (SELECT c_custkey, section, key, value FROM customer, shipped) d FULL JOIN overrides o
      ON d.c_custkey = o.c_custkey AND d.section = o.section AND d.key = o.key
    """,
)
def overlay_shipped_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer", "c_custkey")
    turn = F.col("c_custkey") % 3
    overrides = customers.select(
        "c_custkey",
        F.when(turn == 0, "quality").when(turn == 1, "project").otherwise("build").alias("section"),
        F.when(turn == 0, "max_complexity").when(turn == 1, "version").otherwise("sign").alias("key"),
        F.when(turn == 0, (F.col("c_custkey") % 30).cast("string")).when(turn == 2, "true").alias("value"),
    )
    defaults = overlay.default_rows(customers)
    return overlay.overlay(defaults, overrides, ["c_custkey", "section", "key"])


@query(
    "c1_overlay_maps",
    """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '1' ELSE l.quality::VARCHAR END AS quality,
           CASE WHEN l.doc_id IS NULL THEN '0' WHEN l.toxic = 1 THEN NULL ELSE '0' END AS toxic
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """,
)
def overlay_maps_query(spark, sf_dir):
    # A toxic label of 1 becomes an explicit null, which must win over the default.
    toxic = F.when(F.col("toxic") == 0, F.lit("0"))
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.create_map(
            F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), toxic
        ).alias("overrides"),
    )
    defaults = F.create_map(F.lit("quality"), F.lit("1"), F.lit("toxic"), F.lit("0"))
    merged = (
        table(spark, sf_dir, "documents", "doc_id")
        .join(labels, "doc_id", "left")
        .select("doc_id", overlay.overlay_maps(defaults, F.col("overrides")).alias("merged"))
    )
    return merged.select(
        "doc_id", F.col("merged")["quality"].alias("quality"), F.col("merged")["toxic"].alias("toxic")
    )


@query(
    "c2_known_sections",
    """
    SELECT c_custkey AS entity, lower(c_mktsegment) AS section, 'balance' AS key
    FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')
    """,
)
def known_sections_query(spark, sf_dir):
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(
        F.col("c_custkey").alias("entity"),
        F.lower("c_mktsegment").alias("section"),
        F.lit("balance").alias("key"),
    )
    return overlay.known_sections(rows, ["building", "machinery"])


SETTINGS_CASES = {
    0: '{"project": {"name": "a"}, "quality": {"max_complexity": 15}}',
    1: '{"project": {"name": "a"}, "quality": 15}',
    2: '{"project": null, "quality": {}}',
    3: '{"project": {}, "build": [true], "other": 1}',
    4: '{"quality": {"max_complexity": null}}',
    5: '{"project": {"name"',
}


def planted_settings(spark, sf_dir) -> DataFrame:
    """A settings text per customer, in turn one of the planted cases."""
    case = F.col("c_custkey") % len(SETTINGS_CASES)
    text = F.coalesce(*[F.when(case == i, F.lit(s)) for i, s in SETTINGS_CASES.items()])
    return table(spark, sf_dir, "customer", "c_custkey").withColumn("settings", text)


SETTINGS_SQL = "SELECT c_custkey, CASE {} END AS settings FROM customer".format(
    " ".join(
        f"WHEN c_custkey % {len(SETTINGS_CASES)} = {i} THEN '{s}'" for i, s in SETTINGS_CASES.items()
    )
)


@query(
    "c3_section_type_check",
    f"""
    WITH checked AS (
      SELECT c_custkey, json_valid(settings) AS valid,
             CASE WHEN NOT json_valid(settings) THEN NULL
                  WHEN json_type(settings, '$.project') <> 'OBJECT' THEN 'project'
                  WHEN json_type(settings, '$.build') <> 'OBJECT' THEN 'build'
                  WHEN json_type(settings, '$.quality') <> 'OBJECT' THEN 'quality' END AS bad_section
      FROM ({SETTINGS_SQL}))
    SELECT c_custkey, bad_section,
           CASE WHEN NOT valid OR bad_section IS NOT NULL THEN 101 ELSE 0 END AS code
    FROM checked
    """,
)
def section_type_check_query(spark, sf_dir):
    return overlay.section_type_check(planted_settings(spark, sf_dir), "settings").drop("settings")


@query(
    "c4_settings_lookup",
    """
    WITH planted AS (
      SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{"k": null}'
                            WHEN event_id % 7 = 0 THEN '{"k": {"deep": 1}, "zz": 3}' ELSE props END AS props
      FROM events)
    SELECT event_id,
           CASE json_type(props, '$.k') WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN NULL
             ELSE json_extract_string(props, '$.k')::INTEGER END AS k,
           coalesce(json_extract_string(props, '$.zz')::INTEGER, 15) AS zz,
           coalesce(try_cast(json_extract_string(props, '$.k.deep') AS INTEGER), -1) AS deep
    FROM planted
    """,
)
def settings_lookup_query(spark, sf_dir):
    key = F.col("event_id")
    events = table(spark, sf_dir, "events", "event_id", "props").withColumn(
        "props",
        F.when(key % 5 == 0, '{"k": null}')
        .when(key % 7 == 0, '{"k": {"deep": 1}, "zz": 3}')
        .otherwise(F.col("props")),
    )
    wanted = {"k": ("$.k", "int", 0), "zz": ("$.zz", "int", 15), "deep": ("$.k.deep", "int", -1)}
    return overlay.settings_lookup(events, "props", wanted).drop("props")


# --- changes ---------------------------------------------------------------------


def order_changes(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")

    def having(status: str) -> DataFrame:
        return orders.filter(F.col("o_orderstatus") == status).drop("o_orderstatus")

    return diff.union_changes(
        [("staged", having("F"), 0), ("unstaged", having("O"), 0), ("unpushed", having("P"), 1)]
    )


ORDER_CHANGES_SQL = """
    SELECT o_orderkey, o_custkey,
           CASE o_orderstatus WHEN 'F' THEN 'staged' WHEN 'O' THEN 'unstaged' ELSE 'unpushed' END AS source,
           CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS priority
    FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')
"""


@query("d1_union_changes", ORDER_CHANGES_SQL)
def union_changes_query(spark, sf_dir):
    return order_changes(spark, sf_dir)


@query(
    "d2_first_non_empty",
    f"""
    WITH changes AS ({ORDER_CHANGES_SQL}),
    firsts AS (SELECT o_custkey, min(priority) AS priority FROM changes GROUP BY o_custkey)
    SELECT changes.* FROM changes JOIN firsts USING (o_custkey, priority)
    """,
)
def first_non_empty_query(spark, sf_dir):
    return diff.first_non_empty(order_changes(spark, sf_dir), ["o_custkey"])


def order_snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The orders, and a copy with every tenth under a new key and every tenth changed."""
    old = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    turn = key % 10
    new = old.withColumns(
        {
            "o_orderkey": F.when(turn == 0, -1 - key).otherwise(key),
            "o_orderstatus": F.when(turn == 2, "X").otherwise(F.col("o_orderstatus")),
        }
    )
    return old, new


ORDER_DIFF_SQL = """
    SELECT o_orderkey, o_orderpriority,
           CASE o_orderkey % 10 WHEN 0 THEN 'removed' WHEN 2 THEN 'modified' ELSE 'same' END AS op
    FROM orders
    UNION ALL SELECT -1 - o_orderkey, o_orderpriority, 'added' FROM orders WHERE o_orderkey % 10 = 0
"""


def order_diff(spark, sf_dir, *carry: str) -> DataFrame:
    old, new = order_snapshots(spark, sf_dir)
    return diff.snapshot_diff(old, new, ["o_orderkey"], carry=carry)


@query(
    "d3_snapshot_diff",
    """
    WITH new AS (
      SELECT CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey,
             o_custkey, CASE WHEN o_orderkey % 10 = 2 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
             o_totalprice, o_orderdate, o_orderpriority
      FROM orders),
    joined AS (
      SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
             o.o_orderkey IS NOT NULL AS in_old, n.o_orderkey IS NOT NULL AS in_new,
             concat_ws(',', CASE WHEN o.o_custkey IS DISTINCT FROM n.o_custkey THEN 'o_custkey' END,
               CASE WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END,
               CASE WHEN o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'o_totalprice' END,
               CASE WHEN o.o_orderdate IS DISTINCT FROM n.o_orderdate THEN 'o_orderdate' END,
               CASE WHEN o.o_orderpriority IS DISTINCT FROM n.o_orderpriority THEN 'o_orderpriority' END)
               AS cols
      FROM orders o FULL JOIN new n ON o.o_orderkey = n.o_orderkey)
    SELECT o_orderkey,
           CASE WHEN NOT in_old THEN 'added' WHEN NOT in_new THEN 'removed'
                WHEN cols <> '' THEN 'modified' ELSE 'same' END AS op,
           CASE WHEN in_old AND in_new THEN cols ELSE '' END AS changed_cols
    FROM joined
    """,
)
def snapshot_diff_query(spark, sf_dir):
    changes = order_diff(spark, sf_dir)
    return changes.withColumn("changed_cols", F.concat_ws(",", "changed_cols"))


@query(
    "d4_line_diff",
    """
    WITH old AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    new AS (SELECT doc_id, line FROM old WHERE NOT contains(line, 'License')
            UNION ALL SELECT doc_id, 'Reviewed.' FROM documents WHERE doc_id % 10 = 0),
    net AS (SELECT doc_id, line, sum(sign) AS net
            FROM (SELECT doc_id, line, -1 AS sign FROM old
                  UNION ALL SELECT doc_id, line, 1 FROM new) GROUP BY doc_id, line)
    SELECT doc_id, sum(greatest(net, 0))::BIGINT AS added, sum(greatest(-net, 0))::BIGINT AS removed
    FROM net WHERE net <> 0 GROUP BY doc_id
    """,
)
def line_diff_query(spark, sf_dir):
    old = table(spark, sf_dir, "documents", "doc_id", "text")
    kept = F.filter(lines_of(F.col("text")), lambda line: ~line.contains("License"))
    edited = F.when(F.col("doc_id") % 10 == 0, F.array_append(kept, F.lit("Reviewed."))).otherwise(kept)
    # A text left without any line has no lines, not one empty line.
    new = old.select("doc_id", F.when(F.size(edited) > 0, F.array_join(edited, "\n")).alias("text"))
    return diff.line_diff(old, new, "doc_id", "text")


def drifted_events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Event properties, and a copy where ``k`` is at times text and ``z`` at times there."""
    old = table(spark, sf_dir, "events", "event_id", "props")
    key = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    k_text = F.when(key % 10 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    z_text = F.when(key % 7 == 0, F.lit(', "z": 1')).otherwise(F.lit(""))
    new = old.withColumn("props", F.concat(F.lit('{"k": '), k_text, z_text, F.lit("}")))
    return old, new


@query(
    "d5_field_drift",
    """
    WITH new AS (
      SELECT '{"k": ' || CASE WHEN event_id % 10 = 0 THEN '"' || json_extract_string(props, '$.k') || '"'
                              ELSE json_extract_string(props, '$.k') END
             || CASE WHEN event_id % 7 = 0 THEN ', "z": 1' ELSE '' END || '}' AS props
      FROM events),
    fields AS (
      SELECT 0 AS side, props, unnest(json_keys(props)) AS field FROM events
      UNION ALL SELECT 1, props, unnest(json_keys(props)) FROM new),
    typed AS (
      SELECT side, field, CASE json_type(props, '$.' || field) WHEN 'UBIGINT' THEN 'int'
                            WHEN 'BIGINT' THEN 'int' WHEN 'VARCHAR' THEN 'string' END AS type
      FROM fields),
    counts AS (SELECT field, type, count(*) FILTER (WHERE side = 0) AS old_n,
                      count(*) FILTER (WHERE side = 1) AS new_n
               FROM typed GROUP BY field, type),
    per_field AS (SELECT *, sum(old_n) OVER (PARTITION BY field) AS field_old,
                         sum(new_n) OVER (PARTITION BY field) AS field_new FROM counts)
    SELECT field, CASE WHEN old_n > 0 THEN type END AS old_type,
           CASE WHEN new_n > 0 THEN type END AS new_type,
           old_n::BIGINT AS old_n, new_n::BIGINT AS new_n,
           CASE WHEN field_old = 0 THEN 'added' WHEN field_new = 0 THEN 'removed'
                WHEN old_n > 0 AND new_n > 0 THEN 'same' ELSE 'retyped' END AS op
    FROM per_field
    """,
)
def field_drift_query(spark, sf_dir):
    old, new = drifted_events(spark, sf_dir)
    return diff.field_drift(old, new, "props")


def change_records(spark, sf_dir) -> DataFrame:
    """A change record per event: complete, with an extra field, or not compliant."""
    case = F.col("event_id") % 6
    title = F.concat(F.lit('{"title": "feat: '), F.col("event_type"), F.lit('", '))
    rest = F.lit('"description": "d", "bump_type": "minor"}')
    record = (
        F.when(case == 0, F.concat(title, rest))
        .when(case == 1, F.concat(title, F.lit('"extra": 1, '), rest))
        .when(case == 2, F.concat(F.lit('{"title": 1, '), rest))
        .when(case == 3, F.concat(title, F.lit('"description": "d"}')))
        .when(case == 4, F.concat(title, F.lit('"description": null, "bump_type": "minor"}')))
        .otherwise(F.concat(title, F.lit('"description"')))
    )
    events = table(spark, sf_dir, "events", "event_id", "event_type")
    return events.select("event_id", record.alias("record"))


@query(
    "d6_parse_change_record",
    """
    WITH records AS (
      SELECT event_id, CASE event_id % 6
        WHEN 0 THEN '{"title": "feat: ' || event_type || '", "description": "d", "bump_type": "minor"}'
        WHEN 1 THEN '{"title": "feat: ' || event_type || '", "extra": 1, "description": "d", "bump_type": "minor"}'
        WHEN 2 THEN '{"title": 1, "description": "d", "bump_type": "minor"}'
        WHEN 3 THEN '{"title": "feat: ' || event_type || '", "description": "d"}'
        WHEN 4 THEN '{"title": "feat: ' || event_type || '", "description": null, "bump_type": "minor"}'
        ELSE '{"title": "feat: ' || event_type || '", "description"' END AS record
      FROM events),
    safe AS (SELECT event_id, CASE WHEN json_valid(record) THEN record ELSE '{}' END AS record FROM records),
    checked AS (SELECT *, coalesce(json_type(record, '$.title') = 'VARCHAR', false)
                  AND coalesce(json_type(record, '$.description') = 'VARCHAR', false)
                  AND coalesce(json_type(record, '$.bump_type') = 'VARCHAR', false) AS ok FROM safe)
    SELECT event_id, CASE WHEN ok THEN json_extract_string(record, '$.title') END AS title,
           CASE WHEN ok THEN json_extract_string(record, '$.description') END AS description,
           CASE WHEN ok THEN json_extract_string(record, '$.bump_type') END AS bump_type,
           CASE WHEN ok THEN 0 ELSE 103 END AS code
    FROM checked
    """,
)
def parse_change_record_query(spark, sf_dir):
    return diff.parse_change_record(change_records(spark, sf_dir), "record").drop("record")


def change_titles(spark, sf_dir) -> DataFrame:
    """A change title per event, most of them conventional."""
    kind = F.col("event_type")
    title = (
        F.when(kind == "purchase", F.concat(F.lit("feat(shop)!: "), kind))
        .when(kind == "signup", F.concat(F.lit("feat: "), kind))
        .when(kind == "error", F.concat(F.lit("fix(core): "), kind))
        .when(kind == "view", F.concat(F.lit("docs: BREAKING CHANGE in "), kind))
        .otherwise(kind)
    )
    events = table(spark, sf_dir, "events", "event_id", "event_type")
    return events.select("event_id", title.alias("title"))


TITLES_SQL = """
    SELECT event_id, CASE event_type WHEN 'purchase' THEN 'feat(shop)!: purchase'
             WHEN 'signup' THEN 'feat: signup' WHEN 'error' THEN 'fix(core): error'
             WHEN 'view' THEN 'docs: BREAKING CHANGE in view' ELSE event_type END AS title
    FROM events
"""


@query(
    "d7_classify_title",
    rf"""
    WITH parts AS (
      SELECT event_id, title,
             nullif(regexp_extract(title, '^([a-z]+)(\(([^)]*)\))?(!)?: ', 1), '') AS type,
             nullif(regexp_extract(title, '^([a-z]+)(\(([^)]*)\))?(!)?: ', 3), '') AS scope,
             regexp_extract(title, '^([a-z]+)(\(([^)]*)\))?(!)?: ', 4) = '!'
               OR contains(title, 'BREAKING CHANGE') AS marked
      FROM ({TITLES_SQL}))
    SELECT event_id, title, type, scope, CASE WHEN type IS NOT NULL THEN marked END AS breaking,
           CASE WHEN type IS NULL THEN NULL WHEN marked THEN 'major' WHEN type = 'feat' THEN 'minor'
                ELSE 'patch' END AS bump_type
    FROM parts
    """,
)
def classify_title_query(spark, sf_dir):
    return diff.classify_title(change_titles(spark, sf_dir), "title")


@query(
    "d8_infer_bump",
    f"""
    SELECT 'major' AS bump_type, count(*) FILTER (WHERE op = 'added')::BIGINT AS added,
           count(*) FILTER (WHERE op = 'removed')::BIGINT AS removed,
           count(*) FILTER (WHERE op = 'modified')::BIGINT AS modified, 0 AS code
    FROM ({ORDER_DIFF_SQL})
    """,
)
def infer_bump_query(spark, sf_dir):
    old, new = drifted_events(spark, sf_dir)
    return diff.infer_bump(order_diff(spark, sf_dir), diff.field_drift(old, new, "props"))


@query(
    "d8_infer_bump_cases",
    f"""
    WITH cases AS (
      SELECT unnest(['all', 'grown', 'edited', 'same']) AS kept, o_orderkey, op FROM ({ORDER_DIFF_SQL})),
    seen AS (
      SELECT * FROM cases WHERE kept = 'all' OR op = 'same' OR (kept = 'edited' AND op = 'modified')
                             OR (kept = 'grown' AND op IN ('modified', 'added'))),
    counts AS (
      SELECT kept, count(*) FILTER (WHERE op = 'added')::BIGINT AS added,
             count(*) FILTER (WHERE op = 'removed')::BIGINT AS removed,
             count(*) FILTER (WHERE op = 'modified')::BIGINT AS modified FROM seen GROUP BY kept),
    bumps AS (SELECT *, CASE WHEN removed > 0 THEN 'major' WHEN added > 0 THEN 'minor'
                             WHEN modified > 0 THEN 'patch' END AS bump_type FROM counts)
    SELECT *, CASE WHEN bump_type IS NULL THEN 107 ELSE 0 END AS code FROM bumps
    """,
)
def infer_bump_cases_query(spark, sf_dir):
    kept = {
        "all": ["same", "modified", "added", "removed"],
        "grown": ["same", "modified", "added"],
        "edited": ["same", "modified"],
        "same": ["same"],
    }
    changes = order_diff(spark, sf_dir)
    rows = None
    for name, ops in kept.items():
        row = diff.infer_bump(changes.filter(F.col("op").isin(*ops))).withColumn("kept", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    "d9_change_summary",
    f"""
    WITH counts AS (
      SELECT o_orderpriority, count(*) FILTER (WHERE op = 'added') AS added,
             count(*) FILTER (WHERE op = 'removed') AS removed,
             count(*) FILTER (WHERE op = 'modified') AS modified
      FROM ({ORDER_DIFF_SQL}) GROUP BY o_orderpriority),
    texts AS (
      SELECT o_orderpriority,
             CASE WHEN removed > 0 THEN 'feat(' || o_orderpriority || ')!'
                  WHEN added > 0 THEN 'feat(' || o_orderpriority || ')'
                  ELSE 'fix(' || o_orderpriority || ')' END
               || ': ' || added || ' added, ' || removed || ' removed, ' || modified || ' modified' AS title,
             'changed columns: ' || CASE WHEN modified > 0 THEN 'o_orderstatus (' || modified || ')'
                                         ELSE 'none' END AS description
      FROM counts WHERE added + removed + modified > 0)
    SELECT *, title || chr(10) || chr(10) || description AS message FROM texts
    """,
)
def change_summary_query(spark, sf_dir):
    changes = order_diff(spark, sf_dir, "o_orderpriority")
    summary = diff.change_summary(changes, "o_orderpriority")
    return summary.withColumn(
        "message", diff.change_message(F.col("title"), F.col("description"))
    )


def rule_scorer() -> Callable[[pd.Series], pd.Series]:
    """A stand-in scorer: the rule of ``classify_title``, answered as change records.

    Made here so that it is sent to the tasks by value: they need not have this package.
    """

    def score(titles: pd.Series) -> pd.Series:
        parts = titles.str.extract(r"\A(?P<type>[a-z]+)(?:\([^)]*\))?(?P<mark>!)?: ")
        breaking = parts["mark"].notna() | titles.str.contains("BREAKING CHANGE", regex=False)
        bump = parts["type"].map(lambda kind: "minor" if kind == "feat" else "patch")
        bump = bump.mask(breaking, "major").where(parts["type"].notna(), None)
        return pd.Series(
            [
                json.dumps({"title": title, "description": "scored", "bump_type": kind})
                for title, kind in zip(titles, bump)
            ],
            index=titles.index,
        )

    return score


@query(
    "d10_score_changes",
    f"""
    WITH scored AS (
      SELECT event_id, title,
             CASE WHEN NOT contains(title, ': ') THEN NULL
                  WHEN contains(title, '!: ') OR contains(title, 'BREAKING CHANGE') THEN 'major'
                  WHEN starts_with(title, 'feat') THEN 'minor' ELSE 'patch' END AS bump_type
      FROM ({TITLES_SQL}))
    SELECT event_id, CASE WHEN bump_type IS NOT NULL THEN title END AS title,
           CASE WHEN bump_type IS NOT NULL THEN 'scored' END AS description, bump_type,
           CASE WHEN bump_type IS NULL THEN 103 ELSE 0 END AS code, NULL::VARCHAR AS error
    FROM scored
    """,
)
def score_changes_query(spark, sf_dir):
    return diff.score_changes(change_titles(spark, sf_dir), ["event_id"], "title", rule_scorer())


# --- versions --------------------------------------------------------------------

ODD_VERSIONS = ("1.2", "v1.2.3", "1.2.3.4", "", "1.2.3\n")


def order_versions(spark, sf_dir) -> DataFrame:
    """A version per order, and after it five texts that are no versions, keyed -1 to -5."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders", "o_orderkey")
    good = orders.select(
        key,
        F.concat_ws(
            ".", F.lit("1"), (key % 12).cast("string"), (key % 7).cast("string")
        ).alias("version"),
    )
    lowest = orders.agg(F.min("o_orderkey").alias("o_orderkey"))
    odd = lowest.select(F.posexplode(F.array(*[F.lit(v) for v in ODD_VERSIONS])))
    return good.unionByName(
        odd.select((-1 - F.col("pos")).cast("bigint").alias("o_orderkey"), F.col("col").alias("version"))
    )


ORDER_VERSIONS_SQL = """
    SELECT o_orderkey, '1.' || o_orderkey % 12 || '.' || o_orderkey % 7 AS version FROM orders
    UNION ALL SELECT * FROM (VALUES (-1, '1.2'), (-2, 'v1.2.3'), (-3, '1.2.3.4'), (-4, ''),
                                    (-5, '1.2.3' || chr(10)))
"""

PARSED_VERSIONS_SQL = rf"""
    SELECT o_orderkey, version,
           try_cast(regexp_extract(version, '^([0-9]+)\.([0-9]+)\.([0-9]+)\z', 1) AS BIGINT) AS major,
           try_cast(regexp_extract(version, '^([0-9]+)\.([0-9]+)\.([0-9]+)\z', 2) AS BIGINT) AS minor,
           try_cast(regexp_extract(version, '^([0-9]+)\.([0-9]+)\.([0-9]+)\z', 3) AS BIGINT) AS patch
    FROM ({ORDER_VERSIONS_SQL})
"""


@query(
    "s1_parse_versions",
    f"SELECT *, CASE WHEN major IS NULL THEN 109 ELSE 0 END AS code FROM ({PARSED_VERSIONS_SQL})",
)
def parse_versions_query(spark, sf_dir):
    return versions.parse_versions(order_versions(spark, sf_dir), "version")


@query(
    "s2_bump_versions",
    f"""
    WITH bumped AS (
      SELECT o_orderkey, version,
             CASE WHEN o_orderkey % 5 = 0 THEN 'major' WHEN o_orderkey % 5 = 1 THEN 'minor'
                  WHEN o_orderkey % 5 = 2 THEN 'patch' WHEN o_orderkey % 5 = 3 THEN 'other' END AS bump,
             major, minor, patch
      FROM ({PARSED_VERSIONS_SQL})),
    after AS (
      SELECT o_orderkey, version, bump,
             CASE WHEN major IS NULL THEN NULL WHEN bump = 'major' THEN (major + 1) || '.0.0'
                  WHEN bump = 'minor' THEN major || '.' || (minor + 1) || '.0'
                  WHEN bump = 'patch' THEN major || '.' || minor || '.' || (patch + 1) END AS next_version
      FROM bumped)
    SELECT *, CASE WHEN next_version IS NULL THEN 109 ELSE 0 END AS code FROM after
    """,
)
def bump_versions_query(spark, sf_dir):
    turn = F.col("o_orderkey") % 5
    bump = F.when(turn == 0, "major").when(turn == 1, "minor").when(turn == 2, "patch")
    planted = order_versions(spark, sf_dir).withColumn("bump", bump.when(turn == 3, "other"))
    return versions.bump_versions(planted, "version", "bump")


def user_ledger(spark, sf_dir, **given) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    kind = F.col("event_type")
    bump = (
        F.when(kind == "purchase", "major").when(kind == "signup", "minor").when(kind == "error", "patch")
    )
    bumps = events.select("event_id", "user_id", bump.alias("bump"))
    return versions.version_ledger(bumps, "user_id", "event_id", "bump", start="0.0.0", **given)


LEDGER_SQL = """
    WITH majors AS (
      SELECT event_id, user_id, event_type,
             CASE event_type WHEN 'purchase' THEN 'major' WHEN 'signup' THEN 'minor'
                             WHEN 'error' THEN 'patch' END AS bump,
             sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS m
      FROM events),
    minors AS (SELECT *, sum((event_type = 'signup')::INT)
                           OVER (PARTITION BY user_id, m ORDER BY event_id) AS n FROM majors),
    patches AS (SELECT *, sum((event_type = 'error')::INT)
                            OVER (PARTITION BY user_id, m, n ORDER BY event_id) AS p FROM minors)
"""


@query(
    "s3_version_ledger",
    f"{LEDGER_SQL} SELECT event_id, user_id, bump, m || '.' || n || '.' || p AS version FROM patches",
)
def version_ledger_query(spark, sf_dir):
    return user_ledger(spark, sf_dir)


@query(
    "s3_version_ledger_split",
    f"{LEDGER_SQL} SELECT event_id, user_id, bump, m || '.' || n || '.' || p AS version FROM patches",
)
def version_ledger_split_query(spark, sf_dir):
    """The same ledger with every user cut into ranges of some ten events."""
    return user_ledger(spark, sf_dir, chunk_rows=10)


@query(
    "s4_latest_version",
    f"""
    {LEDGER_SQL}
    SELECT user_id, m || '.' || n || '.' || p AS version FROM patches
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m DESC, n DESC, p DESC) = 1
    """,
)
def latest_version_query(spark, sf_dir):
    return versions.latest_version(user_ledger(spark, sf_dir), ["user_id"], "version")


# --- sinks -----------------------------------------------------------------------

ORDERS_SQL = "SELECT * FROM orders"


@query("p1_build", ORDERS_SQL)
def build_query(spark, sf_dir):
    staging = scratch_path(spark, "build")
    orders = table(spark, sf_dir, "orders")
    build(orders.filter("o_orderstatus = 'F'"), staging)
    return build(orders, staging)


@query("p2_build_formats", ORDERS_SQL)
def build_formats_query(spark, sf_dir):
    staging = scratch_path(spark, "build")
    orders = table(spark, sf_dir, "orders")
    build(orders, staging, ("parquet", "json"))
    return read_built(spark, staging, "json", orders)


@query(
    "p3_publish",
    """
    SELECT o_orderstatus, count(*)::BIGINT AS n_rows, 106 AS second_code FROM orders
    GROUP BY o_orderstatus
    """,
)
def publish_query(spark, sf_dir):
    root = scratch_path(spark, "published")
    orders = table(spark, sf_dir, "orders")
    published = publish(orders, root, "orders", "1.0.0")
    second_code = codes.PASSED
    try:
        publish(orders.filter("o_orderstatus = 'F'"), root, "orders", "1.0.0")
    except GateError as error:
        second_code = error.code
    counts = published.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))
    return counts.withColumn("second_code", F.lit(second_code))


@query(
    "p4_new_rows",
    f"{ORDERS_SQL} WHERE o_orderstatus <> 'F'",
)
def new_rows_query(spark, sf_dir):
    root = scratch_path(spark, "published")
    orders = table(spark, sf_dir, "orders")
    publish(orders.filter("o_orderstatus = 'F'"), root, "orders", "1.0.0")
    kept = publish(orders, root, "orders", "1.0.0", skip_existing=True)
    return new_rows(orders, kept, ["o_orderkey"])


# --- the whole run ---------------------------------------------------------------


def order_release(spark, sf_dir, settings: str, max_unused: float) -> Release:
    """The changed orders as candidate, the documents as the records to be validated."""
    previous, candidate = order_snapshots(spark, sf_dir)
    scratch = scratch_path(spark, "release")
    return Release(
        name="orders",
        root=f"{scratch}/published",
        staging=f"{scratch}/staging",
        candidate=candidate,
        previous=previous,
        keys=["o_orderkey"],
        verdicts=text_verdicts(spark, sf_dir),
        verdict_key="doc_id",
        gates=quality_gates(spark, sf_dir, "max_complexity", "max_duplicates", max_unused),
        max_invalid_pct=25.0,
        settings=settings,
    )


REPORT_SQL_HEAD = f"""
    {GATES_SQL},
    verdicts AS ({TEXT_VERDICTS_SQL}),
    changes AS ({ORDER_DIFF_SQL}),
    validated AS (SELECT count(*) FILTER (WHERE code <> 0) || ' of ' || count(*) || ' records failed'
                    AS message FROM verdicts)
"""


@query(
    "r1_release_report",
    f"""
    {REPORT_SQL_HEAD}
    SELECT 1 AS step, 'validation' AS name, 20 AS pct, 'passed' AS status, 0 AS code, message FROM validated
    UNION ALL SELECT 2, 'quality', 20, 'failed', 102,
      printf('%s %.2f above %.2f', gate, measured, "limit") FROM judged
      WHERE ord = (SELECT min(ord) FROM judged WHERE failed)
    UNION ALL SELECT * FROM (VALUES (3, 'changes', 20, 'skipped', NULL, NULL),
      (4, 'version', 20, 'skipped', NULL, NULL), (5, 'publish', 20, 'skipped', NULL, NULL))
    """,
)
def release_report_query(spark, sf_dir):
    return release(spark, order_release(spark, sf_dir, "{}", max_unused=0))


@query(
    "r1_release_published",
    f"""
    {REPORT_SQL_HEAD}
    SELECT 1 AS step, 'validation' AS name, 20 AS pct, 'passed' AS status, 0 AS code, message FROM validated
    UNION ALL SELECT 2, 'quality', 40, 'passed', 0, '3 gates passed'
    UNION ALL SELECT 3, 'changes', 60, 'passed', 0,
      'major: ' || count(*) FILTER (WHERE op = 'added') || ' added, '
        || count(*) FILTER (WHERE op = 'removed') || ' removed, '
        || count(*) FILTER (WHERE op = 'modified') || ' modified' FROM changes
    UNION ALL SELECT 4, 'version', 80, 'passed', 0, '0.1.0 -> 1.0.0'
    UNION ALL SELECT 5, 'publish', 100, 'passed', 0,
      count(*) FILTER (WHERE op <> 'removed') || ' rows as 1.0.0' FROM changes
    """,
)
def release_published_query(spark, sf_dir):
    settings = '{"quality": {"max_complexity": 50, "max_duplicates": 100.0}}'
    return release(spark, order_release(spark, sf_dir, settings, max_unused=float("inf")))


@query(
    "r1_release_empty",
    f"""
    SELECT 1 AS step, 'validation' AS name, 0 AS pct, 'failed' AS status, 112 AS code,
           'the candidate has no rows' AS message
    UNION ALL SELECT * FROM (VALUES (2, 'quality', 0, 'skipped', NULL, NULL),
      (3, 'changes', 0, 'skipped', NULL, NULL), (4, 'version', 0, 'skipped', NULL, NULL),
      (5, 'publish', 0, 'skipped', NULL, NULL))
    """,
)
def release_empty_query(spark, sf_dir):
    plan = order_release(spark, sf_dir, "{}", max_unused=0)
    return release(spark, replace(plan, candidate=plan.candidate.filter("o_orderkey IS NULL")))


@query(
    "r1_release_repeated_previous",
    f"""
    SELECT 1 AS step, 'validation' AS name, 0 AS pct, 'failed' AS status, 112 AS code,
           'keys of the previous rows are not unique: o_orderkey' AS message
    UNION ALL SELECT * FROM (VALUES (2, 'quality', 0, 'skipped', NULL, NULL),
      (3, 'changes', 0, 'skipped', NULL, NULL), (4, 'version', 0, 'skipped', NULL, NULL),
      (5, 'publish', 0, 'skipped', NULL, NULL))
    """,
)
def release_repeated_previous_query(spark, sf_dir):
    plan = order_release(spark, sf_dir, "{}", max_unused=0)
    return release(spark, replace(plan, previous=plan.previous.unionByName(plan.previous)))


DOCUMENT_RELEASE_SQL = f"""
    WITH candidate AS (
      SELECT doc_id, source, CASE WHEN doc_id % 10 = 2 THEN text || chr(10) || 'Reviewed.' ELSE text END AS text
      FROM documents
      WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)),
    {WINDOW_CLONES_SQL.strip().removeprefix("WITH ").replace("FROM documents", "FROM candidate")},
    checked AS ({TEXT_VERDICTS_SQL.replace("FROM documents", "FROM candidate")}),
    changes AS (
      SELECT count(*) FILTER (WHERE c.doc_id IS NULL) AS removed,
             count(*) FILTER (WHERE c.text IS DISTINCT FROM d.text AND c.doc_id IS NOT NULL) AS modified
      FROM documents d LEFT JOIN candidate c USING (doc_id)),
    bumped AS (SELECT *, CASE WHEN removed > 0 THEN 'major' ELSE 'patch' END AS bump,
                      CASE WHEN removed > 0 THEN '2.0.0' ELSE '1.4.3' END AS version FROM changes)
"""


@query(
    "r1_release_documents",
    f"""
    {DOCUMENT_RELEASE_SQL}
    SELECT 1 AS step, 'validation' AS name, 20 AS pct, 'passed' AS status, 0 AS code,
           count(*) FILTER (WHERE code <> 0) || ' of ' || count(*) || ' records failed' AS message FROM checked
    UNION ALL SELECT 2, 'quality', 40, 'passed', 0, '1 gates passed'
      WHERE 100.0 * (SELECT count(*) FROM covered) / (SELECT count(*) FROM lines) <= 99.0
    UNION ALL SELECT 3, 'changes', 60, 'passed', 0,
      bump || ': 0 added, ' || removed || ' removed, ' || modified || ' modified' FROM bumped
    UNION ALL SELECT 4, 'version', 80, 'passed', 0, '1.4.2 -> ' || version FROM bumped
    UNION ALL SELECT 5, 'publish', 100, 'passed', 0,
      (SELECT count(*) FROM candidate) || ' rows as ' || version FROM bumped
    """,
)
def release_documents_query(spark, sf_dir):
    """One dataset checked, measured, compared and published: the documents without clones."""
    scratch = scratch_path(spark, "release")
    previous = table(spark, sf_dir, "documents")
    edited = F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("\nReviewed.")))
    distinct = clones.drop_clones(previous, "doc_id", "text")
    # Several steps read the candidate, so it is a table before they start.
    candidate = build(distinct.withColumn("text", edited.otherwise(F.col("text"))), f"{scratch}/candidate")
    plan = Release(
        name="documents",
        root=f"{scratch}/published",
        staging=f"{scratch}/staging",
        candidate=candidate,
        previous=previous,
        keys=["doc_id"],
        verdicts=verdicts_of(candidate.select("doc_id", "text")),
        verdict_key="doc_id",
        gates=[Gate("duplication", clones.duplication(candidate, "doc_id", "text"), "pct", "max_duplicates")],
        max_invalid_pct=25.0,
        settings='{"project": {"version": "1.4.2"}, "quality": {"max_duplicates": 99.0}}',
    )
    return release(spark, plan)


@query(
    "r2_with_code_name",
    f"""
    SELECT doc_id, code, CASE code WHEN 0 THEN 'PASSED' WHEN 113 THEN 'MISSING_README'
                                   WHEN 114 THEN 'INVALID_README' END AS code_name
    FROM ({TEXT_VERDICTS_SQL})
    """,
)
def with_code_name_query(spark, sf_dir):
    return with_code_name(text_verdicts(spark, sf_dir).select("doc_id", "code"))


# --- streams ---------------------------------------------------------------------


@query("x1_streaming_validation", f"SELECT *, CASE code WHEN 0 THEN 'good' ELSE 'reject' END AS outcome FROM ({TEXT_VERDICTS_SQL})")
def streaming_validation_query(spark, sf_dir):
    """The verdicts of the documents, judged as a stream of files in batches of at most 16."""
    scratch = scratch_path(spark, "validation")
    documents = stream_dataset(spark, f"{sf_dir}/documents.parquet", files_per_batch=16)

    def judge(batch: DataFrame) -> DataFrame:
        return verdicts_of(batch.select("doc_id", "text", "source"), "source")

    split_stream(documents, judge, f"{scratch}/judged", f"{scratch}/checkpoint")
    schema = verdicts_of(table(spark, sf_dir, "documents", "doc_id", "text", "source"), "source").schema
    return judged_records(spark, f"{scratch}/judged", schema)


EVENTS_PER_DAY = 100


@query(
    "x2_windowed_gate",
    f"""
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n_rows,
           count(*) > {EVENTS_PER_DAY} AS failed, CASE WHEN count(*) > {EVENTS_PER_DAY} THEN 102 ELSE 0 END AS code
    FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    GROUP BY ALL
    """,
)
def windowed_gate_query(spark, sf_dir):
    """Events per day and type, for the days that the stream has closed."""
    scratch = scratch_path(spark, "windows")
    events = stream_dataset(spark, f"{sf_dir}/events.parquet").select("ts", "event_type")
    gate = windowed_gate(events, "ts", ["event_type"], EVENTS_PER_DAY)
    append_to(gate, f"{scratch}/closed", f"{scratch}/checkpoint")
    closed = spark.read.schema(gate.schema).parquet(f"{scratch}/closed")
    return closed.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_rows", "failed", "code")


@query("x3_streaming_deduplication", "SELECT event_id, user_id, event_type, value FROM events")
def streaming_deduplication_query(spark, sf_dir):
    """The events without repeats, from a stream that brings each of them twice."""
    scratch = scratch_path(spark, "repeats")
    events = stream_dataset(spark, f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    once = without_repeats(events.unionByName(events), ["event_id"], "ts")
    append_to(once, f"{scratch}/once", f"{scratch}/checkpoint")
    return spark.read.schema(once.schema).parquet(f"{scratch}/once").drop("ts")
