"""A training corpus from raw documents: the stages in order, and the whole run."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgate.llm import mixing, near_dedup, packing, pii, toxicity
from relgate.llm.common import fold, read, small_batches, written
from relgate.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL can express trained scores, tokenizers and packing; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    small_batches(spark)
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", fold("doc_id", 5) != 0)
    return docs.select(*COLUMNS).filter(toxicity.score_column("text", model) < 0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Of rows that repeat an id, those of equal text are one document, the first by its other
    columns, and those of other texts are documents of their own. One of them, with the
    smallest text digest, counts by its id, the others as later than any id below 2**62.
    Documents without an id all stay.
    """
    small_batches(spark)
    rows = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("place"))
    named = rows.filter("doc_id is not null")
    again = named.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = written(again, "repeated-ids")
    if not again.isEmpty():
        rest = F.struct("lang", "source", "n_chars")
        texts = named.join(again, "doc_id", "left_semi").withColumn("digest", F.sha2("text", 256))
        texts = texts.groupBy("doc_id", "digest").agg(F.min("text").alias("text"), F.min(rest).alias("rest"))
        texts = written(texts, "repeated-texts")
        first = texts.groupBy("doc_id").agg(F.min(F.coalesce("digest", F.lit(""))).alias("first"))
        later = F.shiftrightunsigned(F.xxhash64("doc_id", "digest"), 2).bitwiseOR(F.lit(1 << 62))
        place = F.when(F.coalesce("digest", F.lit("")) == F.col("first"), F.col("doc_id").cast("long")).otherwise(later)
        texts = texts.join(first, "doc_id").select("doc_id", "text", "rest.*", place.alias("place"))
        named = written(named.join(again, "doc_id", "left_anti").unionByName(texts), "distinct-documents")
    groups = near_dedup.near_duplicates(named, "place", "text")
    kept = groups.filter("kept").select("place")
    one_each = named.join(kept, "place", "left_semi").select(*COLUMNS)
    return one_each.unionByName(docs.select(*COLUMNS).filter("doc_id is null"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    small_batches(spark)
    rows = docs.select(
        F.struct("doc_id", "lang", "source", "n_chars").alias("kept"), F.col("text").alias("raw")
    )
    found = pii.find_spans(rows, "kept", "raw", redacted=True)
    return found.select(
        "kept.doc_id",
        F.col("redacted").alias("text"),
        "kept.lang",
        "kept.source",
        F.when(F.size("spans") > 0, F.length("redacted").cast("long"))
        .otherwise(F.col("kept.n_chars"))
        .alias("n_chars"),
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed_rows(docs.select(*COLUMNS), "doc_id", "source", "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they stand in which sequence."""
    small_batches(spark)
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
