"""The whole pipeline against a plain version of its stages."""

import brute
import pandas as pd

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.toPandas()
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF_DIR).toPandas()
        if name == "toxicity":
            gone = set(before.doc_id) - set(after.doc_id)
            assert len(gone & set(labels[labels.toxic == 0].doc_id)) <= 3
        elif name == "near_dedup":
            roots = brute.near_texts(dict(zip(before.doc_id, before.text)), 5)
            assert sorted(after.doc_id) == sorted(i for i, (_, root) in roots.items() if root == i)
        elif name == "pii":
            assert not any(brute.base_spans(t) for t in after.text)
            clean = [not brute.base_spans(t) for t in before.text]
            both = before[clean].merge(after, on="doc_id")
            assert (both.text_x == both.text_y).mean() > 0.9 and len(after) == len(before)
        elif name == "mixing":
            assert after.doc_id.value_counts().max() <= 3 and set(after.doc_id) <= set(before.doc_id)
            words = after.text.map(lambda t: len(brute.words(t))).groupby(after.source).sum()
            target = brute.targets(before.text.map(lambda t: len(brute.words(t))).groupby(before.source).sum().to_dict())
            assert abs(words.sum() - sum(target.values())) < 0.1 * sum(target.values())
        else:
            assert after.length.sum() >= after.groupby("doc_id").doc_tokens.first().sum()
        before, docs = after, spark.createDataFrame(after)
