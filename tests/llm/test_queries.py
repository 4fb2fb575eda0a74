"""The registered queries over whole tables against plain versions and held-out labels."""

import hashlib
import math
import zlib
from collections import defaultdict

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from relgate.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def result(spark, name):
    return QUERIES[name][0](spark, SF_DIR).toPandas()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels():
    return pd.read_parquet(f"{SF_DIR}/labels.parquet")


def test_pii(spark, docs):
    found = result(spark, "op1_pii").set_index("doc_id")
    assert sorted(found.index) == sorted(docs.doc_id)
    for doc_id, text in zip(docs.doc_id, docs.text):
        row, spans = found.loc[doc_id], brute.base_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in brute.KINDS] == [sum(s[0] == k for s in spans) for k in brute.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(row.spans.split(","))


@pytest.mark.parametrize("name, label, folds, out", [("op2_toxicity", "toxic", 5, 0), ("op8_quality", "quality", 3, 1)])
def test_classifiers_on_held_out_labels(spark, docs, labels, name, label, folds, out):
    found = result(spark, name)
    assert sorted(found.doc_id) == sorted(docs.doc_id) and found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(lambda i: brute.crc(i, folds) == out)).all()
    assert (found.predicted == (found.score >= 0.5)).all()
    held = found[found.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held[label]).mean() >= 0.93


def test_language_on_held_out_documents(spark, docs):
    found = result(spark, "op10_language").merge(docs, on="doc_id")
    assert len(found) == len(docs) and found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(lambda i: brute.crc(i, 4) == 2)).all()
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.97


def test_packing_is_a_round_trip(spark, docs):
    pieces = result(spark, "op3_packing")
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    by_doc = dict(tuple(pieces.groupby("doc_id")))
    assert len(by_doc) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = np.array(encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in by_doc[doc_id].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for _, rows in pieces.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]]
        total = rows.length.sum()
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0


def test_near_duplicates(spark, docs):
    found = result(spark, "op4_near_dedup").set_index("doc_id")
    expected = brute.near_texts(dict(zip(docs.doc_id, docs.text)), 4)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.iterrows()} == expected
    assert (found.kept == (found.index == found.component_id)).all()


def test_language_model(spark, docs):
    found = result(spark, "op5_lm_scores").set_index("doc_id")
    tokens = {i: [*brute.words(t), None] for i, t in zip(docs.doc_id, docs.text)}
    count = defaultdict(int)
    for i, seen in tokens.items():
        if brute.crc(i, 7) != 2:
            for w in seen:
                count[w] += 1
    n, v = sum(count.values()), len(count)
    for i, seen in tokens.items():
        row = found.loc[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(seen), sum(w in count for w in seen), n)
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in seen)
        assert row.base_score == pytest.approx(base, rel=1e-9)
    held = found[found.held_out]
    assert len(held) and (held.score < 0).all() and held.score.sum() > held.base_score.sum()


def test_embedding_links(spark):
    rows = pd.read_parquet(f"{SF_DIR}/embeddings.parquet")
    found = result(spark, "op6_embedding_dedup").set_index("vec_id")
    expected = brute.near_vectors(list(zip(rows.vec_id, rows.embedding, rows.label)))
    assert {i: (r.n_links, r.component_id) for i, r in found.iterrows()} == expected


def test_mixing(spark, docs):
    found = result(spark, "op7_mixing").merge(docs, on="doc_id")
    assert len(found) == len(docs)
    assert (found["size"] == found.text.map(lambda t: len(brute.words(t)))).all()
    assert (found.taken <= 3 * found["size"]).all()
    sizes = found.groupby("source")["size"].sum().to_dict()
    expected = brute.targets(sizes)
    for source, rows in found.groupby("source"):
        assert (rows.source_size == sizes[source]).all()
        assert rows.target.iloc[0] == pytest.approx(expected[source], rel=1e-9)
        assert abs(rows.taken.sum() - expected[source]) <= 0.01 * expected[source] + 1
    again = result(spark, "op7_mixing").merge(found, on="doc_id")
    assert (again.taken_x == again.taken_y).all()


def test_nearest(spark):
    rows = pd.read_parquet(f"{SF_DIR}/embeddings.parquet")
    found = result(spark, "op9_nearest")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))][:10]
        mine = found[found.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert mine.score.tolist() == pytest.approx([d[ids == i][0] for i in mine.vec_id], rel=1e-12)
        assert mine.score.is_monotonic_increasing
        hits += len(set(best) & set(mine.vec_id))
        total += 10
    assert hits / total >= 0.9
