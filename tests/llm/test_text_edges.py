"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relgate.llm import ann, components, embed_dedup, langid, lm, mixing, near_dedup, packing, pii, quality, toxicity
from relgate.llm.queries import TOKENIZER

LONG = " ".join(f"word{i % 977}" for i in range(60_000)) + " write to a.b@c.de"
BASE = [f"w{i}" for i in range(60)]
TEXTS = [
    (1, "Call +1 (017) 555-7713 or mail x.y@mail.example.com\nnow", "en", "a"),
    (1, "Call +1 (017) 555-7713 or mail x.y@mail.example.com\nnow", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "b"),
    (4, LONG, "de", "b"),
    (5, " ".join(BASE), "fr", "é"),
    (6, " ".join([*BASE, "x"]), "fr", "é"),
    (7, " ".join(BASE).upper(), None, "é"),
    (None, " ".join(BASE), "fr", None),
    (8, " \n\t\r ", "en", ""),
    (9, "!?\n\n12 34", "en", "a"),
]
# Names that the operators use inside or return.
EXTRA = ("key", "id", "spans", "score", "size", "held", "v", "component_id", "n_chars", "digest", "target")
KEYS = [r[0] for r in TEXTS]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.select("*", *(F.lit(7).cast("long").alias(name) for name in EXTRA))


@pytest.fixture(scope="module", params=[TEXTS, []], ids=["rows", "empty"])
def docs(request, spark):
    return frame(spark, request.param)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (4, 0, 1), (5, 1, None), (None, 0, 0), (6, None, 1), (6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int").withColumn("text", F.lit(1))


def keys(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=lambda k: (k is None, k))


def all_keys(docs):
    return keys(docs)


def test_pii(docs):
    found = pii.find_spans(docs, "doc_id", "text", redacted=True)
    assert found.columns == ["doc_id", "spans", "redacted"] and keys(found) == all_keys(docs)
    for r in found.collect():
        text = {k: t for k, t, *_ in TEXTS}[r.doc_id]
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS]
        assert base == brute.base_spans(text)
        assert (r.redacted is None) == (text is None)
        assert "@" not in (r.redacted or "") and all(s.value == text[s.start : s.end] for s in r.spans)


def test_classifiers(docs, labels):
    toxic = toxicity.fit(docs, labels, "doc_id", "text", "toxic", F.lit(True))
    good = quality.fit(docs, labels, "doc_id", "text", "quality", F.lit(True), quality.Settings(rounds=2, steps=3))
    for found in (toxicity.score(docs, "doc_id", "text", toxic), quality.score(docs, "doc_id", "text", good)):
        assert found.columns == ["doc_id", "score"] and keys(found) == all_keys(docs)
        assert all(0 <= r.score <= 1 for r in found.collect())


def test_language(docs):
    profiles = langid.fit(docs, "text", "lang", F.lit(True))
    found = langid.predict(docs, "doc_id", "text", profiles)
    assert keys(found) == all_keys(docs)
    by_key = {r.doc_id: r for r in found.collect()}
    for k in set(by_key) & {2, 3, 8, 9}:
        assert by_key[k][1:] == ("und", 0.0)
    assert not by_key or by_key[7].lang_pred == "fr"


def test_packing(docs):
    for block in (4096, packing.BLOCK_TOKENS):
        pieces = packing.pack(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER), block_tokens=block)
        rows = pieces.collect()
        assert {r.doc_id for r in rows} == set(all_keys(docs))
        lengths, sequences = {}, {}
        for r in rows:
            lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for r in rows:
            assert lengths[r.doc_id] == r.doc_tokens * KEYS.count(r.doc_id)
        for parts in sequences.values():
            parts.sort()
            assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]]
            total = sum(p[1] for p in parts)
            assert total <= 2048 and total & (total - 1) == 0


def test_near_duplicates(docs):
    found = near_dedup.near_duplicates(docs, "doc_id", "text", words=4)
    assert keys(found) == all_keys(docs)
    expected = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, None: None, 8: 8, 9: 9}
    assert all(r.component_id == expected[r.doc_id] for r in found.collect())
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


@pytest.mark.parametrize("region", [8, 128])
def test_large_groups_of_near_copies(spark, monkeypatch, region):
    """Regions beyond the bound are taken deeper, and their classes joined exactly in the end."""
    monkeypatch.setattr(near_dedup, "REGION", region)
    rng, rows = np.random.default_rng(4), []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(120)]
        for _ in range(60):
            copy = list(words)
            for i in rng.integers(0, 120, rng.integers(0, 3)):
                copy[i] = f"r{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(copy), None, None))
    found = near_dedup.near_duplicates(frame(spark, rows), "doc_id", "text")
    expected = brute.near_texts({r[0]: r[1] for r in rows}, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected


@pytest.mark.parametrize("region", [8, 128])
def test_twins_in_a_crowd_equal_brute_force(spark, monkeypatch, region):
    """Copies of one text that are too far from each other but for their twins."""
    monkeypatch.setattr(near_dedup, "REGION", region)
    rng, rows = np.random.default_rng(7), []
    words = [f"w{i}" for i in range(150)]
    for g in range(150):
        twin = list(words)
        twin[rng.integers(5, 145)] = f"t{g}"
        for _ in range(2):
            copy = list(twin)
            copy[rng.integers(5, 145)] = f"r{rng.integers(1 << 30)}"
            rows.append((len(rows) * 7919 % 10007, " ".join(copy), None, None))
    found = near_dedup.near_duplicates(frame(spark, rows), "doc_id", "text")
    expected = brute.near_texts({r[0]: r[1] for r in rows}, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected


def test_links_between_dealt_parts(spark, monkeypatch):
    """Texts that agree at the last depth are dealt into parts; links between parts stay."""
    monkeypatch.setattr(near_dedup, "REGION", 2)
    monkeypatch.setattr(near_dedup, "DEPTHS", (1, 7))
    rng, rows = np.random.default_rng(9), []
    words = [f"w{i}" for i in range(150)]
    for g in range(40):
        twin = list(words)
        twin[5 + 7 * (g % 20)] = f"t{g}"
        for _ in range(2):
            copy = list(twin)
            copy[5 + 7 * ((g + 5) % 20)] = f"r{rng.integers(1 << 30)}"
            copy[5 + 7 * ((g + 10) % 20)] = f"q{g}"
            rows.append((len(rows) * 7919 % 10007, " ".join(copy), None, None))
    found = near_dedup.near_duplicates(frame(spark, rows), "doc_id", "text")
    expected = brute.near_texts({r[0]: r[1] for r in rows}, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected


def test_texts_of_a_repeated_key(spark):
    """Each text of a key is linked, whichever comes first."""
    texts = {t: [f"{t}{i}" for i in range(60)] for t in "abcde"}
    rows = [(5, " ".join(texts["a"])), (5, " ".join(texts["b"])), (5, None)]
    rows += [(7, " ".join([*texts["a"], "x"])), (9, " ".join([*texts["b"], "x"]))]
    rows += [(20 + i, " ".join(texts[t])) for i, t in enumerate("cde")] + [(30, " ".join(texts[t])) for t in "cde"]
    found = near_dedup.near_duplicates(frame(spark, [(*r, None, None) for r in rows]), "doc_id", "text")
    expected = {5: 5, 7: 5, 9: 5, 20: 20, 21: 20, 22: 20, 30: 20}
    assert {(r.doc_id, r.component_id) for r in found.collect()} == set(expected.items())


def test_one_passage_in_many_texts(spark, monkeypatch):
    """Texts that share a passage meet in blocks and grids; links between them are as by brute force."""
    monkeypatch.setattr(near_dedup, "REGION", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dedup, "HOT_SHINGLES", 400)
    monkeypatch.setattr(near_dedup, "HOT_POSTING", 16)
    rng, rows = np.random.default_rng(11), []
    passage = [f"p{i}" for i in range(100)]
    for g in range(120):
        own = [f"g{g}w{i}" for i in range(int(rng.integers(8, 30)))]
        rows.append((len(rows) * 7919 % 10007, " ".join([*passage, *own]), None, None))
        if g % 5 == 0:
            rows.append((len(rows) * 7919 % 10007, " ".join([*passage, *own, f"x{g}"]), None, None))
    found = near_dedup.near_duplicates(frame(spark, rows), "doc_id", "text")
    expected = brute.near_texts({r[0]: r[1] for r in rows}, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected


@pytest.mark.parametrize("few", [0, 30, 200_000])
def test_components_equal_plain_search(spark, monkeypatch, few):
    """Rounds, one task, and rounds that end in one task give the same components."""
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))]
    links += [(i, i + 1) for i in range(100, 130)] + [(1, None), (7, 7)]
    label = {x: x for pair in links for x in pair if x is not None and None not in pair and pair[0] != pair[1]}
    for _ in label:
        for a, b in links:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted(label.items())


def test_components_settle(spark, monkeypatch):
    """No bound on rounds ends the search early."""
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(links).collect()} == {(i, 0) for i in range(41)}


def test_language_model(docs):
    found = lm.scored(docs, "doc_id", "text", F.coalesce(F.col("doc_id") == 9, F.lit(False)))
    assert keys(found) == all_keys(docs)
    for r in found.collect():
        assert r.n_tokens == len(brute.words({k: t for k, t, *_ in TEXTS}[r.doc_id])) + 1
        assert np.isfinite(r.score) and r.score <= 0
    none = lm.scored(docs, "doc_id", "text", F.lit(True))
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in none.collect())


def test_mixing(docs):
    found = mixing.mix(docs, "doc_id", "source", "text").collect()
    assert len(found) == docs.count()
    sizes = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        assert 0 <= r.taken <= 3 * r["size"]
    expected = brute.targets(sizes) if sizes else {}
    assert all(r.target == pytest.approx(expected[r.source]) for r in found)


def test_mixing_refines_boundaries(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 4)
    rows = [(i, "a " * (1 + i % 13), None, f"s{i % 3}") for i in range(900)]
    found = mixing.mix(frame(spark, rows), "doc_id", "source", "text").toPandas()
    for source, part in found.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 13
    assert len(found) == 900


def test_mixing_fills_a_repeated_key(spark, monkeypatch):
    """A third of a source without keys is filled as far as the budget goes."""
    monkeypatch.setattr(mixing, "FEW", 4)
    rows = [(i if i % 3 else None, "a " * (1 + i % 13), None, f"s{i % 2}") for i in range(900)]
    rows += [(5000, "a " * (1 + i % 7), None, "s2") for i in range(300)]
    found = mixing.mix(frame(spark, rows), "doc_id", "source", "text").toPandas()
    assert len(found) == 1200
    for source, part in found.groupby("source"):
        assert -0.5 <= part.target.iloc[0] - part.taken.sum() + 0.5 <= 14, source
        assert part["size"].sum() == sum(len(r[1].split()) for r in rows if r[3] == source)


VECTORS = [
    (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.01, 0.0], 1), (4, [1.0, 0.0, 0.0], 2),
    (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [1.0, None, 0.0], 1),
    (9, [1.0, 0.0, 0.0], None), (10, [0.0, 1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [], 1),
    (13, [float("inf"), 0.0, 0.0], 1), (100, [1.0, 0.0, 0.0], 2), (200, None, 1),
]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int")
    return rows.select("*", *(F.lit(7).alias(name) for name in (*EXTRA, "cell", "leaf", "n")))


def test_embedding_links(vectors):
    found = embed_dedup.near_vectors(vectors, "vec_id", "embedding", "label")
    expected = brute.near_vectors([r[:3] for r in VECTORS])
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == expected
    none = embed_dedup.near_vectors(vectors.limit(0), "vec_id", "embedding", "label")
    assert none.columns == found.columns and none.count() == 0


@pytest.mark.parametrize("block", [16, 2048])
def test_planted_embedding_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = [
        (i, [float(x) for x in centres[i % 30] + rng.normal(size=16) * 0.08 * (i % 4)], i % 2) for i in range(300)
    ]
    rows += [(300 + i, rows[0][1], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = embed_dedup.near_vectors(df, "vec_id", "embedding", "label")
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == brute.near_vectors(rows)


def test_nearest(vectors):
    found = ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", k=3).collect()
    # Ties go to the smaller id; 200 has no vector and asks nothing.
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [
        (100, 1, 1), (100, 2, 4), (100, 3, 9),
    ]
    every = ann.nearest(vectors, vectors.filter("vec_id = 100"), "vec_id", "embedding", k=50)
    assert every.count() == 7
    assert ann.nearest(vectors.limit(0), vectors.limit(0), "vec_id", "embedding").count() == 0


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    docs.count()
