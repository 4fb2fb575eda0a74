"""Lexical search, token counts and the prefix trie: SQL, the public library and plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from compare import connect, differences
from pyspark.sql import functions as F

from relgate.llm import lexical, prefix_trie, token_counts
from relgate.llm.queries import COUNTED, QUERIES

SF_DIR = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path(COUNTED)
EXTRA = ("key", "id", "score", "rank", "item", "n", "depth", "conv", "at", "terms", "digest")


def extended(df):
    return df.select("*", *(F.lit(7).cast("long").alias(name) for name in EXTRA))


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_prefix_trie"])
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", SF_DIR])
def test_equal_to_sql(spark, name, sf_dir):
    run, sql = QUERIES[name]
    assert differences(run(spark, sf_dir), connect(sf_dir), sql) == []


# -- token counts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts_of_whole_table(spark, library):
    found = QUERIES["op12_token_counts"][0](spark, SF_DIR).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    assert sorted(found.index) == sorted(docs.doc_id)
    for doc_id, text in zip(docs.doc_id, docs.text):
        row = found.loc[doc_id]
        n = len(library.encode(text or ""))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), n, n > 4096)


def test_token_counts_of_random_texts(library):
    counter = token_counts.Counter(token_counts.load(MODEL))
    draw = random.Random(3)
    pool = [*" ▁\n\t\0é中文😀1.,ßΩ", "  ", "‍", "<s>", "</s>", "<unk>", "<0x0A>", "a", "the", " the", "ing", "\r\n", "�"]
    for _ in range(3000):
        text = "".join(draw.choices(pool, k=draw.randint(0, 30)))
        assert counter.tokens(text) == len(library.encode(text)), text


@pytest.mark.parametrize("unit", ["ab", "word ", " ", "\n", "the, ", "中"])
def test_token_counts_of_very_long_texts(library, unit):
    counter = token_counts.Counter(token_counts.load(MODEL))
    text = unit * (2_500_000 // len(unit) if " " in unit.strip() + " " and len(unit) > 1 else 300_000)
    assert counter.tokens(text) == len(library.encode(text))


def test_kept_counts_change_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_PARTS", 3)
    counter = token_counts.Counter(token_counts.load(MODEL))
    for text in ["one two three four five, six", "six five one", "one two three four five, six"] * 2:
        assert counter.tokens(text) == len(library.encode(text))


def test_pairs_merge_lowest_rank_first_and_leftmost():
    words = token_counts.Vocabulary({"ab": 1, "bc": 0, "aa": 2, "aaaa": 3}, frozenset("abc"), frozenset(), True, 4)
    assert token_counts.merges("abc", words) == 1  # bc, and a is left
    assert token_counts.merges("aaaaa", words) == 3  # aa aa a, then aaaa a
    assert token_counts.merges("", words) == 0


def test_token_count_edges(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (3, "word " * 5000), (3, "word " * 5000)]
    docs = extended(spark.createDataFrame(rows, "doc_id long, text string"))
    vocabulary = token_counts.load(MODEL)
    found = token_counts.count_tokens(docs, "doc_id", "text", vocabulary, 4096).collect()
    assert Counter(map(tuple, found)) == Counter([(1, 0, 0, False), (None, 3, 2, False), (2, 0, 0, False), *[(3, 25000, 5001, True)] * 2])
    assert token_counts.count_tokens(docs.limit(0), "doc_id", "text", vocabulary, 1).collect() == []
    with pytest.raises(Exception):
        token_counts.load(public_tokenizers.path("word_bpe_49k.json"))


# -- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    """[(item, rank, key, score)] of rows (key, text), one list per row of items."""
    bags = [(key, Counter(plain_terms(text))) for key, text in docs]
    bags = [(key, bag) for key, bag in bags if bag]
    n, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    holders = Counter(t for _, bag in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for key, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * holders[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in set(plain_terms(text))
                if t in bag
            )
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(item, r, None if null else key, -s) for r, (s, null, key) in enumerate(sorted(scores)[:k], 1)]
    return out


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search_edges(spark):
    docs = [
        (1, "The cat, the HAT"), (2, "the cat"), (2, "the cat"), (None, "the cat"), (3, None), (4, ""), (5, " !\n"),
        (6, "Ünï CAFÉ cafÉ"), (7, "the " * 3000 + "dog"), (8, "cat hat dog"), (0, "the cat"),
    ]
    items = [(1, "CAT hat"), (1, "dog"), (1, "dog"), (2, None), (3, ""), (None, "the the cat"), (4, "CAFÉ"), (5, "absent")]
    left = extended(spark.createDataFrame(docs, "doc_id long, text string"))
    right = extended(spark.createDataFrame(items, "item_id long, body string"))
    for k in (2, 50):
        found = lexical.ranked_search(left, "doc_id", "text", right, "item_id", "body", k)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert listed(found) == sorted(plain_search(docs, items, k), key=repr)
    assert listed(lexical.ranked_search(left.limit(0), "doc_id", "text", right, "item_id", "body")) == []
    assert listed(lexical.ranked_search(left, "doc_id", "text", right.limit(0), "item_id", "body")) == []


def test_items_of_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_TERMS", 8)
    monkeypatch.setattr(lexical, "TASKS", 2)
    draw = random.Random(5)
    text = lambda n: " ".join(f"t{int(draw.paretovariate(0.6)) % 40}" for _ in range(n))
    docs = [(i, text(draw.randint(0, 30))) for i in range(300)]
    items = [(i, text(6)) for i in range(12)]
    found = lexical.ranked_search(
        spark.createDataFrame(docs, "d long, x string").repartition(6), "d", "x", spark.createDataFrame(items, "i long, y string"), "i", "y", 5
    )
    assert listed(found) == sorted(plain_search(docs, items, 5), key=repr)


@pytest.mark.parametrize("leaf", [1, 3, 32])
def test_tree_finds_what_scoring_all_finds(monkeypatch, leaf):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    draw = np.random.default_rng(leaf)
    vectors = [np.unique(np.minimum(draw.zipf(1.3, draw.integers(1, 12)) - 1, 59)) for _ in range(400)]
    vectors += [np.arange(5)] * 100 + [np.arange(3)] * 50  # equal paths, and one that begins another
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    ranks = np.concatenate(vectors)
    tf = draw.integers(1, 9, len(ranks)).astype(np.int32)
    m = draw.integers(50, 400, len(vectors))
    tree = lexical.Tree(starts, ranks, tf, m, 60)
    leaves = sorted(r for r, c in zip(tree.range, tree.children) if not c)
    assert [a for a, _ in leaves] == [0, *(b for _, b in leaves[:-1])] and leaves[-1][1] == len(vectors)
    weights = np.sort(draw.integers(0, 9000, 60))
    keys, scored = list(range(len(vectors))), 0
    for _ in range(20):
        item = np.unique(draw.integers(0, 60, 6))
        best = []
        scored += tree.search(item, weights, best, 10, keys)
        shares = lexical.saturated(tf, np.repeat(m, np.diff(starts))) * np.where(np.isin(ranks, item), weights[ranks], 0)
        scores = np.add.reduceat(shares, starts[:-1])
        expected = sorted((-s, k) for k, s in zip(keys, scores) if s > 0)[:10]
        assert sorted((-s, -k) for s, _, k in best) == expected
    assert leaf == 32 or scored < 0.6 * 20 * len(vectors)  # most documents are left out by their bounds


# -- prefix trie


def plain_trie(sequences):
    """{(conv_id, depth): rest of the row} from {id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(of) - 1) * len(p[-1][1]) if p else 0
    rows = []
    for p, of in members.items():
        ended = ",".join(str(c) for c in sorted(of) if len(sequences[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ended.encode()).hexdigest()
        rows.append((min(of), len(p), parent, len(of), children[p], leaves[p], saved[p], digest))
    return sorted(rows, key=repr)


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in out.items()}


def plain_grafted(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    return out


def trie_of(spark, rows, graft, **options):
    df = extended(spark.createDataFrame(rows, "c long, turn long, role string, text string"))
    turns = prefix_trie.numbered(df, "c", "turn", "role", "text", options.get("span_bits", 10))
    convs = turns.select("conv").distinct()
    if graft:
        turns = prefix_trie.grafted(turns, convs, options.get("hot", 2000))
    return listed(prefix_trie.prefix_trie(turns, convs, **options))


@pytest.mark.parametrize("options", [{}, {"block": 1}, {"block": 3, "span_bits": 1, "hot": 2}])
@pytest.mark.parametrize("graft", [False, True])
def test_trie_of_random_conversations(spark, options, graft):
    draw = random.Random(7)
    rows = []
    for c in [*range(0, 40), *range(95, 130), 205, 301, -1, -50, -120]:
        for turn in range(draw.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, "user" if turn % 2 else None, draw.choice(["a", "bb", "", None, "é😀"]) if turn < 6 else "x"))
    rows += [(60, t, "user", "a") for t in range(40)] + [(61, t, "user", "a") for t in range(40)]  # long, and its copy
    rows += [(c, t, "user", "a") for c in range(400, 430) for t in range(3)] + [(62, None, "user", "first")]
    rows += [(62, t, "user", f"{t}") for t in (5, -3, 10**12)]
    sequences = ordered(rows)
    expected = plain_trie(plain_grafted(sequences) if graft else sequences)
    assert trie_of(spark, rows, graft, **options) == expected


def test_trie_edges(spark):
    assert trie_of(spark, [], True) == []
    assert trie_of(spark, [(None, 1, "user", "lost")], True) == []
    rows = [(None, 0, "a", "x"), (7, 0, None, None), (107, 0, "", ""), (107, 1, "u", "y" * 100_000)]
    assert trie_of(spark, rows, False) == plain_trie(ordered(rows))
    # A comb: each conversation goes on where the one before it ends.
    comb = [(c, t, "u", "x") for c in range(1, 25) for t in range(c)]
    assert trie_of(spark, comb, False, block=2, span_bits=2) == plain_trie(ordered(comb))
    # A comb whose smallest member changes at each depth.
    falling = [(100 - c, t, "u", "x") for c in range(1, 25) for t in range(c)]
    assert trie_of(spark, falling, False, block=2, span_bits=2) == plain_trie(ordered(falling))


def test_turns_of_one_number_are_ordered_alike_everywhere(spark):
    rows = [(c, 1, "u", t) for c in (1, 2) for t in ("a", "b", "c")]
    found = trie_of(spark, rows[::-1], False)
    assert len(found) == 4 and all(r[3] == 2 for r in found)


def test_listed_digests_stream(spark):
    rows = [(g, i) for g in (1, 2) for i in range(-5, 3000, g)]
    found = prefix_trie.listed_digests(spark.createDataFrame(rows, "g long, i long"), ("g",), "i", 4)
    for g, digest in found.collect():
        text = ",".join(str(i) for k, i in rows if k == g)
        assert digest == hashlib.sha256(text.encode()).hexdigest()
