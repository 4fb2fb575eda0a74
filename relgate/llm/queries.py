"""The registered queries of this package, in the shape of their contracts.

``QUERIES`` maps a name to ``(run, sql)``, as the other registry does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgate.llm import (
    ann, embed_dedup, langid, lexical, lm, mixing, near_dedup, packing, pii, prefix_trie, quality, token_counts,
    toxicity,
)
from relgate.llm.common import fold, read, written
from relgate.llm.sql import LEXICAL_SEARCH, PREFIX_TRIE

TOKENIZER = "word_bpe_49k.json"
COUNTED = "piece_bpe_32k.model"


def op1_pii(spark, sf_dir) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    base = F.filter("spans", lambda s: s.kind.isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *(pii.count_of(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS),
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op2_toxicity(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", fold("doc_id", 5) != 0)
    return judged(toxicity.score(docs, "doc_id", "text", model), fold("doc_id", 5) == 0)


def judged(scores: DataFrame, held_out) -> DataFrame:
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_packing(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER))


def op4_near_dedup(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return near_dedup.near_duplicates(docs, "doc_id", "text", words=4, percent=80)


def op5_lm_scores(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return lm.scored(docs, "doc_id", "text", fold("doc_id", 7) == 2)


def op6_embedding_dedup(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return embed_dedup.near_vectors(rows, "vec_id", "embedding", "label", cosine=0.98)


def op7_mixing(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    mixed = mixing.mix(docs, "doc_id", "source", "text", weights=(5, 2, 1), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    field = quality.fit(docs, labels, "doc_id", "text", "quality", fold("doc_id", 3) != 1)
    return judged(quality.score(docs, "doc_id", "text", field), fold("doc_id", 3) == 1)


def op9_nearest(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", k=10)


def op10_language(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    profiles = langid.fit(docs, "text", "lang", fold("doc_id", 4) != 2)
    found = langid.predict(docs, "doc_id", "text", profiles)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_lexical_search(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    return lexical.ranked_search(docs, "doc_id", "text", items, "item_id", "text", k=50)


def op12_token_counts(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    vocabulary = token_counts.load(public_tokenizers.path(COUNTED))
    return token_counts.count_tokens(docs, "doc_id", "text", vocabulary, limit=4096)


def op13_prefix_trie(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    turns = written(prefix_trie.numbered(rows, "conv_id", "turn", "role", "text"), "numbered")
    convs = written(turns.select("conv").distinct(), "convs")
    return prefix_trie.prefix_trie(prefix_trie.grafted(turns, convs), convs)


#: The others have no SQL: automata, hashes of Python, trained models, trees and packing have no
#: counterpart in it. tests/llm holds them against plain versions or held-out labels.
SQL = {"op11_lexical_search": LEXICAL_SEARCH, "op13_prefix_trie": PREFIX_TRIE}
QUERIES = {
    run.__name__: (run, SQL.get(run.__name__))
    for run in (
        op1_pii, op2_toxicity, op3_packing, op4_near_dedup, op5_lm_scores, op6_embedding_dedup,
        op7_mixing, op8_quality, op9_nearest, op10_language, op11_lexical_search,
        op12_token_counts, op13_prefix_trie,
    )
}
