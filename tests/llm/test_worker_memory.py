"""What a Python worker holds at once: bounded batches, and the cache of one operator only."""

import gc

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from relgate.llm import near_dedup, packing
from relgate.llm.queries import TOKENIZER

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(TOKENIZER)


def remembered(kind):
    gc.collect()
    return sum(len(x) for x in gc.get_objects() if type(x) is kind)


def test_worker_gives_up_the_words_of_other_operators():
    words = " ".join(f"word{i}" for i in range(1000))
    near_dedup.shingle_set(words.encode(), 5)
    assert remembered(near_dedup._WordHashes) >= 1000
    ids = packing.token_bytes(words, packing.tokenizer(PATH), 1)
    assert remembered(near_dedup._WordHashes) == 0 and remembered(packing._Ids) >= 1000
    assert packing.tokenizer(PATH) is packing.tokenizer(PATH)
    near_dedup.shingle_set(words.encode(), 5)
    assert remembered(packing._Ids) == 0
    assert packing.token_bytes(words, packing.tokenizer(PATH), 1) == ids


def test_stages_bound_the_bytes_of_a_batch(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "n"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    long = spark.range(0, 4000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 8192) text")
    for name, stage in corpus_pipeline.STAGES:
        if name != "mixing":  # no Python there
            before = spark.conf.get(setting)
            spark.conf.unset(setting)
            try:
                stage(spark, docs.limit(20), SF_DIR)
                found = long.mapInArrow(sizes, "rows long, n long").collect()
            finally:
                spark.conf.set(setting, before)
            assert sum(r.rows for r in found) == 4000 and max(r.n for r in found) < 12 << 20, name
