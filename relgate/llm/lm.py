"""Language-model scores by deleted interpolation of n-gram estimates.

The model mixes maximum-likelihood bigrams, unigrams and a uniform floor:

    P(w | h) = b2 c(h w) / c(h) + b1 c(w) / N + b0 / (V + 1)

The weights b depend on the bucket of c(h), the logarithm of the context's frequency. They
are learned by expectation-maximisation on held-out counts: each training token is scored
by the counts that are left when it is deleted from them.

Texts are coded once, in chunks of bounded size; a text that does not fit goes on in the
next chunk, with the word before it as context, and its scores are summed in the end. A chunk
asks for the counts of its distinct n-grams, not of its tokens, so a frequent n-gram is one
entry per chunk and no key is hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgate.llm.common import written

#: Tokens of a chunk at most; a chunk is one row, and what a task codes and scores at a time.
CHUNK_TOKENS = 1_000_000
#: Bytes of a text that are cut into words at once.
SEGMENT = 1 << 20
#: Chunks whose requests, if spread evenly, would fill one part.
CHUNKS_PER_PART = 4
#: Ranges of hashes whose requests are added one after the other, as their sorting takes most of a task's memory.
RANGE_BITS = 3
#: Buckets of context frequency: 0, 1, 2-3, 4-7, ...; larger ones share the last.
BUCKETS = 32
#: Held-out estimates are counted in steps of 1/8 of a factor of two; 60 factors at most.
STEPS, FACTORS = 8, 60
ROUNDS = 30

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_END, _START = 0, 1  # codes of the end token and of the context before the first word
_FIXED = (b"\x00end", b"\x00start")  # no word holds white space or is these: see coded()

#: By piece of a text: ``docs`` numbers its row, ``split`` says that it has other pieces, ``sizes`` counts
#: its tokens and ``before`` is the code of the context it starts in.
CHUNK = (
    "chunk long, keys array<long>, held array<boolean>, docs array<long>, split array<boolean>, "
    "sizes binary, before binary, vocabulary binary, codes binary"
)


@dataclass(frozen=True)
class Model:
    """Training counts' totals and the weights (uniform, unigram, bigram) of each bucket."""

    tokens: int
    distinct: int
    weights: np.ndarray


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _MIX[0] + right
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte of significance: the upper bytes stand together and compress to little.

    They are compressed here, so that Spark's rows, its batches and its shuffles hold no more; the
    size they have without that comes first.
    """
    wide = numbers.astype(numbers.dtype.newbyteorder("<"))
    planes = wide.view(np.uint8).reshape(-1, wide.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _from_planes(packed: bytes | pa.Buffer, kind: str) -> np.ndarray:
    view = memoryview(packed)
    planes = pa.decompress(view[8:], int.from_bytes(view[:8], "little"), codec="zstd")
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in runs; no word is cut."""
    start = 0
    while start < len(text):
        end = _SPACE.search(text, start + SEGMENT)
        stop = end.start() if end else len(text)
        # A word may not be one of the fixed texts: it gets another first byte.
        yield [b"\x00" + w if w[0] == 0 else w for w in text[start:stop].lower().split()]
        start = stop


class _Writer:
    """Fills chunks; a text is opened, given words, and closed by its end."""

    def __init__(self, base: int, tokens: int):
        self.chunk, self.most = base, tokens
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.pieces: list[list] = []  # key, held, doc, split, tokens, code before
        self.codes: list[np.ndarray] = []
        self.total = 0

    def open(self, key: int | None, held: bool, doc: int, before: bytes | None = None) -> None:
        at = _START if before is None else self.of([before])[0]
        self.pieces.append([key, held, doc, before is not None, 0, at])

    def of(self, words: list[bytes]) -> np.ndarray:
        code = self.code
        for w in words:
            if w not in code:
                code[w] = len(code) + 2
        return np.fromiter(map(code.__getitem__, words), np.uint32, len(words))

    def add(self, codes: np.ndarray) -> None:
        self.codes.append(codes)
        self.total += len(codes)
        self.pieces[-1][4] += len(codes)

    def put(self, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Adds words to the open text; gives each chunk that is full."""
        at = 0
        while at < len(words):
            if self.total >= self.most - 1:
                key, held, doc, *_ = self.pieces[-1]
                last = words[at - 1] if at else self.last
                self.pieces[-1][3] = True
                yield self.flush()
                self.open(key, held, doc, last)
            some = words[at : at + self.most - 1 - self.total]
            self.add(self.of(some))
            at += len(some)
            self.last = some[-1]

    def close(self) -> Iterator[pa.RecordBatch]:
        self.add(np.array([_END], np.uint32))
        if self.total >= self.most - 1:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        hashes = b"".join(blake2b(w, digest_size=8).digest() for w in (*_FIXED, *self.code))
        keys, held, docs, split, sizes, before = zip(*self.pieces)
        narrow = [np.array(x, np.uint32).tobytes() for x in (sizes, before)]
        row = [self.chunk, keys, held, docs, split, *narrow, hashes, _planes(np.concatenate(self.codes))]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        types += [pa.binary()] * 4
        names = ["chunk", "keys", "held", "docs", "split", "sizes", "before", "vocabulary", "codes"]
        self.chunk += 1
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)


def coded(rows: DataFrame, tokens: int) -> DataFrame:
    """Chunks of ``key, held, text`` rows: the words' hashes and each text's word codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        writer, doc = _Writer(base, tokens), base
        for batch in batches:
            for key, held, text in zip(*batch.columns):
                writer.open(key.as_py(), held.as_py(), doc)
                doc += 1
                for words in _words(text.as_py() or b""):
                    yield from writer.put(words)
                yield from writer.close()
        if writer.pieces:
            yield writer.flush()

    return rows.mapInArrow(run, CHUNK)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The chunks of a batch, one in memory at a time."""
    for i in range(batch.num_rows):
        yield from batch.slice(i, 1).to_pylist()


class _Chunk:
    """A chunk's tokens as arrays: ``token`` and its ``context`` by code, ``piece`` by index."""

    def __init__(self, row: dict):
        self.sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        self.hashes = np.frombuffer(row["vocabulary"], np.uint64)
        self.token = _from_planes(row["codes"], "<u4")
        self.context = np.concatenate([self.token[:1], self.token[:-1]])
        starts = np.cumsum(self.sizes) - self.sizes
        filled = self.sizes > 0
        self.context[starts[filled]] = np.frombuffer(row["before"], np.uint32)[filled]
        self.piece = np.repeat(np.arange(len(self.sizes), dtype=np.uint32), self.sizes)
        self.training = ~np.array(row["held"], bool)[self.piece]
        pair = self.context.astype(np.int64) * len(self.hashes) + self.token
        distinct, at = np.unique(pair, return_inverse=True)
        self.pair = at.astype(np.uint32)
        left, right = np.divmod(distinct, len(self.hashes))
        self.pairs = _pair_hash(self.hashes[left], self.hashes[right])

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct n-grams, pairs first, and how often training texts hold each."""
        pairs = np.bincount(self.pair, self.training, len(self.pairs))
        words = np.bincount(self.token, self.training, len(self.hashes))
        return np.concatenate([self.pairs, self.hashes]), np.concatenate([pairs, words]).astype(np.int64)


def _order(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each hash, and the order by part and hash in which hashes are asked and answered."""
    part = (hashes >> np.uint64(32)) % np.uint64(parts)
    return part, np.lexsort((hashes, part))


def _packed(rising: np.ndarray) -> bytes:
    """Rising hashes as the steps between them, whose upper bytes are zeros."""
    return _planes(np.diff(rising, prepend=np.uint64(0)))


def _unpacked(packed: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(_from_planes(packed, "<u8"), dtype=np.uint64)


REQUEST = "chunk long, part int, hashes binary, counts binary, word binary"
ANSWER = "chunk long, part int, wide boolean, answer binary, known long"


def _requests(row: dict, parts: int) -> pa.RecordBatch:
    """What a chunk asks each part: its hashes, its own counts of them, and which are words."""
    chunk = _Chunk(row)
    hashes, counts = chunk.asked()
    word = np.arange(len(hashes)) >= len(chunk.pairs)
    part, order = _order(hashes, parts)
    asked, cuts = np.unique(part[order], return_index=True)
    rows = [
        (row["chunk"], int(p), _packed(hashes[o]), _planes(counts[o].astype(np.uint32)), np.packbits(word[o]).tobytes())
        for p, o in zip(asked, np.split(order, cuts[1:]))
    ]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["chunk", "part", "hashes", "counts", "word"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _answered(group: pa.Table) -> pa.Table:
    """The requests of one part with the sums of all of them, range by range of the hashes."""
    hashes = [_unpacked(h.as_buffer()) for h in group["hashes"]]
    sizes = [len(h) for h in hashes]
    bits = (np.frombuffer(w.as_buffer(), np.uint8) for w in group["word"])
    word = np.concatenate([np.unpackbits(b, count=n) for b, n in zip(bits, sizes)])
    keys = np.concatenate(hashes)
    del hashes
    # A pair and a word are told apart by their lowest bit.
    keys &= ~np.uint64(1)
    keys |= word
    counts = np.concatenate([_from_planes(c.as_buffer(), "<u4") for c in group["counts"]])
    span = (keys >> np.uint64(64 - RANGE_BITS)).astype(np.uint8)
    sums, known = np.empty(len(keys), np.int64), 0
    for k in range(1 << RANGE_BITS):
        some = np.flatnonzero(span == k)
        distinct, at = np.unique(keys[some], return_inverse=True)
        added = np.bincount(at, counts[some], len(distinct)).astype(np.int64)
        known += int(((added > 0) & ((distinct & np.uint64(1)) == 1)).sum())
        sums[some] = added[at]
    answers = np.split(sums, np.cumsum(sizes)[:-1])
    wide = [bool(a.size and a.max() >> 32) for a in answers]
    packed = [_planes(a.astype(np.uint64 if w else np.uint32)) for a, w in zip(answers, wide)]
    return pa.table(
        {
            "chunk": group["chunk"],
            "part": group["part"],
            "wide": pa.array(wide, pa.bool_()),
            "answer": pa.array(packed, pa.binary()),
            "known": pa.array([known] + [0] * (len(sizes) - 1), pa.int64()),
        }
    )


def _counts(chunks: DataFrame, parts: int) -> DataFrame:
    """``chunk, part, counts``: the corpus counts of what each chunk asked, in asked order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield _requests(row, parts)

    return chunks.mapInArrow(ask, REQUEST).groupBy("part").applyInArrow(_answered, ANSWER)


def _joined(row: dict, parts: int) -> tuple[_Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk with the corpus counts of its pairs, of its words, and of its contexts."""
    chunk = _Chunk(row)
    hashes, _ = chunk.asked()
    _, order = _order(hashes, parts)
    answers = sorted(row["answers"], key=lambda a: a["part"])
    flat = np.concatenate(
        [_from_planes(a["answer"], "<u8" if a["wide"] else "<u4").astype(np.int64) for a in answers]
    )
    counts = np.empty(len(hashes), np.int64)
    counts[order] = flat
    pairs, words = counts[: len(chunk.pairs)], counts[len(chunk.pairs) :].copy()
    contexts = words.copy()
    contexts[_START] = words[_END]  # a text has one start and one end
    return chunk, pairs, words, contexts


def bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts)[1], BUCKETS - 1)


def learn(histogram: np.ndarray, floor: float) -> np.ndarray:
    """Weights of each bucket by EM. Rows: bucket, bigram and unigram step, tokens."""
    weights = np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    for b in range(BUCKETS):
        rows = histogram[histogram[:, 0] == b]
        if not len(rows):
            weights[b] = (0.1, 0.9, 0.0)
            continue
        parts = np.empty((len(rows), 3))
        parts[:, 0] = floor
        for column, step in ((1, rows[:, 2]), (2, rows[:, 1])):
            parts[:, column] = np.where(step > STEPS * FACTORS, 0, 2.0 ** (-step / STEPS))
        for _ in range(ROUNDS):
            share = parts * weights[b]
            share /= share.sum(axis=1, keepdims=True)
            weights[b] = (share * rows[:, 3:]).sum(axis=0) / rows[:, 3].sum()
        weights[b] = 0.999 * weights[b] + 0.001 * np.array([0.5, 0.5, 0.0])  # no text is impossible
    return weights


def scored(df: DataFrame, key: str, text: str, held_out: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows for which ``held_out`` is false. Letters A-Z are
    lower-cased; tokens are the words and one end. A null text is empty and has the end
    alone; a text of any length is read and scored in pieces of ``chunk_tokens``; null keys and
    repeated rows are kept, and each repeated row counts; without a
    training row all counts are 0 and the floor alone is left; other columns are dropped;
    an empty table gives no rows.
    """
    rows = df.select(
        F.col(key).cast("long").alias("key"), held_out.alias("held"), F.col(text).cast("string").cast("binary").alias("text")
    )
    chunks = written(coded(rows, chunk_tokens), "chunks")
    n_chunks = chunks.count()
    # A part has the requests of so many chunks, whatever the input; a chunk asks only parts
    # that hold some of its n-grams.
    parts = max(16, -(-n_chunks // CHUNKS_PER_PART))
    # A table of its own: the shuffle of the requests can go before that of the answers begins.
    counts = written(_counts(chunks, parts), "counts")
    # One row per chunk, in which a part has one entry.
    answers = counts.groupBy("chunk").agg(F.collect_list(F.struct("part", "wide", "answer")).alias("answers"))
    joined = written(chunks.join(answers, "chunk"), "joined")
    distinct = counts.agg(F.sum("known")).first()[0] or 0
    model = Model(_training_tokens(chunks), int(distinct), np.empty(0))
    floor = 1 / (model.distinct + 1)

    def count_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = STEPS * FACTORS + 1
        for batch in batches:
            for row in _rows(batch):
                chunk, pairs, words, contexts = _joined(row, parts)
                use = chunk.training
                c2 = pairs[chunk.pair[use]] - 1
                c1 = words[chunk.token[use]] - 1
                h = contexts[chunk.context[use]] - 1
                steps = []
                with np.errstate(divide="ignore", invalid="ignore"):
                    for top, bottom in ((c2, h), (c1, model.tokens - 1)):
                        p = np.where(top > 0, top / np.maximum(bottom, 1), 0)
                        step = np.round(-STEPS * np.log2(p))
                        steps.append(np.where(np.isfinite(step), np.minimum(step, most), most).astype(np.int64))
                cell = (bucket(h) * (most + 1) + steps[0]) * (most + 1) + steps[1]
                cells, n = np.unique(cell, return_counts=True)
                rest, one = np.divmod(cells, most + 1)
                b, two = np.divmod(rest, most + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (b, two, one, n)], names=["b", "two", "one", "n"]
                )

    steps = joined.mapInArrow(count_steps, "b long, two long, one long, n long")
    # Bounded by the numbers of buckets and steps, not by the corpus.
    histogram = steps.groupBy("b", "two", "one").agg(F.sum("n").alias("n")).collect()
    weights = learn(np.array([tuple(r) for r in histogram], float).reshape(-1, 4), floor)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                chunk, pairs, words, contexts = _joined(row, parts)
                c1, h = words[chunk.token], contexts[chunk.context]
                w = weights[bucket(h)]
                p = w[:, 0] * floor + w[:, 1] * c1 / max(model.tokens, 1)
                p += w[:, 2] * pairs[chunk.pair] / np.maximum(h, 1)
                # What an unseen context cannot give goes to the floor.
                p += np.where(h == 0, w[:, 2], 0) * floor
                base = np.log10((c1 + 1) / (model.tokens + model.distinct + 1))
                sums = [np.bincount(chunk.piece, x, len(chunk.sizes)) for x in (c1 > 0, base, np.log10(p))]
                columns = [
                    pa.array(row["keys"], pa.int64()),
                    pa.array(row["held"], pa.bool_()),
                    pa.array(row["docs"], pa.int64()),
                    pa.array(row["split"], pa.bool_()),
                    pa.array(chunk.sizes),
                    pa.array(sums[0].astype(np.int64)),
                    pa.array(sums[1]),
                    pa.array(sums[2]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=PIECE)

    schema = (
        "key long, held_out boolean, doc long, split boolean, n_tokens long, n_known long, "
        "base_score double, score double"
    )
    pieces = written(joined.mapInArrow(score, schema), "pieces")
    sums = (F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    texts = pieces.filter("split").groupBy("doc", "key", "held_out").agg(*sums)
    out = pieces.filter("not split").select(*texts.columns).unionByName(texts)
    return out.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


PIECE = ["key", "held_out", "doc", "split", "n_tokens", "n_known", "base_score", "score"]


def _training_tokens(chunks: DataFrame) -> int:
    """Tokens of the training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = 0
            for held, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens += int(np.frombuffer(sizes, np.uint32).astype(np.int64)[~np.array(held, bool)].sum())
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64())], names=["t"])

    return int(chunks.select("held", "sizes").mapInArrow(run, "t long").agg(F.sum("t")).first()[0] or 0)
