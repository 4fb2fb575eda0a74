"""Token counts of a byte-pair vocabulary, by a heap of adjacent pairs over a linked list.

A text starts as one symbol per character. The adjacent pair of the lowest rank is merged
until none is left, so a text has its initial symbols less its merges as tokens. A character
outside the vocabulary counts as its UTF-8 bytes, as the byte fallback would write it. No
identifiers are made.

No merge crosses two neighbours that stand together in no piece of the vocabulary. Texts
are cut there, and the count of a part is kept for the next text that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # what the vocabulary writes for a blank
#: Parts whose counts are kept: those met last, and the generation before them.
CACHED_PARTS = 300_000
#: Characters of a text that are cut into parts at once, and those of a part that is kept.
SEGMENT, KEPT = 1 << 20, 48
#: The types of pieces in a model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of the pieces (0 is merged first; equal scores share one), and its characters."""

    ranks: dict[str, int]
    characters: frozenset[str]
    #: Neighbours that stand together in some piece, each as a text of two characters.
    inside: frozenset[str]
    byte_fallback: bool = True
    longest: int = field(default=0)


def load(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece BPE model that leaves its texts as they are.

    Raises ValueError for a model of another kind, or one that rewrites texts other than
    by a blank before them.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or not plain:
        raise ValueError(f"{path} is no BPE model with unchanged texts")
    if {p.type for p in model.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError(f"{path} has pieces of the user or unused ones")
    scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
    order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
    pieces = [p for p in scores if len(p) > 1]
    return Vocabulary(
        {p: order[scores[p]] for p in pieces},
        frozenset(p for p in scores if len(p) == 1),
        frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1)),
        model.trainer_spec.byte_fallback,
        max(map(len, pieces), default=1),
    )


def merges(part: str, vocabulary: Vocabulary) -> int:
    """How many pairs of ``part`` are merged, the lowest rank first and the leftmost of equals.

    Symbols are named by where they start. ``end`` and ``before`` link them: a symbol's
    right neighbour starts at its end, and ``before`` is its left one. A merged symbol's end
    is 0, so that pairs pushed for it are seen to be out of date.
    """
    rank_of, longest, size = vocabulary.ranks.get, vocabulary.longest, len(part)
    ranked = enumerate(map(rank_of, map(str.__add__, part, part[1:])))
    heap = [(rank, left, left + 2) for left, rank in ranked if rank is not None]
    heapify(heap)
    end = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    merged = 0
    while heap:
        _, left, stop = heappop(heap)
        right = end[left]
        if not right or right >= size or end[right] != stop:
            continue
        merged += 1
        end[left], end[right] = stop, 0
        if stop < size:
            before[stop] = left
            to = end[stop]
            if to - left <= longest and (rank := rank_of(part[left:to])) is not None:
                heappush(heap, (rank, left, to))
        if left:
            start = before[left]
            if stop - start <= longest and (rank := rank_of(part[start:stop])) is not None:
                heappush(heap, (rank, start, stop))
    return merged


class Counter(dict):
    """Token counts of parts; counts of texts by ``tokens``."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}
        # Parts begin at a run of blanks that follows another character, if no piece spans that.
        spans = any(pair[1] == SPACE != pair[0] for pair in vocabulary.inside)
        self.parts = re.compile("(?s).+" if spans else f"{SPACE}+[^{SPACE}]*")
        self.whole = spans

    def __missing__(self, part: str) -> int:
        total = self.older.get(part)
        if total is None:
            total = self.counted(part)
        if len(part) <= KEPT:
            if len(self) >= CACHED_PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = total
        return total

    def counted(self, part: str) -> int:
        inside, start, total = self.vocabulary.inside, 0, 0
        pairs = list(map(str.__add__, part, part[1:]))
        if inside.issuperset(pairs):
            return self.symbols(part) - merges(part, self.vocabulary)
        for stop, pair in enumerate(pairs, 1):
            if pair not in inside:
                total += self[part[start:stop]]
                start = stop
        return total + self[part[start:]]

    def symbols(self, part: str) -> int:
        known = self.vocabulary.characters
        if known.issuperset(part) or not self.vocabulary.byte_fallback:
            return len(part)
        return sum(1 if c in known else len(c.encode()) for c in part)

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        return sum(sum(map(self.__getitem__, self.parts.findall(run))) for run in self.runs(marked))

    def runs(self, marked: str) -> Iterator[str]:
        """The text in runs of about ``SEGMENT`` characters that end where parts end."""
        start = 0
        while len(marked) - start > SEGMENT and not self.whole:
            cut = re.compile(f"[^{SPACE}]{SPACE}").search(marked, start + SEGMENT)
            if cut is None:
                break
            yield marked[start : cut.start() + 1]
            start = cut.start() + 1
        yield marked[start:]


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: Vocabulary, limit: int) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row; ``over_limit`` is above ``limit``.

    One pass, no shuffle: each text is counted where it was read, whole. A null or empty
    text has no bytes and no tokens. Null keys and repeated rows are kept, other columns
    are dropped, an empty table gives no rows. Bytes that are no UTF-8 count as the
    replacement character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            counts = [counter.tokens((t.as_py() or b"").decode("utf-8", "replace")) for t in texts]
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                    tokens,
                    pc.greater(tokens, limit),
                ],
                names=["key", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    schema = f"key {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
