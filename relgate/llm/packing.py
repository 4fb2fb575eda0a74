"""Cost-balanced packing of token sequences.

Training a sequence costs a part linear in its tokens and a part quadratic in the length
of each document piece, as attention stays within a piece. Documents are taken by
descending length, and each goes to the cheapest sequence that has room for it.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgate.llm.common import pieces, worker_cache

CAPACITY = 2048
#: Attention cost of a token pair against the other cost of a token: 1 / (6 x width 1024).
QUADRATIC = 1 / 6144
#: Tokens planned together; bounds a task's memory, whatever the size of its partition.
BLOCK_TOKENS = 4 << 20
#: Words whose ids a worker remembers.
CACHED_WORDS = 700_000

PIECES = (
    "key {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, cost double"
)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as they are, the others in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class _Ids(dict):
    """Ids of a blank-separated piece of text as little-endian bytes; a bounded cache.

    The tokenizer drops white space and never joins what it separates, so the ids of a
    text are those of its pieces one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model  # each use of the property makes a new object

    def encode(self, word: str) -> list[int]:
        # A word of Latin letters needs no splitting and goes to the merges at once, which is
        # four times as fast; everything else takes the tokenizer's own way.
        if word.isalpha() and max(word) < "\u0250" and (low := normalize("NFC", word).lower()).isalpha():
            return [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return self.whole.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        # Letters are lower-cased and part from what follows them, so forms share their stem.
        if word[-1:] in (".", ",") and normalize("NFC", word[:-1]).lower().isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif word.isascii() and word.isalpha() and not word.islower():
            ids = self[word.lower()]
        else:
            ids = np.array(self.encode(word), "<u4").tobytes()
        # Frequent words come early, so a full cache keeps what it has.
        if len(self) < CACHED_WORDS and len(word) <= 64:
            self[word] = ids
        return ids


def tokenizer(path: str) -> _Ids:
    return worker_cache(f"packing {path}", lambda: _Ids(path))


def token_bytes(text: str | None, ids: _Ids, end_id: int) -> bytes:
    """A text's ids and the end id, four little-endian bytes each."""
    words = (text or "").replace("\n", " ").split(" ")
    return b"".join(map(ids.__getitem__, words)) + end_id.to_bytes(4, "little")


class Sequences:
    """Open sequences, by remaining room: a minimum tree over the cheapest of each room.

    ``take`` gives the cheapest sequence with at least so much room, in log(capacity) steps.
    """

    def __init__(self, rooms: list[int], capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]
        self.tree: list = [None] * (2 * self.size)
        for number, room in enumerate(rooms):
            self.put(room, 0.0, number)

    def _mend(self, room: int) -> None:
        heap, node = self.heaps[room], self.size + room
        self.tree[node] = (*heap[0], room) if heap else None
        while node := node >> 1:
            a, b = self.tree[2 * node], self.tree[2 * node + 1]
            self.tree[node] = a if b is None or (a is not None and a < b) else b

    def put(self, room: int, cost: float, number: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, number))
            self._mend(room)

    def take(self, room: int) -> tuple[float, int, int] | None:
        """The cheapest with ``room`` or more, as (cost, number, its room), removed."""
        best, low, high = None, self.size + room, 2 * self.size
        while low < high:
            for node in [low] * (low & 1) + [high - 1] * (high & 1):
                if self.tree[node] is not None and (best is None or self.tree[node] < best):
                    best = self.tree[node]
            low, high = (low + 1) >> 1, high >> 1
        if best is not None:
            heapq.heappop(self.heaps[best[2]])
            self._mend(best[2])
        return best

    def roomiest(self) -> int:
        return max(room for room, heap in enumerate(self.heaps) if heap)


def plan(lengths: list[int], rooms: list[int], capacity: int, quadratic: float):
    """Where each length goes: (index, start, length, sequence, offset, sequence's cost).

    Descending lengths go whole to the cheapest sequence with room. What fits nowhere as
    a whole is cut to the roomiest sequence, and its rest is taken up again by length.
    The rooms' sum may be less than the lengths': the last rests are then left over.
    """
    waiting = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(waiting)
    open_, placed, left = Sequences(rooms, capacity), [], sum(rooms)
    while waiting and left:
        negative, i, start = heapq.heappop(waiting)
        n = -negative
        if (got := open_.take(n)) is None:
            part = open_.roomiest()
            got = open_.take(part)
            heapq.heappush(waiting, (part - n, i, start + part))
            n = part
        cost, number, room = got
        cost += n + quadratic * n * n
        placed.append((i, start, n, number, rooms[number] - room, cost))
        open_.put(room - n, cost, number)
        left -= n
    return placed, [(i, start, -negative) for negative, i, start in waiting]


def powers(n: int) -> list[int]:
    """The powers of two that sum to ``n``, descending."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def pack(
    df: DataFrame,
    key: str,
    text: str,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    quadratic: float = QUADRATIC,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece of a document: where its ids stand in which sequence.

    Every partition packs its own documents, block by block, so nothing is shuffled and a
    lost task is simply run again. A block fills whole sequences only and hands what is
    over to the next one; the last block's remainder becomes sequences whose lengths are
    powers of two, which need no padding. So no sequence is padded at all.

    A null text is empty and has the end id alone; a null key is kept; repeated rows are
    packed one by one; other columns are dropped; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer(tokenizer_path)
        base, numbered = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []  # key, first start, ids, tokens of the whole document
        total = 0

        def flush(final: bool) -> pa.RecordBatch:
            nonlocal held, total, numbered
            rooms = [capacity] * (total // capacity) + powers(total % capacity) * final
            placed, over = plan([len(h[2]) // 4 for h in held], rooms, capacity, quadratic)
            last = {number: cost for *_, number, _, cost in placed}
            out: list[list] = [[] for _ in range(8)]
            for i, start, n, number, offset, _ in placed:
                k, first, data, whole = held[i]
                crc = zlib.crc32(memoryview(data)[4 * start : 4 * (start + n)])
                row = (k, first + start, n, crc, whole, base + numbered + number, offset, last[number])
                for column, value in zip(out, row):
                    column.append(value)
            held = [
                (held[i][0], held[i][1] + start, held[i][2][4 * start : 4 * (start + n)], held[i][3])
                for i, start, n in over
            ]
            total = sum(n for _, _, n in over)
            numbered += len(rooms)
            types = [key_type, *[pa.int64()] * 6, pa.float64()]
            names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=names
            )

        key_type = pa.int64()
        for batch in pieces(batches):
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = token_bytes(t, ids, end_id)
                whole = len(data) // 4
                for start in range(0, whole, block_tokens):  # a text beyond a block comes in parts
                    held.append((k, start, data[4 * start : 4 * (start + block_tokens)], whole))
                    total += len(held[-1][2]) // 4
                    if total >= block_tokens + capacity:
                        yield flush(False)
        if held:
            yield flush(True)

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = PIECES.format(df.schema[key].dataType.simpleString())
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
