"""Encoding texts with a public byte-level BPE vocabulary, whole words at a time in numpy matrices.

Texts are cut into words by the vocabulary's pattern; each distinct word of a task is encoded once. Words
of like length stand in a padded matrix of token ids. In every round each row looks up the ranks of its
neighbouring pairs in a hash table, merges its leftmost pair of the smallest rank, and is compacted by
one place; finished rows leave the matrix. Words of more than LONGEST bytes are merged the same way by a
heap, one at a time, as a matrix would need a round for every merge.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers lie, unless the caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published word pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST = 256
_BUCKETS = (1, 2, 4, 8, 16, 32, 64, 128, LONGEST)
_ABSENT = np.int32(2**31 - 1)
_CACHE_WORDS = 400_000
_CHUNK_CHARS = 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id that they merge into (its rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [
            (left, right, rank)
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if (left := ranks.get(token[:at])) is not None and (right := ranks.get(token[at:])) is not None
        ]
        a, b, r = np.array(found, np.int64).reshape(-1, 3).T
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(a)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _ABSENT, np.int32)
        self.bytes = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        keys, slot = a << 32 | b, self._slot(a << 32 | b)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several for a slot one stays
            placed = self.keys[slot[todo]] == keys[todo]
            self.ranks[slot[todo[placed]]] = r[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _ABSENT where they don't merge or an id is -1."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        out = np.full(keys.shape, _ABSENT, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


def _matrix(words: list[bytes], width: int, pairs: PairTable) -> list[np.ndarray]:
    """Token ids of words of at most `width` bytes."""
    lengths = np.array([len(w) for w in words])
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    columns = np.arange(width)
    ids = np.where(columns < lengths[:, None], pairs.bytes[raw], -1).astype(np.int32)
    out: list = [None] * len(words)
    row = np.arange(len(words))
    ranks = np.full(ids.shape, _ABSENT, np.int32)
    if width > 1:
        ranks[:, :-1] = pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
    while True:
        at = ranks.argmin(axis=1)
        every = np.arange(len(row))
        best = ranks[every, at]
        merges = best < _ABSENT
        for i in np.flatnonzero(~merges):
            out[row[i]] = ids[i, : lengths[row[i]]].copy()
        if not merges.any():
            return out
        ids, ranks, row, at, best = ids[merges], ranks[merges], row[merges], at[merges], best[merges]
        every = np.arange(len(row))
        # merge the pair, then close the gap behind it
        source = np.minimum(columns + (columns > at[:, None]), width - 1)
        ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
        ids[every, at] = best
        lengths[row] -= 1
        ids[every, lengths[row]] = -1
        ranks[every, lengths[row]] = _ABSENT
        following = np.where(at + 1 < width, ids[every, np.minimum(at + 1, width - 1)], -1)
        ranks[every, at] = pairs.lookup(best, following)
        left = np.flatnonzero(at > 0)
        ranks[left, at[left] - 1] = pairs.lookup(ids[left, at[left] - 1], best[left])


def _heap(word: bytes, pairs: PairTable) -> np.ndarray:
    """Token ids of one long word: the same merges in the same order, from a heap of (rank, place)."""
    ids = pairs.bytes[np.frombuffer(word, np.uint8)].astype(np.int64)
    n = len(ids)
    first = pairs.lookup(ids[:-1], ids[1:])
    heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first < _ABSENT)]
    heapq.heapify(heap)
    ids, before, behind = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    known: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(pairs.lookup(np.array([a]), np.array([b]))[0])
        return known[a, b]

    while heap:
        r, i = heapq.heappop(heap)
        j = behind[i] if ids[i] >= 0 else n
        if j >= n or rank(ids[i], ids[j]) != r:
            continue
        ids[i], ids[j] = r, -1
        behind[i] = behind[j]
        if behind[i] < n:
            before[behind[i]] = i
            if (x := rank(r, ids[behind[i]])) < _ABSENT:
                heapq.heappush(heap, (x, i))
        if before[i] >= 0 and (x := rank(ids[before[i]], r)) < _ABSENT:
            heapq.heappush(heap, (x, before[i]))
    out = np.array(ids, np.int32)
    return out[out >= 0]


def encode_words(words: list[bytes], pairs: PairTable) -> list[np.ndarray]:
    """Token ids of each word, by buckets of length."""
    lengths = np.array([len(w) for w in words])
    out: list = [None] * len(words)
    for low, width in zip((0, *_BUCKETS), _BUCKETS):
        chosen = np.flatnonzero((lengths > low) & (lengths <= width))
        step = max(1, 2_000_000 // width)
        for start in range(0, len(chosen), step):
            some = chosen[start : start + step]
            for i, ids in zip(some, _matrix([words[i] for i in some], width, pairs)):
                out[i] = ids
    for i in np.flatnonzero(lengths > LONGEST):
        out[i] = _heap(words[i], pairs)
    return out


def _encoder(table, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pairs, cut = table.value, regex.compile(pattern)
        known: dict[str, int] = {}
        flat, starts, sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

        def chunk(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
            nonlocal known, flat, starts, sizes
            if len(known) > _CACHE_WORDS:
                known, flat, starts, sizes = {}, flat[:0], starts[:0], sizes[:0]
            words = [cut.findall(t) if t else [] for t in texts]
            new = list(dict.fromkeys(w for row in words for w in row if w not in known))
            if new:
                encoded = encode_words([w.encode() for w in new], pairs)
                size = np.array([len(e) for e in encoded], np.int64)
                starts = np.append(starts, len(flat) + np.cumsum(size) - size)
                sizes, flat = np.append(sizes, size), np.concatenate([flat, *encoded])
                known.update(zip(new, range(len(known), len(known) + len(new))))
            at = np.fromiter((known[w] for row in words for w in row), np.int64)
            size = sizes[at]
            ends = np.cumsum(size)
            ids = flat[np.repeat(starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
            per_text = np.append(0, np.cumsum([len(row) for row in words]))
            offsets = np.append(0, ends)[per_text].astype(np.int32)
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], names=["key", "ids"])

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            start = size = 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size > _CHUNK_CHARS or i == len(texts) - 1:
                    yield chunk(keys.slice(start, i + 1 - start), texts[start : i + 1])
                    start, size = i + 1, 0

    return run


def encode_texts(
    df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", pattern: str = PATTERN
) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; what looks like one is plain text.

    One row per input row, repeated rows and null keys included. Null and empty texts give an empty list,
    blank texts their tokens. Texts and words may be of any length. Other columns are ignored. The pair
    table is broadcast; its size is bounded by the vocabulary (about 8 MB for 50 000 tokens).
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(PairTable(read_ranks(vocabulary)))
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_encoder(table, pattern), f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")
