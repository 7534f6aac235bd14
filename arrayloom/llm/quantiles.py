"""Percentiles per group by dyadic Count-sketches.

A value is encoded as an order-preserving whole number of `BITS` bits (the leading bits of its IEEE
form). For every binary resolution 0..BITS there is one array: up to EXACT_BITS it counts each dyadic
interval itself, beyond that it is a signed Count-sketch of `depth` rows and `width` columns, whose median
over the rows estimates an interval's count. Ranks are inverted by descending the resolutions from the
top. All arrays are sums over records, so sketches of files, days or partitions are merged by addition,
and a weight of -1 deletes a record.

Error: one row estimates an interval with the standard error sqrt(F2 / width), F2 being the sum of the squared
counts of its resolution, and the median of `depth` rows with 1.2533 / sqrt(depth) of that; the errors of the
resolutions that are descended add up as independent ones. F2 is estimated by the sketch itself, so each answer
comes with three standard errors of its ranks; `width_for` gives the width for an error that is asked for. Each value
is off by at most 1 part in 2**(BITS - 9) besides.

A sketch of few records is mostly zeros; until it holds more than LAZY distinct codes it travels as its
codes and weights, which are added into the arrays when ranks are asked for. Tables of sketches hold pieces of
PIECE numbers a row, which tasks fold in the order of their keys, one key at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.session import tree_fan

BITS = 20
EXACT_BITS = 11
WIDTH = 512
DEPTH = 5
LAZY = 4096
PIECE = 512
#: A task hands its sketches on when they take this many bytes, and rows of pieces when they do.
HELD_BYTES = 256 << 20
OUT_BYTES = 8 << 20

_LEVELS = range(EXACT_BITS + 1, BITS + 1)
_EXACT = 1 << EXACT_BITS
_DEEPEST = 15
_SEEDS = np.random.default_rng(20).integers(1, 2**63, size=(BITS + 1, _DEEPEST, 2), dtype=np.uint64) | np.uint64(1)

_PART = "key_a int, key_b int, part int, piece int, codes binary, numbers binary"


def width_for(error: float, largest: float, depth: int = DEPTH) -> int:
    """Columns (a power of two) for ranks within `error` of n, by three standard errors, where no interval of the finer
    resolutions holds more than the share `largest` of a group (so F2 is at most `largest` times n squared)."""
    need = len(_LEVELS) * largest * (3 * 1.2533 / math.sqrt(depth) / error) ** 2
    return 1 << max(6, math.ceil(math.log2(need)))


def encode(values: np.ndarray) -> np.ndarray:
    """Order-preserving codes: the leading BITS bits of the single-precision form. Rounds towards zero's side of a cell
    by at most 1 part in 2**(BITS - 9)."""
    raw = np.ascontiguousarray(values.astype(np.float64)).view(np.int64)
    # rebased double: sign, 8 bits of exponent around 1, then mantissa
    exponent = (raw >> 52 & 0x7FF) - 1023 + 127
    magnitude = (np.clip(exponent, 0, 255) << 52 | raw & 0xFFFFFFFFFFFFF) >> (52 + 8 - (BITS - 1))
    half = np.int64(1) << (BITS - 1)
    magnitude = np.where(exponent <= 0, 0, np.where(exponent > 255, half - 1, magnitude))
    return np.where(raw < 0, half - 1 - magnitude, half + magnitude)


def decode(codes: np.ndarray) -> np.ndarray:
    """The value of a code's cell that is nearest to zero."""
    half = np.int64(1) << (BITS - 1)
    negative = codes < half
    magnitude = np.where(negative, half - 1 - codes, codes - half).astype(np.int64)
    wide = magnitude << (52 + 8 - (BITS - 1))
    exponent = (wide >> 52) - 127 + 1023
    raw = exponent << 52 | wide & 0xFFFFFFFFFFFFF
    value = np.where(magnitude == 0, 0.0, raw.astype(np.int64).view(np.float64))
    return np.where(negative, -value, value)


@dataclass
class Sketch:
    """The sketch of one group: codes with weights while there are few, else one array of all resolutions."""

    width: int = WIDTH
    depth: int = DEPTH
    codes: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    counters: np.ndarray | None = None

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.codes.append(codes)
        self.weights.append(weights)
        if sum(map(len, self.codes)) > 2 * LAZY:
            self._settle()

    def add_piece(self, piece: int, codes: bytes, numbers: np.ndarray) -> None:
        if piece < 0:
            self.add(np.frombuffer(codes, np.int32).astype(np.int64), numbers)
        else:
            self._open()[piece * PIECE : piece * PIECE + len(numbers)] += numbers

    def _open(self) -> np.ndarray:
        if self.counters is None:
            self.counters = np.zeros(_EXACT + len(_LEVELS) * self.depth * self.width, np.int64)
        return self.counters

    def _settle(self) -> None:
        """Put equal codes together; too many of them, or any beside arrays, go into the arrays."""
        if not self.codes:
            return
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        weights = np.bincount(at, weights=np.concatenate(self.weights), minlength=len(codes)).astype(np.int64)
        codes, weights = codes[weights != 0], weights[weights != 0]
        self.codes, self.weights = [codes], [weights]
        if len(codes) > LAZY or self.counters is not None:
            self.fill()

    def fill(self) -> np.ndarray:
        """The arrays, with all codes added at every resolution."""
        counters = self._open()
        if self.codes:
            codes, weights = np.concatenate(self.codes), np.concatenate(self.weights)
            counters[:_EXACT] += np.bincount(codes >> (BITS - EXACT_BITS), weights=weights, minlength=_EXACT).astype(np.int64)
            for level in _LEVELS:
                nodes = codes >> (BITS - level)
                for row, counts in enumerate(self._rows(level)):
                    column, sign = _cells(nodes, level, row, self.width)
                    counts += np.bincount(column, weights=sign * weights, minlength=self.width).astype(np.int64)
            self.codes, self.weights = [], []
        return counters

    def _rows(self, level: int) -> np.ndarray:
        """The rows of a resolution's sketch, as a view."""
        at = _EXACT + (level - EXACT_BITS - 1) * self.depth * self.width
        return self.counters[at : at + self.depth * self.width].reshape(self.depth, self.width)

    def _estimate(self, nodes: np.ndarray, level: int) -> np.ndarray:
        cells = [_cells(nodes, level, row, self.width) for row in range(self.depth)]
        return np.median([counts[column] * sign for counts, (column, sign) in zip(self._rows(level), cells)], axis=0)

    def invert(self, ranks: np.ndarray) -> np.ndarray:
        """Codes at the given ranks (from 0): find the cell of the exact resolution, then descend."""
        steps = np.cumsum(self.counters[:_EXACT])
        node = np.minimum(np.searchsorted(steps, ranks, side="right"), _EXACT - 1)
        rest = ranks - np.where(node > 0, steps[node - 1], 0)
        total = self.counters[node].astype(float)
        for level in _LEVELS:
            left = node * 2
            low, high = (np.maximum(self._estimate(left + side, level), 0) for side in (0, 1))
            both = low + high
            count = np.where(both > 0, total * low / np.where(both > 0, both, 1), total / 2)
            right = rest >= count
            rest = np.where(right, rest - count, rest)
            total = np.where(right, total - count, count)
            node = left + right
        return node

    def rank_error(self) -> float:
        """Three standard errors of a rank, as a share of n."""
        n = self.counters[:_EXACT].sum()
        f2 = sum(float(np.median(np.sum(self._rows(level).astype(float) ** 2, axis=1))) for level in _LEVELS)
        return 3 * 1.2533 / math.sqrt(self.depth) * math.sqrt(f2 / self.width) / float(n)

    def size(self) -> int:
        return (0 if self.counters is None else self.counters.nbytes) + 16 * sum(map(len, self.codes))

    def pieces(self) -> Iterator[tuple[int, bytes, bytes]]:
        self._settle()
        for codes, weights in zip(self.codes, self.weights):
            for at in range(0, len(codes), PIECE):
                yield -1, codes[at : at + PIECE].astype(np.int32).tobytes(), weights[at : at + PIECE].tobytes()
        if self.counters is not None:
            for piece, at in enumerate(range(0, len(self.counters), PIECE)):
                yield piece, b"", self.counters[at : at + PIECE].tobytes()


def _cells(codes: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of each interval of a resolution in one row of its sketch."""
    a, b = _SEEDS[level, row]
    x = (codes.astype(np.uint64) + np.uint64(1)) * a
    x ^= x >> np.uint64(29)
    x *= b
    return (x >> np.uint64(40)).astype(np.int64) % width, 1 - 2 * (x >> np.uint64(33) & np.uint64(1)).astype(np.int64)


class _Rows:
    """Gathers pieces into batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def put(self, key: tuple[int, int], part: int, sketch: Sketch) -> Iterator[pa.RecordBatch]:
        for piece, codes, numbers in sketch.pieces():
            self.rows.append((*key, part, piece, codes, numbers))
            self.bytes += len(codes) + len(numbers)
            if self.bytes > OUT_BYTES:
                yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            kinds = [pa.int32()] * 4 + [pa.binary()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), kinds)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, names=["key_a", "key_b", "part", "piece", "codes", "numbers"])


def _build(width: int, depth: int, fan: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) % fan
        sketches: dict[tuple[int, int], Sketch] = {}
        held: list = []
        out = _Rows()

        def gather() -> None:
            a, b, v, w = (np.concatenate([h[i] for h in held]) for i in range(4))
            pair = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
            order = np.argsort(pair, kind="stable")
            pair, codes, w = pair[order], encode(v[order]), w[order].astype(np.int64)
            keys, starts = np.unique(pair, return_index=True)
            for key, lo, hi in zip(keys.tolist(), starts, np.append(starts[1:], len(pair))):
                k = (key >> 32, (key & 0xFFFFFFFF) - (2**32 if key & 0x80000000 else 0))
                sketches.setdefault(k, Sketch(width, depth)).add(codes[lo:hi], w[lo:hi])
            held.clear()

        def hand_on() -> Iterator[pa.RecordBatch]:
            for key, sketch in sketches.items():
                yield from out.put(key, part, sketch)
            sketches.clear()

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            if sum(len(h[0]) for h in held) >= rows:
                gather()
                if sum(s.size() for s in sketches.values()) > HELD_BYTES:
                    yield from hand_on()
        if held:
            gather()
        yield from hand_on()
        yield from out.end()

    return run


def _fold(batches: Iterator[pa.RecordBatch], width: int, depth: int, by_part: bool) -> Iterator[tuple[tuple[int, int], Sketch]]:
    """The sums of the sketches of each key (and part), whose pieces come one after another."""
    now, sketch = None, None
    for batch in batches:
        a, b, part, piece = (batch.column(i).to_pylist() for i in range(4))
        for i, key in enumerate(zip(a, b, part if by_part else (0,) * len(a))):
            if key != now:
                if sketch is not None:
                    yield now[:2], sketch
                now, sketch = key, Sketch(width, depth)
            sketch.add_piece(piece[i], batch.column(4)[i].as_py(), np.frombuffer(batch.column(5)[i].as_buffer(), np.int64))
    if sketch is not None:
        yield now[:2], sketch


def _merge(width: int, depth: int, by_part: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for key, sketch in _fold(batches, width, depth, by_part):
            yield from out.put(key, 0, sketch)
        yield from out.end()

    return run


def sketches(
    df: DataFrame, keys: tuple[str, str], value: Column, weight: Column | None = None, width: int = WIDTH, depth: int = DEPTH, fan: int | None = None
) -> DataFrame:
    """Mergeable sketches per pair of 32-bit keys: the rows of `sketches` of several tables may be put together with
    unionByName and merged by `merge_sketches`, if their width (a multiple of 64) and depth (odd) are the same.

    Null keys, null or NaN values and null weights take no part; repeated rows count each time; other
    columns are ignored; an empty table gives no rows. A weight of -1 takes a record out again.
    """
    if depth % 2 == 0 or depth > _DEEPEST:
        raise ValueError(f"depth must be odd and at most {_DEEPEST}")
    a, b = keys
    rows = df.select(
        F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"), value.cast("double").alias("v"),
        (F.lit(1) if weight is None else weight).cast("int").alias("w"),
    ).filter("a IS NOT NULL AND b IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND w IS NOT NULL")
    return rows.mapInArrow(_build(width, depth, fan or tree_fan(df.sparkSession), 500_000), _PART)


def _by_part(parts: DataFrame, width: int, depth: int) -> DataFrame:
    """The first step of a merge: sketches of a key within groups of tasks."""
    some = parts.repartition("key_a", "key_b", "part").sortWithinPartitions("key_a", "key_b", "part")
    return some.mapInArrow(_merge(width, depth, True), _PART)


def _by_key(parts: DataFrame) -> DataFrame:
    return parts.repartition("key_a", "key_b").sortWithinPartitions("key_a", "key_b")


def merge_sketches(parts: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """Add the sketches of equal keys, first within groups of tasks, then over all; tasks hold one key at a time."""
    return _by_key(_by_part(parts, width, depth)).mapInArrow(_merge(width, depth, False), _PART)


def _ask(fractions: list[float], width: int, depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key_a", "key_b", "n", "quantiles", "rank_error"])

        for key, sketch in _fold(batches, width, depth, False):
            n = int(sketch.fill()[:_EXACT].sum())
            if n > 0:
                at = np.array(fractions) * (n - 1)
                low = np.floor(at).astype(np.int64)
                values = decode(sketch.invert(np.concatenate([low, np.minimum(low + 1, n - 1)]).astype(float)))
                lo, hi = values[: len(at)], np.maximum(values[len(at) :], values[: len(at)])
                out.append((*key, n, (lo + (hi - lo) * (at - low)).tolist(), sketch.rank_error()))
            if len(out) == 1000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def quantiles(parts: DataFrame, keys: tuple[str, str], fractions: list[float], width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(keys, n, quantiles, rank_error) of a table of sketches, merged or not: linear interpolation between the
    neighbouring ranks, as percentile() does. rank_error is three standard errors of a rank as a share of n; each value is
    off by at most 1 part in 2**(BITS - 9). Groups whose records were all deleted give no row."""
    some = _by_key(_by_part(parts, width, depth))
    out = some.mapInArrow(_ask(fractions, width, depth), "key_a int, key_b int, n bigint, quantiles array<double>, rank_error double")
    return out.select(F.col("key_a").alias(keys[0]), F.col("key_b").alias(keys[1]), "n", "quantiles", "rank_error")
