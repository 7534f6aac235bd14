"""Per-key results under heavy skew by dense accumulator arrays.

Every input split dictionary-encodes its keys and reduces its rows into dense numpy arrays, one slot
per key; so a hot key costs a split no more than any other rows. The arrays leave the split as blocks
(as many as there are reduce tasks, chosen by a hash of the key) and are merged in a tree: first within groups of
splits, then overall. No row of the input is shuffled by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.session import tree_blocks, tree_fan

#: Rows that a split reduces at a time.
HELD = 200_000
_ARRAYS = "block int, part int, keys array<bigint>, ids array<bigint>, values array<double>"


def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two 32-bit keys as one number."""
    return (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)


def _top(keys: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense top-k in arrays of k slots a key of the dictionary (sorted keys); of the slots in use, the keys, ids and values.

    Larger values first, then smaller ids; rows of one key and id count once."""
    dictionary, codes = np.unique(keys, return_inverse=True)
    slots = (len(dictionary), k)
    out_ids, out_values = np.full(slots, -1, np.int64), np.full(slots, -np.inf)
    used = np.zeros(slots, bool)
    live = np.arange(len(keys))
    if len(live):
        for slot in range(k):
            best = np.full(len(dictionary), -np.inf)
            np.maximum.at(best, codes[live], values[live])
            ties = live[values[live] == best[codes[live]]]
            first = np.full(len(dictionary), np.iinfo(np.int64).max)
            np.minimum.at(first, codes[ties], ids[ties])
            has = np.bincount(codes[ties], minlength=len(dictionary)) > 0
            out_ids[has, slot], out_values[has, slot], used[has, slot] = first[has], best[has], True
            live = live[ids[live] != first[codes[live]]]
            if not len(live):
                break
    keep = used.ravel()
    return np.repeat(dictionary, k)[keep], out_ids.ravel()[keep], out_values.ravel()[keep]


def _blocks(keys: np.ndarray, ids: np.ndarray, values: np.ndarray, blocks: int, part: int) -> Iterator[pa.RecordBatch]:
    at = _block_of(keys, blocks)
    order = np.argsort(at, kind="stable")
    at, keys, ids, values = at[order], keys[order], ids[order], values[order]
    present, starts = np.unique(at, return_index=True)
    offsets = pa.array(np.append(starts, len(at)).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(present.astype(np.int32)),
            pa.array(np.full(len(present), part, np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(keys)),
            pa.ListArray.from_arrays(offsets, pa.array(ids)),
            pa.ListArray.from_arrays(offsets, pa.array(values)),
        ],
        names=["block", "part", "keys", "ids", "values"],
    )


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches, put together to at least HELD rows but for the last."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, rows = [], 0
    if rows:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def _split_top(k: int, blocks: int, fan: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        top = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for a, b, i, v in _together(batches):
            more = _pack(a, b), i.astype(np.int64), v.astype(float)
            top = _top(*(np.concatenate(x) for x in zip(top, more)), k)
        context = TaskContext.get()
        if len(top[0]):
            yield from _blocks(*top, blocks, context.partitionId() % fan if context else 0)

    return run


def _merge_top(k: int, final: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        keys, ids, values = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "ids", "values"))
        keys, ids, values = _top(keys, ids, values, k)
        if final:
            return pa.table({"key": keys, "id": ids, "value": values})
        one = pa.array([0, len(keys)], pa.int32())
        return pa.table(
            {
                "block": table.column("block")[:1],
                "part": pa.array([0], pa.int32()),
                "keys": pa.ListArray.from_arrays(one, pa.array(keys)),
                "ids": pa.ListArray.from_arrays(one, pa.array(ids)),
                "values": pa.ListArray.from_arrays(one, pa.array(values)),
            }
        )

    return run


def top_per_key(
    df: DataFrame, keys: tuple[str, str], id_col: str, value: Column, k: int = 3, blocks: int | None = None, fan: int | None = None
) -> DataFrame:
    """(keys, id_col, value): of each pair of 32-bit keys the k rows of largest `value` (a column), ties to the
    smaller id.

    Rows with a null key or id or a null or NaN value take no part; rows that repeat a key and id count
    once (with their largest value); infinite values are values. An empty table gives no rows; other columns are
    ignored. A task holds k slots per key it meets, never the rows of a key.
    """
    a, b = keys
    rows = df.select(
        F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"), F.col(id_col).cast("long").alias("i"),
        value.cast("double").alias("v"),
    ).filter("a IS NOT NULL AND b IS NOT NULL AND i IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    parts = rows.mapInArrow(_split_top(k, blocks or tree_blocks(df.sparkSession), fan or tree_fan(df.sparkSession)), _ARRAYS)
    merged = parts.groupBy("block", "part").applyInArrow(_merge_top(k, False), _ARRAYS)
    out = merged.groupBy("block").applyInArrow(_merge_top(k, True), "key bigint, id bigint, value double")
    return out.select(
        F.shiftright("key", 32).cast("int").alias(a),
        _low("key").alias(b),
        F.col("id").alias(id_col),
        F.col("value"),
    )


def _sum(keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense counts and sums by bincount over the codes of the dictionary."""
    dictionary, codes = np.unique(keys, return_inverse=True)
    n = len(dictionary)
    return (
        dictionary,
        np.bincount(codes, weights=counts, minlength=n).astype(np.int64),
        np.bincount(codes, weights=values, minlength=n),
    )


def _split_sum(blocks: int, fan: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for a, b, v in _together(batches):
            more = _sum(_pack(a, b), np.ones(len(a), np.int64), v.astype(float))
            total = _sum(*(np.concatenate(x) for x in zip(total, more)))
        context = TaskContext.get()
        if len(total[0]):
            yield from _blocks(*total, blocks, context.partitionId() % fan if context else 0)

    return run


def _merge_sum(final: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        arrays = _sum(*(table.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "ids", "values")))
        if final:
            return pa.table(dict(zip(("key", "n", "total"), arrays)))
        one = pa.array([0, len(arrays[0])], pa.int32())
        lists = [pa.ListArray.from_arrays(one, pa.array(x)) for x in arrays]
        return pa.table([table.column("block")[:1].combine_chunks(), pa.array([0], pa.int32()), *lists], names=table.column_names)

    return run


def totals_per_key(df: DataFrame, keys: tuple[str, str], value: Column, blocks: int | None = None, fan: int | None = None) -> DataFrame:
    """(keys, n, total): count and sum of `value` (a column) of each pair of 32-bit keys, by dense arrays.

    Rows with a null key or a null or NaN value take no part; repeated rows count each time (deduplicate
    before, where they must not). An empty table gives no rows; other columns are ignored.
    """
    a, b = keys
    rows = df.select(
        F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"), value.cast("double").alias("v")
    ).filter("a IS NOT NULL AND b IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    parts = rows.mapInArrow(_split_sum(blocks or tree_blocks(df.sparkSession), fan or tree_fan(df.sparkSession)), _ARRAYS)
    merged = parts.groupBy("block", "part").applyInArrow(_merge_sum(False), _ARRAYS)
    out = merged.groupBy("block").applyInArrow(_merge_sum(True), "key bigint, n bigint, total double")
    return out.select(F.shiftright("key", 32).cast("int").alias(a), _low("key").alias(b), "n", "total")


def _low(name: str) -> Column:
    """The lower 32 bits as a signed int."""
    low = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")
