"""Nearest record in time per entity, within a tolerance.

Records of both sides are range-partitioned together by (entity, time), so one entity may span any
number of tasks. Each partition is scanned once in order. What a scan can't see, the last right record
before its partition and the first one behind it, reaches it through a parallel prefix scan over one
edge record per partition: blocks of partitions are scanned side by side, then the blocks' ends, then
both are combined. Scans read batch by batch, so a partition may be larger than a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.session import reliable_checkpoint

_EDGE = "pid int, first struct<entity:string,time:double,id:bigint>, last struct<entity:string,time:double,id:bigint>"
_PAIR = "left_id bigint, right_id bigint"


def label_key(label: Column) -> Column:
    """Labels compared without surrounding white space and case."""
    return F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the first and the last right record of the partition."""
    from pyspark import TaskContext

    first = last = None
    for batch in batches:
        right = np.flatnonzero(batch.column("side").to_numpy() == 0)
        if len(right):
            ends = batch.take(pa.array([right[0], right[-1]])).select(["entity", "time", "id"]).to_pylist()
            first, last = first or ends[0], ends[1]
    if first is not None:
        edge = pa.struct([("entity", pa.string()), ("time", pa.float64()), ("id", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], edge), pa.array([last], edge)],
            names=["pid", "first", "last"],
        )


def _scan_edges(edges: DataFrame, partitions: int) -> DataFrame:
    """For each partition the last right record before it and the first behind it: a prefix scan of
    "the last that is there" (and its mirror image) over blocks of about sqrt(partitions) edges."""
    spark = edges.sparkSession
    size = max(2, int(np.ceil(np.sqrt(partitions))))
    every = spark.range(partitions).select(F.col("id").cast("int").alias("pid"))
    ends = (
        every.join(edges, "pid", "left")
        .withColumn("block", F.floor(F.col("pid") / size).cast("int"))
        .select("pid", "block", "first", "last")
    )
    ahead = Window.partitionBy("block").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("block").orderBy("pid").rowsBetween(1, Window.unboundedFollowing)
    inner = ends.withColumn("before", F.last("last", True).over(ahead)).withColumn("after", F.first("first", True).over(behind))
    blocks = ends.groupBy("block").agg(
        F.max_by("last", F.when(F.col("last").isNotNull(), F.col("pid"))).alias("last"),
        F.min_by("first", F.when(F.col("first").isNotNull(), F.col("pid"))).alias("first"),
    )
    over = Window.partitionBy(F.lit(0)).orderBy("block")
    carried = blocks.select(
        "block",
        F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("block_before"),
        F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("block_after"),
    )
    return inner.join(carried, "block").select(
        "pid", F.coalesce("before", "block_before").alias("before"), F.coalesce("after", "block_after").alias("after")
    )


def _nearest(rows: pa.Table, before: dict | None, after: dict | None) -> tuple[np.ndarray, ...]:
    """Of the left rows of a stretch in order: gap and id of the nearest right record, the place of the last right row up to
    each, and whether it repeats the row before it. The stretch is followed by `after` and follows `before`."""
    names = rows.column("entity").combine_chunks().dictionary_encode()
    known = {name: i for i, name in enumerate(names.dictionary.to_pylist())}
    code = names.indices.to_numpy()
    time, key, side = (rows.column(c).to_numpy() for c in ("time", "id", "side"))
    right = side == 0
    ends = [[(known.get(e["entity"], -1), e["time"], e["id"])] if e else [(-1, np.nan, 0)] for e in (before, after)]
    r_code, r_time, r_key = (np.concatenate([[ends[0][0][i]], x[right], [ends[1][0][i]]]) for i, x in enumerate((code, time, key)))
    l_code, l_time, l_key = code[~right], time[~right], key[~right]
    behind = np.cumsum(right)[~right]  # place of the last right record up to each left one, 0: the one before
    best_gap, best_key = np.full(len(l_key), np.inf), np.zeros(len(l_key), np.int64)
    for place in (behind, behind + 1):
        gap = np.where(r_code[place] == l_code, np.abs(r_time[place] - l_time), np.inf)
        take = (gap < best_gap) | ((gap == best_gap) & (gap < np.inf) & (r_key[place] < best_key))
        best_gap, best_key = np.where(take, gap, best_gap), np.where(take, r_key[place], best_key)
    again = np.append(False, (l_key[1:] == l_key[:-1]) & (l_time[1:] == l_time[:-1]) & (l_code[1:] == l_code[:-1]))
    return best_gap, best_key, behind, again[: len(l_key)]


def _scan(tolerance: float) -> Callable:
    """Match the left records of one partition, which comes in order of (entity, time, side, id).

    Batches are matched one by one. What is carried is the last right record, and the left rows behind it that a
    right record of the next batch may still serve: those of the last entity that lie within `tolerance` of the
    last row. So memory follows the records within one tolerance, not the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = after = held = None
        begun = False

        def match(rows: pa.Table, at_end: bool) -> tuple[pa.RecordBatch, pa.Table]:
            left = rows.filter(pa.compute.equal(rows.column("side"), 1))
            gap, found, behind, again = _nearest(rows, before, after if at_end else None)
            done = np.ones(len(left), bool)
            if not at_end:
                rights = len(rows) - len(left)
                other = pa.compute.not_equal(left.column("entity"), rows.column("entity")[-1]).to_numpy()
                done = (behind < rights) | other | (rows.column("time")[-1].as_py() - left.column("time").to_numpy() > tolerance)
            hit = done & (gap <= tolerance) & ~again  # a repeated record counts once
            pairs = pa.RecordBatch.from_arrays([pa.array(left.column("id").to_numpy()[hit]), pa.array(found[hit])], names=["left_id", "right_id"])
            return pairs, left.filter(pa.array(~done))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            if not begun:
                before, after, begun = batch.column("before")[0].as_py(), batch.column("after")[0].as_py(), True
            rows = pa.Table.from_batches([batch.select(["entity", "time", "side", "id"])])
            rows = rows if held is None else pa.concat_tables([held, rows])
            pairs, held = match(rows, False)
            yield pairs
            rights = np.flatnonzero(rows.column("side").to_numpy() == 0)
            if len(rights):
                before = rows.slice(rights[-1], 1).to_pylist()[0]
        if held is not None and len(held):
            yield match(held, True)[0]

    return run


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    time: str,
    left_id: str,
    right_id: str,
    tolerance: float,
) -> DataFrame:
    """(left_id, right_id): for each left record the right record of its entity nearest in time.

    |time difference| is at most `tolerance`; of equally near right records the smaller id is taken; a
    right record may serve several left ones. Null entities, null ids and null or NaN times take no part
    on either side; repeated left records give one row; left records without a partner give none. Empty
    tables give no rows. Both tables need the columns `entity` and `time`; other columns are ignored.
    A left id that occurs with several times or entities is matched once for each of them. Runs a job while it is called.
    """

    def clean(df: DataFrame, key: str, side: int) -> DataFrame:
        return df.select(
            F.col(entity).cast("string").alias("entity"), F.col(time).cast("double").alias("time"),
            F.lit(side).alias("side"), F.col(key).cast("long").alias("id"),
        ).filter("entity IS NOT NULL AND time IS NOT NULL AND NOT isnan(time) AND id IS NOT NULL")

    one = clean(right, right_id, 0).groupBy("entity", "time", "side").agg(F.min("id").alias("id"))
    both = one.unionByName(clean(left, left_id, 1))
    spark = left.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["entity", "time", "side", "id"]
    ranged = reliable_checkpoint(both.repartitionByRange(tasks, *order).sortWithinPartitions(*order))
    edges = ranged.mapInArrow(_edges, _EDGE)
    carries = _scan_edges(edges, ranged.rdd.getNumPartitions())
    # one small row for each partition of the data: bounded by the number of tasks
    with_edges = ranged.withColumn("pid", F.spark_partition_id()).join(F.broadcast(carries), "pid", "left")
    found = with_edges.select(*order, "before", "after").mapInArrow(_scan(tolerance), _PAIR)
    return found.select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id))
