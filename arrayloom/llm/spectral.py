"""Clusters of similar values per owner by power-iteration spectral clustering.

Values of one owner are similar if they differ by at most its width. They are first put into cells of
that width: all values of a cell are similar, and only neighbouring cells can hold similar values. So
the sparse affinity matrix has one vertex per cell, its size follows the range of the values and not the
number of records. Its entries are 1 for a cell itself and for neighbouring cells that hold similar values
(the mean, not the sum, over pairs of values, so a thin bridge between two crowds counts as much as they do).

Its rows are normalised (random walk), and several random vectors, columns of a distributed table, are
multiplied with it again and again. The eigenvalue 1 has as many eigenvectors as there are clusters; all
other eigenvalues must die out. A run of L linked cells has none between 1 - 2 (1 - cos(pi / L)) / 3 and 1 and
none below -1/3, so the products are combined by the Chebyshev recurrence for that interval, which needs about
8 L products instead of L squared. Passes assume runs of 16 cells, then of four times as many and so on; an
owner takes part until its linked cells agree to TOLERANCE. A pass works on blocks of cells with a halo of as
many cells as it has products, so no task holds all cells of an owner.

The embedding is clustered by k-means: k is the number of distinct points in it (the multiplicity of the
eigenvalue 1), which are the seeds. Members are ranked by their affinity to the rest of their cluster, which
a quadratic kernel gives from the cluster's moments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.functions.signal import with_halo
from arrayloom.operators.joins import spread_join
from arrayloom.session import forget, write_through

VECTORS = 4
#: Largest difference of the vectors between linked cells at the end.
TOLERANCE = 1e-9
#: Embeddings nearer than this in every vector belong to one centre.
RESOLUTION = 1e-6
FIRST_RUN = 16
#: A pass never looks further than this many cells; longer runs take several passes.
FARTHEST = 8192
_NAMES = [f"v{i}" for i in range(VECTORS)]


def _cell(value: str, width: str) -> Column:
    at = F.try_divide(F.col(value), F.col(width))
    return F.when(F.col(width) > 0, F.when(F.abs(at) < 2.0**62, F.floor(at).cast("double")).otherwise(at)).otherwise(F.col(value))


def _linked(cells: DataFrame) -> DataFrame:
    """Adds to_next and to_last (0 or 1): affinities with the neighbouring cells."""
    line = Window.partitionBy("owner", "chunk").orderBy("cell")
    near = with_halo(cells.filter("width > 0"), "cell", 1, 1, 1024)
    near = near.withColumn("to_next", (F.lead("cell").over(line) - F.col("cell") == 1) & (F.lead("low").over(line) - F.col("high") <= F.col("width")))
    near = near.withColumn("to_last", F.lag("to_next").over(line)).filter("core").drop("chunk", "core")
    links = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("to_next", "to_last")}
    alone = cells.filter("NOT width > 0").withColumns({c: F.lit(0.0) for c in links})
    return near.withColumns(links).unionByName(alone)


def _degree(run: int) -> tuple[float, int]:
    """The largest eigenvalue below 1 that a run of linked cells can have, and the products that damp it to TOLERANCE / 10."""
    below = 1 - 2 * (1 - math.cos(math.pi / run)) / 3
    return below, math.ceil(math.acosh(10 / TOLERANCE) / math.acosh((7 / 3 - below) / (below + 1 / 3)))


def _multiply(below: float, times: int) -> Callable:
    """Multiply the vectors of whole blocks with the Chebyshev polynomial of the affinities that is 1 at 1 and small
    from -1/3 to `below`; adds the largest difference from linked cells."""

    def polynomial(block: pa.Table) -> pa.RecordBatch:
        to_next, to_last = (block.column(c).to_numpy()[:, None] for c in ("to_next", "to_last"))
        v = np.stack([block.column(c).to_numpy() for c in _NAMES], axis=1)
        where = [block.column(c).combine_chunks() for c in ("owner", "chunk")]
        same = np.append(np.logical_and.reduce([pa.compute.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in where]), False)
        to_next = np.where(same[:, None], to_next, 0.0)
        to_last = np.where(np.append(False, same[:-1])[:, None], to_last, 0.0)
        degree = 1 + to_next + to_last

        def walk(x: np.ndarray) -> np.ndarray:
            out = x.copy()
            out[:-1] += to_next[:-1] * x[1:]
            out[1:] += to_last[1:] * x[:-1]
            return out / degree

        middle, half = (below - 1 / 3) / 2, (below + 1 / 3) / 2
        ratio = (1 - middle) / half
        # t is T(k) / T(k-1) of the recurrence at 1
        last, v, t = v, (walk(v) - middle * v) / (1 - middle), ratio
        for _ in range(times - 1):
            grown = 2 * ratio - 1 / t
            last, v, t = v, (2 / half * (walk(v) - middle * v) - last / t) / grown, grown
        apart = np.abs(np.diff(v, axis=0)).max(axis=1, initial=0) * to_next[:-1, 0]
        apart = np.maximum(np.append(apart, 0), np.append(0, apart))
        core = block.column("core").to_numpy(zero_copy_only=False)
        columns = [block.column(c).combine_chunks() for c in ("owner", "cell", "to_next", "to_last")] + [pa.array(x) for x in (*v.T, apart)]
        return pa.RecordBatch.from_arrays(columns, names=["owner", "cell", "to_next", "to_last", *_NAMES, "apart"]).filter(pa.array(core))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                owner, chunk = batch.column("owner"), batch.column("chunk")
                inner = np.flatnonzero(pa.compute.or_(pa.compute.not_equal(owner[1:], owner[:-1]), pa.compute.not_equal(chunk[1:], chunk[:-1])).to_numpy(zero_copy_only=False))
                cut = int(inner[-1]) + 1 if len(inner) else 0
                if held and (owner[0], chunk[0]) != (held[-1].column("owner")[-1], held[-1].column("chunk")[-1]):
                    yield polynomial(pa.Table.from_batches(held))
                    held = []
                if cut:
                    yield polynomial(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield polynomial(pa.Table.from_batches(held))

    return run


def _embed(cells: DataFrame) -> DataFrame:
    """(owner, cell, v0..): the vectors that the iteration converges to. Runs a job for each pass."""
    start = {v: F.pmod(F.xxhash64("owner", "cell", F.lit(i)), F.lit(1 << 40)) / float(1 << 40) for i, v in enumerate(_NAMES)}
    begun = write_through(_linked(cells).select("owner", "cell", "to_next", "to_last").withColumns(start))
    has = F.col("to_next") + F.col("to_last") > 0
    done, active, run = [begun.filter(~has).select("owner", "cell", *_NAMES)], begun.filter(has), FIRST_RUN
    kind = cells.schema["owner"].dataType.simpleString()
    columns = f"owner {kind}, cell double, to_next double, to_last double, {', '.join(f'{v} double' for v in _NAMES)}, apart double"
    while True:
        below, times = _degree(run)
        if times > FARTHEST:
            times = FARTHEST
        else:
            run *= 4
        blocks = with_halo(active, "cell", times, times, 4 * times).repartition("owner", "chunk").sortWithinPartitions("owner", "chunk", "cell")
        passed = write_through(blocks.select("owner", "chunk", "cell", "core", "to_next", "to_last", *_NAMES).mapInArrow(_multiply(below, times), columns))
        late = write_through(passed.filter(F.col("apart") > TOLERANCE).select("owner").distinct())
        if late.isEmpty():
            done.append(passed.select("owner", "cell", *_NAMES))
            return reduce(DataFrame.unionByName, done)
        done.append(spread_join(passed, late, ["owner"], "cell", "left_anti").select("owner", "cell", *_NAMES))
        active = spread_join(passed, late, ["owner"], "cell", "left_semi").drop("apart")


def _far(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, ((F.col(f"{a}{v}") - F.col(f"{b}{v}")) ** 2 for v in _NAMES))


def _around(x: str) -> Column:
    """A slot of the first vector and the two beside it."""
    at = F.floor(F.col(x) / RESOLUTION)
    return F.explode(F.array(at - 1, at, at + 1))


def _means(nodes: DataFrame, by: list[str]) -> DataFrame:
    return nodes.groupBy("owner", *by).agg(F.min("cell").alias("centre_id"), F.count("*").alias("weight"), *[F.avg(v).alias(f"c_{v}") for v in _NAMES])


def _k_means(nodes: DataFrame) -> DataFrame:
    """Cluster the embedding of each owner; adds `centre`. Seeds are its distinct points: points of one slot of the
    size RESOLUTION, and such slots that a point on an edge has split. Every point then goes to its nearest centre
    and centres move to their points' means, until no point moves. Runs a job for each round."""
    slots = [F.floor(F.col(v) / RESOLUTION).alias(f"s{i}") for i, v in enumerate(_NAMES)]
    seeds = write_through(_means(nodes.select("*", *slots), [f"s{i}" for i in range(VECTORS)]).select("owner", "centre_id", *[f"c_{v}" for v in _NAMES]))
    one = seeds.withColumn("slot", F.floor(F.col("c_v0") / RESOLUTION))
    other = seeds.select("owner", F.col("centre_id").alias("other_id"), *[F.col(f"c_{v}").alias(f"d_{v}") for v in _NAMES], _around("c_v0").alias("slot"))
    close = reduce(lambda a, b: a & b, (F.abs(F.col(f"c_{v}") - F.col(f"d_{v}")) <= RESOLUTION for v in _NAMES))
    first = one.join(other, ["owner", "slot"]).filter(close).groupBy("owner", "centre_id").agg(F.min("other_id").alias("first"))
    centres = first.filter("centre_id = first").select("owner", "centre_id").join(seeds, ["owner", "centre_id"])
    last = None
    while True:
        near = nodes.withColumn("slot", F.floor(F.col("v0") / RESOLUTION)).join(centres.withColumn("slot", _around("c_v0")), ["owner", "slot"])
        best = near.groupBy("owner", "cell").agg(F.min(F.struct(_far("", "c_").alias("far"), F.col("centre_id"))).alias("best"), *[F.first(v).alias(v) for v in _NAMES])
        placed = write_through(best.select("owner", "cell", *_NAMES, F.col("best.centre_id").alias("centre")))
        if last is not None:
            moved = placed.join(last.select("owner", "cell", F.col("centre").alias("was")), ["owner", "cell"]).filter("centre <> was")
            stays = moved.isEmpty()
            forget(last)
            if stays:
                return placed
        last, centres = placed, _means(placed, ["centre"])


def similarity_clusters(
    df: DataFrame, member: str, owner: str, value: str, widths: DataFrame, width: str, least: int = 3
) -> DataFrame:
    """(cluster_id, member, owner, size, affinity): members of clusters of at least `least` members.

    `widths` gives each owner's width once or repeated (the largest counts); values with |difference| <= width are
    similar, and similarity chains. cluster_id is the smallest member of the cluster; affinity is the mean of
    1 - (difference / width)**2 over the other members (see most_typical). Repeated members count once; null
    members, owners and widths, null, NaN and infinite values take no part; a width of 0 makes equal values
    similar. Clusters too small give no rows. Other columns are ignored. Runs jobs while it is called.
    """
    rows = df.select(F.col(owner).alias("owner"), F.col(member).alias("member"), F.col(value).cast("double").alias("value"))
    rows = rows.filter("owner IS NOT NULL AND member IS NOT NULL AND abs(value) < double('Infinity')").distinct()
    wide = widths.select(F.col(owner).alias("owner"), F.col(width).cast("double").alias("width"))
    wide = wide.filter("owner IS NOT NULL AND width >= 0 AND width < double('Infinity')").groupBy("owner").agg(F.max("width").alias("width"))
    placed = write_through(spread_join(rows, wide, ["owner"], "member").withColumn("cell", _cell("value", "width")))
    cells = write_through(placed.groupBy("owner", "cell").agg(
        F.count("*").alias("n"), F.first("width").alias("width"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min("member").alias("first"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"),
    ))
    nodes = _k_means(write_through(_embed(cells))).join(cells, ["owner", "cell"])
    clusters = nodes.groupBy("owner", "centre").agg(
        F.sum("n").alias("size"), F.min("first").alias("cluster_id"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")
    ).filter(F.col("size") >= least)
    labels = write_through(nodes.select("owner", "cell", "centre").join(clusters, ["owner", "centre"]).drop("centre"))
    far = F.expr("size * value * value - 2 * value * s1 + s2")
    affinity = F.when(F.col("width") > 0, 1 - far / ((F.col("size") - 1) * F.col("width") ** 2)).otherwise(1.0)
    return spread_join(placed, labels, ["owner", "cell"], "member").select(
        "cluster_id", F.col("member").alias(member), F.col("owner").alias(owner), "size", affinity.alias("affinity")
    )


def most_typical(members: DataFrame, member: str, owner: str, k: int = 3, salts: int = 16) -> DataFrame:
    """(cluster_id, owner, size, rank, member): the k members of highest affinity (to six places; ties to the smaller
    member) of each cluster, first within salted parts of a cluster, then over the parts."""
    best = [F.desc("affinity"), F.asc(member)]
    part = Window.partitionBy("cluster_id", "salt").orderBy(*best)
    salted = members.withColumn("affinity", F.round("affinity", 6)).withColumn("salt", F.pmod(F.xxhash64(member), F.lit(salts))).withColumn("r", F.row_number().over(part))
    final = Window.partitionBy("cluster_id").orderBy(*best)
    top = salted.filter(F.col("r") <= k).withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return top.select("cluster_id", owner, "size", "rank", member)
