"""Connected components of an edge list: every vertex gets the smallest vertex linked to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.session import forget, write_through


def connected_components(edges: DataFrame, a: str, b: str, vertices: DataFrame | None = None, vertex: str | None = None) -> DataFrame:
    """(vertex, component): hooking to the smallest neighbour label, then pointer jumping, until nothing changes.
    Labels are written to the shared folder in every round. Null ends take no part; vertices without edges,
    given in `vertices`, are their own component."""
    arcs = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).filter("x <> y")
    arcs = write_through(arcs.unionByName(arcs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    last = labels = write_through(arcs.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("c")))
    while True:
        heard = arcs.join(labels.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("heard"))
        hooked = labels.join(heard, "x").select("x", "c", F.least("c", "heard").alias("d"))
        best = hooked.groupBy("c").agg(F.min("d").alias("e"))  # a whole label follows its best member
        followed = hooked.join(best, "c").select("x", "c", F.least("d", "e").alias("d"))
        up = followed.select(F.col("x").alias("d"), F.col("d").alias("g"))
        jumped = write_through(followed.join(up, "d", "left").select("x", "c", F.least("d", F.coalesce("g", "d")).alias("d")))
        forget(last)
        last, labels = jumped, jumped.select("x", F.col("d").alias("c"))
        if jumped.filter("c <> d").isEmpty():
            break
    out = labels
    name = vertex or "vertex"
    if vertices is not None:
        every = vertices.select(F.col(vertex).cast("long").alias("x")).filter("x IS NOT NULL").distinct()
        alone = every.join(labels, "x", "left_anti").select("x", F.col("x").alias("c"))
        out = labels.unionByName(alone)
    return out.select(F.col("x").alias(name), F.col("c").alias("component"))


def single_linkage(similar: DataFrame, a: str, b: str, similarity: str, least: float, vertices: DataFrame, vertex: str) -> DataFrame:
    """Single-linkage clusters cut at a similarity: components of the pairs with similarity >= least."""
    strong = similar.filter(F.col(similarity).isNotNull() & ~F.isnan(similarity) & (F.col(similarity) >= least))
    return connected_components(strong, a, b, vertices, vertex)
