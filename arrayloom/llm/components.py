"""Groups of records linked by pairs: strip, compress, solve the core, restore.

Each round first strips the vertices of degree one, then compresses chains of vertices of degree two
by list ranking (pointer jumping towards the smaller neighbour, which ends at a branching vertex or at
a local minimum of the chain, so cycles end too). What remains when a round removes little is the core;
it is solved by alternating large and small stars. Removed vertices then get their parents' labels,
in the reverse order of their removal. Degrees and neighbours come from one aggregation with partial
sums and edges are removed by their own pair of ids, so there a hub of very many links loads no single task;
joins on the vertex itself (stars, labels) are split at a hub by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.session import forget, write_through

#: A round that removes less than this share of the edges ends the reduction.
LEAST_PROGRESS = 0.05
MAX_ROUNDS = 20


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with u < v, each once."""
    return df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct()


def _degrees(edges: DataFrame) -> DataFrame:
    """(x, degree, low, high): with degree 1 or 2, low and high are the neighbours."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e"))
    return ends.groupBy("e.x").agg(F.count("*").alias("degree"), F.min("e.y").alias("low"), F.max("e.y").alias("high"))


def _strip(edges: DataFrame) -> DataFrame:
    """(x, parent, u, v): vertices of degree one; of two that hang together the smaller stays."""
    leaves = _degrees(edges).filter("degree = 1")
    return (
        leaves.groupBy(F.least("x", "low").alias("u"), F.greatest("x", "low").alias("v"))
        .agg(F.max("x").alias("x"))
        .select("x", F.when(F.col("x") == F.col("v"), F.col("u")).otherwise(F.col("v")).alias("parent"), "u", "v")
    )


def _rank_chains(chain: DataFrame) -> DataFrame:
    """(x, parent, hops): list ranking by pointer jumping along parent < x."""
    last = ranked = write_through(chain.select("x", F.col("low").alias("parent"), F.lit(1).cast("bigint").alias("hops")))
    while True:
        nxt = ranked.select(F.col("x").alias("parent"), F.col("parent").alias("grand"), F.col("hops").alias("more"))
        jumped = write_through(ranked.join(nxt, "parent", "left"))
        moved = jumped.filter("grand IS NOT NULL")
        if moved.isEmpty():
            forget(jumped)
            return ranked
        forget(last)
        last, ranked = jumped, jumped.select("x", F.coalesce("grand", "parent").alias("parent"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contract the chains: the new edges, and (x, parent, hops) of the vertices that were removed."""
    chain = write_through(_degrees(edges).filter("degree = 2 AND x > low"))
    ranked = _rank_chains(chain)
    gone = chain.select(F.explode(F.array("low", "high")).alias("y"), "x").select(
        F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")
    )
    roots = ranked.select("x", F.col("parent").alias("root"))
    other = roots.select(F.col("x").alias("high"), F.col("root").alias("high_root"))
    new = (
        chain.join(roots, "x").join(other, "high", "left")
        .select("root", F.coalesce("high_root", "high").alias("end"))
    )
    kept = edges.join(gone, ["u", "v"], "left_anti")
    return kept.unionByName(_pairs(new, "root", "end")).distinct(), ranked


def solve_core(edges: DataFrame) -> DataFrame:
    """(x, root): alternating large and small stars until nothing changes; root is the smallest vertex."""
    state = write_through(_pairs(edges, "u", "v"))
    while True:
        arcs = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = arcs.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        stars = write_through(_pairs(large, "a", "b"))
        least = stars.groupBy("v").agg(F.min("u").alias("m"))
        small = stars.join(least, "v").select("m", F.explode(F.array("u", "v")).alias("b"))
        after = write_through(_pairs(small, "m", "b"))
        forget(stars)
        forget(state)
        # a star forest: every vertex hangs below one root that hangs below nothing
        tops = after.groupBy("v").agg(F.count("*").alias("n"))
        if tops.filter("n > 1").isEmpty() and after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return after.select(F.col("v").alias("x"), F.col("u").alias("root")).unionByName(after.select(F.col("u").alias("x"), F.col("u").alias("root")).distinct())
        state = after


def _restore(labels: DataFrame, removed: DataFrame) -> DataFrame:
    """Labels of removed vertices from their parents'; a parent without a label is a root itself."""
    parents = labels.select(F.col("x").alias("parent"), "root")
    below = removed.join(parents, "parent", "left").select("x", F.coalesce("root", "parent").alias("root"))
    bare = removed.select(F.col("parent").alias("x")).distinct().join(labels, "x", "left_anti")
    return labels.unionByName(below).unionByName(bare.select("x", F.col("x").alias("root")))


def groups(vertices: DataFrame, vertex: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, group_id): one row per distinct vertex of both tables; group_id is the smallest vertex of
    all that are linked directly or indirectly, its own if alone.

    Keys are whole numbers. Null keys and links with a null end take no part; self-links and repeated
    links change nothing; ends that `vertices` lacks get rows too. Other columns are ignored.
    """
    spark: SparkSession = vertices.sparkSession
    edges = write_through(_pairs(links.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")), "a", "b"))
    every = vertices.select(F.col(vertex).cast("bigint").alias("x")).filter("x IS NOT NULL")
    every = every.unionByName(edges.select(F.col("u").alias("x"))).unionByName(edges.select(F.col("v").alias("x"))).distinct()
    removed: list[DataFrame] = []
    given, left = edges, edges.count()
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        stripped = write_through(_strip(edges))
        rest = write_through(edges.join(stripped, ["u", "v"], "left_anti"))
        smaller, ranked = _compress(rest)
        last, edges = edges, write_through(smaller)
        if last is not given:  # every still reads the first ones
            forget(last)
        forget(rest)
        removed += [stripped.select("x", "parent"), ranked.select("x", "parent")]
        now = edges.count()
        left, before = now, left
        if now > (1 - LEAST_PROGRESS) * before:
            break
    labels = solve_core(edges) if left else spark.createDataFrame([], "x bigint, root bigint")
    for gone in reversed(removed):
        last, labels = labels, write_through(_restore(labels, gone))
        forget(last)
    smallest = labels.groupBy("root").agg(F.min("x").alias("group_id"))
    named = labels.join(smallest, "root").select("x", "group_id")
    return every.join(named, "x", "left").select(F.col("x").alias(vertex), F.coalesce("group_id", "x").alias("group_id"))
