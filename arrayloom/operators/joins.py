"""Joins that Spark would plan as a cartesian product, written as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.session import write_through


def _near(cell: Column) -> Column:
    return F.explode(F.array(cell - 1, cell, cell + 1))


def spread_join(large: DataFrame, small: DataFrame, by: list[str], salt: Column | str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join on `by` of a table in which one key may hold a third of all rows with one of few rows a key: the
    large side's keys are split into `salts` parts by `salt`, the small side stands in each of them once. `how` keeps
    or drops rows of the large side (inner, left, left_semi, left_anti). Keys are never null.

    Where the small side is known to be small Spark broadcasts it and the parts cost nothing but its copies."""
    some = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return large.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")).join(some, [*by, "_salt"], how).drop("_salt")


def band_pairs(left: DataFrame, right: DataFrame, by: list[str], x: str, y: str, width: float, wide: int = 1) -> DataFrame:
    """Pairs of rows with equal `by` and |x - y| <= width, x of the left and y of the right table. Buckets are `wide` times
    the width; the right rows stand in three buckets, or in one or two if those are wider than one. Column names of the
    two tables must differ but for `by`. Null and NaN values have no partner; width must be above 0."""
    size = width * wide
    at = F.floor(F.col(y) / size)
    reached = _near(at) if wide == 1 else F.explode(F.array_distinct(F.array(F.floor((F.col(y) - width * 1.001) / size), at, F.floor((F.col(y) + width * 1.001) / size))))
    a = left.filter(F.col(x).isNotNull() & ~F.isnan(x)).withColumn("_bucket", F.floor(F.col(x) / size))
    b = right.filter(F.col(y).isNotNull() & ~F.isnan(y)).withColumn("_bucket", reached)
    return a.join(b, [*by, "_bucket"]).filter(F.abs(F.col(x) - F.col(y)) <= width).drop("_bucket")


def coincidences(left: DataFrame, right: DataFrame, by: list[str], x: str, y: str, jitter: float, left_id: str) -> DataFrame:
    """Left rows with exactly one right row within `jitter`: (by, left_id and the columns of the pair)."""
    pairs = band_pairs(left, right, by, x, y, jitter)
    rest = [c for c in pairs.columns if c not in (*by, left_id)]
    one = pairs.groupBy(*by, left_id).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_pair")).filter("_n = 1")
    return one.select(*by, left_id, "_pair.*")


def asof_backward(probes: DataFrame, refs: DataFrame, by: list[str], time: str, ref_time: str, value: str, width: float) -> DataFrame:
    """Adds to each probe `value` of the last reference at or before it, null if there is none.

    Both sides go into buckets of `width` and are ordered inside a bucket only; what a bucket inherits, the last
    reference of an earlier one, comes from a window over one row per bucket. References of one time: the
    largest value. A probe without a time gets null. Both sides are written once, as they are read twice."""
    kind = F.struct(F.col(ref_time).alias("_t"), F.col(value).alias("_v"))
    r = refs.filter(F.col(ref_time).isNotNull()).select(*by, F.col(ref_time).alias("_at"), F.lit(0).alias("_side"), kind.alias("_ref"), F.lit(None).alias("_row"))
    p = probes.withColumn("_row", F.struct(*probes.columns))
    p = p.select(*by, F.col(time).cast(r.schema["_at"].dataType).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_ref"), "_row")
    both = write_through(r.unionByName(p).withColumn("_bucket", F.floor(F.col("_at") / width)))
    heads = both.groupBy(*by, "_bucket").agg(F.max("_ref").alias("_last"))
    before = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_inherited", F.max("_last").over(before)).drop("_last")
    inside = Window.partitionBy(*by, "_bucket").orderBy("_at", "_side", "_ref").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_ref", True).over(inside)).filter("_side = 1")
    same = [found[c].eqNullSafe(heads[c]) for c in (*by, "_bucket")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    out = found.join(heads, cond, "left").select(found["_row"], found["_at"], F.coalesce(found["_seen"], heads["_inherited"]).alias("_hit"))
    return out.select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_hit._v")).alias(value))


def pairs_within(points: DataFrame, key: str, x: str, y: str, distance: float) -> DataFrame:
    """(a, b, distance) with a < b: pairs of points at most `distance` apart, joined on grid cells of that width.
    Points of one place are reduced to the place first, so the grid join never holds more than the places."""
    points = points.filter(f"{key} IS NOT NULL AND {x} IS NOT NULL AND {y} IS NOT NULL")
    places = points.select(F.col(x).alias("x"), F.col(y).alias("y")).distinct()
    cx, cy = F.floor(F.col("x") / distance), F.floor(F.col("y") / distance)
    a = places.select(F.col("x").alias("ax"), F.col("y").alias("ay"), cx.alias("cx"), cy.alias("cy"))
    b = places.select(F.col("x").alias("bx"), F.col("y").alias("by"), _near(cx).alias("cx"), cy.alias("_cy")).select("bx", "by", "cx", _near(F.col("_cy")).alias("cy"))
    far = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    near = a.join(b, ["cx", "cy"]).withColumn("distance", far).filter(F.col("distance") <= distance).select("ax", "ay", "bx", "by", "distance")
    pa = points.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"))
    pb = points.select(F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"))
    return pa.join(near, ["ax", "ay"]).join(pb, ["bx", "by"]).filter("a < b").select("a", "b", "distance").distinct()


def set_overlap(sets: DataFrame, key: str, member: str, others: DataFrame | None = None) -> DataFrame:
    """(a, b, common, overlap): members in common over the size of the smaller set, for pairs that share any; a < b
    in one table, or a of `sets` and b of `others`. Repeated members count once. The distinct members are written
    once, as the join reads them several times."""

    def clean(df: DataFrame) -> DataFrame:
        return write_through(df.select(F.col(key).alias("k"), F.col(member).alias("m")).filter("k IS NOT NULL AND m IS NOT NULL").distinct())

    left = clean(sets)
    right = left if others is None else clean(others)
    a = left.join(left.groupBy("k").agg(F.count("*").alias("na")), "k").select(F.col("k").alias("a"), "m", "na")
    b = right.join(right.groupBy("k").agg(F.count("*").alias("nb")), "k").select(F.col("k").alias("b"), "m", "nb")
    pairs = a.join(b, "m")
    if others is None:
        pairs = pairs.filter("a < b")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.least(F.first("na"), F.first("nb")).alias("_least"))
    return out.select("a", "b", "common", (F.col("common") / F.col("_least")).alias("overlap"))


def list_overlap(sets: DataFrame, group: str, key: str, member: str) -> DataFrame:
    """(group_a, a, group_b, b, common, overlap): set_overlap between the sets of every two lists, group_a before
    group_b; `group` names the list of a set."""
    known = sets.filter(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(member).isNotNull())
    d = write_through(known.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(member).alias("m")).distinct())
    sized = d.join(d.groupBy("g", "k").agg(F.count("*").alias("n")), ["g", "k"])
    a, b = (sized.select(F.col("g").alias(f"group_{s}"), F.col("k").alias(s), "m", F.col("n").alias(f"n{s}")) for s in "ab")
    pairs = a.join(b, "m").filter("group_a < group_b")
    out = pairs.groupBy("group_a", "a", "group_b", "b").agg(F.count("*").alias("common"), F.least(F.first("na"), F.first("nb")).alias("_least"))
    return out.select("group_a", "a", "group_b", "b", "common", (F.col("common") / F.col("_least")).alias("overlap"))


def list_parts(sets: DataFrame, group: str, member: list[str]) -> DataFrame:
    """(group_a, group_b, part, n): members of every two lists that are in both, in the first only, in either;
    group_a before group_b. Lists without a common member are there, too."""
    known = sets.filter(F.col(group).isNotNull())
    for m in member:
        known = known.filter(F.col(m).isNotNull())
    d = write_through(known.select(F.col(group).alias("g"), *member).distinct())
    both = d.withColumnRenamed("g", "group_a").join(d.withColumnRenamed("g", "group_b"), member).filter("group_a < group_b")
    both = both.groupBy("group_a", "group_b").agg(F.count("*").alias("both"))
    size = write_through(d.groupBy("g").agg(F.count("*").alias("n")))
    a, b = (size.select(F.col("g").alias(f"group_{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    every = a.join(b, F.col("group_a") < F.col("group_b")).join(both, ["group_a", "group_b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    counts = {"both": F.col("both"), "first_only": F.col("na") - F.col("both"), "either": F.col("na") + F.col("nb") - F.col("both")}
    parts = F.explode(F.array(*[F.struct(F.lit(name).alias("part"), n.alias("n")) for name, n in counts.items()])).alias("p")
    return every.select("group_a", "group_b", parts).select("group_a", "group_b", "p.part", "p.n")


def in_boxes(points: DataFrame, row: str, col: str, boxes: DataFrame, size: int = 16) -> DataFrame:
    """Rows of `points` joined with the boxes (r0, r1, c0, c1, inclusive) that hold them, over tiles of the plane."""
    tiles = boxes.withColumn("_tr", F.explode(F.sequence(F.floor(F.col("r0") / size), F.floor(F.col("r1") / size))))
    tiles = tiles.withColumn("_tc", F.explode(F.sequence(F.floor(F.col("c0") / size), F.floor(F.col("c1") / size))))
    own = points.withColumn("_tr", F.floor(F.col(row) / size)).withColumn("_tc", F.floor(F.col(col) / size))
    inside = F.col(row).between(F.col("r0"), F.col("r1")) & F.col(col).between(F.col("c0"), F.col("c1"))
    return own.join(tiles, ["_tr", "_tc"]).filter(inside).drop("_tr", "_tc")


def _signed(sets: DataFrame, key: str, member: str) -> DataFrame:
    """(k, n, s1, s2): the number of distinct members of each set and two sums of their hashes, in any order."""
    known = sets.select(F.col(key).alias("k"), F.col(member).alias("m")).filter("k IS NOT NULL AND m IS NOT NULL").distinct()
    sums = [F.sum(F.xxhash64("m", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    return known.groupBy("k").agg(F.count("*").alias("n"), *sums)


def equal_sets(sets: DataFrame, others: DataFrame, key: str, member: str) -> DataFrame:
    """(a, b): sets of the two tables with the same distinct members, by number and two 64-bit hash sums of the members; so
    no set has to fit a row or a task. Empty sets aren't there."""
    a, b = _signed(sets, key, member).withColumnRenamed("k", "a"), _signed(others, key, member).withColumnRenamed("k", "b")
    return a.join(b, ["n", "s1", "s2"]).select("a", "b")


def set_classes(sets: DataFrame, key: str, member: str) -> DataFrame:
    """(key, class, n): the smallest key of all sets with the same distinct members (see equal_sets), and their number."""
    signed = _signed(sets, key, member)
    first = signed.groupBy("n", "s1", "s2").agg(F.min("k").alias("class"))
    return signed.join(first, ["n", "s1", "s2"]).select(F.col("k").alias(key), "class", "n")


def positions(sensors: DataFrame, row: str, col: str, ids: DataFrame) -> DataFrame:
    """Adds row_at and col_at: places of a sensor's row and column among the rows and columns that were read out, counting
    from 1. `ids` has kind ('row' or 'col') and id, at most a few thousand. A sensor that wasn't read out is an error."""
    at = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    known = ids.filter("id IS NOT NULL").distinct().withColumn("at", at)
    out = sensors
    for kind, c in (("row", row), ("col", col)):
        mine = known.filter(F.col("kind") == kind).select(F.col("id").alias(c), F.col("at").alias(f"{kind}_at"))
        out = out.join(F.broadcast(mine), c, "left")  # the side of the array
    lost = F.col("row_at").isNull() | F.col("col_at").isNull()
    failed = F.raise_error(F.concat(F.lit("sensor was not read out: "), F.coalesce(F.col(row).cast("string"), F.lit("?")), F.lit(", "), F.coalesce(F.col(col).cast("string"), F.lit("?"))))
    return out.withColumn("row_at", F.when(lost, failed.cast("int")).otherwise(F.col("row_at"))).withColumn("col_at", F.when(lost, failed.cast("int")).otherwise(F.col("col_at")))
