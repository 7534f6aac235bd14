"""Greedy agglomeration of regions of interest under a size limit."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.operators.components import connected_components
from arrayloom.operators.joins import set_overlap
from arrayloom.session import write_through


def agglomerate(sets: DataFrame, key: str, member: str, least_overlap: float, most: int, recording: str | None = None) -> DataFrame:
    """(recording, region, key): a seed takes in the set that overlaps it most, while overlap (common over the smaller
    size) is at least `least_overlap` and the union holds at most `most` members; else it is closed, and the set just
    refused is the next seed. Sets start in the order of their keys, equal overlaps keep the order so far. The
    region is named by its first seed. Recordings are apart; without the column, all sets are of one.

    The order of steps is part of the result, so it is followed set by set. But only sets linked by overlaps can meet:
    each connected component of overlapping sets of one recording is a task of its own. It holds at most as many sets as
    the array has sensors, and a step updates the overlaps of the members that the seed has gained only. Runs jobs while
    it is called."""
    own = F.lit("").alias("g") if recording is None else F.col(recording).alias("g")
    clean = sets.select(own, F.col(key).cast("long").alias("k"), F.col(member).cast("long").alias("m")).filter("g IS NOT NULL AND k IS NOT NULL AND m IS NOT NULL").distinct()
    clean = write_through(clean)
    named = write_through(clean.select("g", "k").distinct().withColumn("id", F.monotonically_increasing_id()))
    clean = write_through(clean.join(named, ["g", "k"]))
    overlaps = set_overlap(clean.select("id", F.struct("g", "m").alias("at")), "id", "at")
    parts = connected_components(overlaps, "a", "b", named, "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = {k: set(m) for k, m in pdf.groupby("k")["m"]}
        holders = defaultdict(list)
        for k, members in sets.items():
            for m in members:
                holders[m].append(k)
        rest, out = sorted(sets), []
        seed, common, name = set(), {}, None

        def gain(members: set) -> None:
            for m in members - seed:
                for k in holders[m]:
                    common[k] += 1
            seed.update(members)

        def overlap(k: int) -> float:
            return common[k] / min(len(seed), len(sets[k]))

        k = rest.pop(0)
        while True:
            if name is not None and overlap(k) >= least_overlap and len(seed | sets[k]) <= most:
                gain(sets[k])
            else:
                name, seed, common = k, set(), dict.fromkeys(sets, 0)
                gain(sets[k])
            out.append((pdf["g"].iloc[0], name, k))
            if not rest:
                return pd.DataFrame(out, columns=["g", "region", "k"])
            rest.sort(key=overlap, reverse=True)  # a stable sort keeps the order of equals
            k = rest.pop(0)

    kind = clean.schema["g"].dataType.simpleString()
    grown = clean.join(parts, "id").select("component", "g", "k", "m").groupBy("component").applyInPandas(run, f"g {kind}, region bigint, k bigint")
    return grown.select(*([] if recording is None else [F.col("g").alias(recording)]), "region", F.col("k").alias(key))
