"""Linear models of multichannel data, trained by passes of partial sums over all frames.

Data are frames (by, frame, x array<double>), all arrays of a group of one length p. What a pass gathers has
p * p numbers per group and task; only such matrices, never frames, meet in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.session import tree_fan, write_through

_SUMS = "_n bigint, _s array<double>, _g array<double>"
#: Numbers of partial sums that a task holds before it passes them on.
_HELD = 2_000_000
#: Up to so many components fast_ica sums the fourth moments of the frames once; with more, each round is a pass.
MOMENTS = 16


def frames_of(df: DataFrame, by: list[str], channel: str, value: str = "v", fill: float | None = None) -> DataFrame:
    """(by, frame, x): frames from the long form, channels in their order. Frames that lack a channel are dropped, or the
    missing values are `fill`. A channel's repeated values in a frame are an error."""
    order = df.groupBy(*by).agg(F.array_sort(F.collect_set(channel)).alias("_channels"))  # the channels of a group
    values = df.groupBy(*by, "frame").agg(F.map_from_entries(F.collect_list(F.struct(F.col(channel), F.col(value)))).alias("_x"))
    both = values.join(order, by)
    if fill is None:
        both = both.filter(F.size("_x") == F.size("_channels"))
    x = F.transform("_channels", lambda c: F.try_element_at("_x", c))
    return both.select(*by, "frame", (x if fill is None else F.transform(x, lambda v: F.coalesce(v, F.lit(fill)))).alias("x"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate(arrays).astype(float))


def _summed(parts: Iterator[tuple], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (by, _n, _s, _g) of the sums of parts (types, name, n, s, g). What is held is passed on before a new name, so
    parts that are sorted by name give one row each."""
    total: dict = {}
    held, types = 0, []

    def rows() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*total), types)] + [pa.array([v[0] for v in total.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [_lists([v[i] for v in total.values()]) for i in (1, 2)], names=[*by, "_n", "_s", "_g"])

    for types, name, n, s, g in parts:
        old = total.get(name)
        if old is not None:
            total[name] = (old[0] + n, old[1] + s, old[2] + g)
            continue
        if held > _HELD:
            yield rows()
            total, held = {}, 0
        total[name] = (n, s, g)
        held += len(s) + len(g)
    if total:
        yield rows()


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))[:-1])


def _by_group(batches: Iterator[pa.RecordBatch], by: list[str], weight: str | None) -> Iterator[tuple[list, tuple, np.ndarray, np.ndarray | None]]:
    """(types, name, x, weights) of the rows of each group of a batch."""
    for batch in batches:
        if batch.num_rows:
            codes = np.zeros(batch.num_rows, np.int64)
            for c in by:
                some = pa.compute.dictionary_encode(batch.column(c), null_encoding="encode")
                codes = np.unique(codes * len(some.dictionary) + some.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            rows = batch.take(pa.array(order))
            first = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
            names = zip(*(rows.column(c).take(pa.array(first)).to_pylist() for c in by))
            types = [batch.schema.field(c).type for c in by]
            flat = rows.column("x").flatten().to_numpy(zero_copy_only=False)
            at = np.append(0, np.cumsum(pa.compute.list_value_length(rows.column("x")).to_numpy(zero_copy_only=False)))
            w = rows.column(weight).to_numpy() if weight else None
            for name, a, b in zip(names, first, np.append(first[1:], len(order))):
                yield types, name, flat[at[a] : at[b]].reshape(b - a, -1), None if w is None else w[a:b]


def _schema(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def _add_up(df: DataFrame, by: list[str], kinds: str) -> DataFrame:
    """Sum the partial arrays of each group: first within groups of tasks, then overall. Tasks read their groups in order,
    many to a batch."""

    def fold(parts: DataFrame, by: list[str], kinds: str) -> DataFrame:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                if batch.num_rows:
                    types = [batch.schema.field(c).type for c in by]
                    yield from ((types, *row) for row in zip(zip(*(batch.column(c).to_pylist() for c in by)), batch.column("_n").to_pylist(), _arrays(batch.column("_s")), _arrays(batch.column("_g"))))

        return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: _summed(read(batches), by), f"{kinds}, {_SUMS}")

    parts = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(tree_fan(df.sparkSession))))
    some = fold(parts, [*by, "_part"], f"{kinds}, _part int")
    return fold(some.drop("_part"), by, kinds)


def gramians(df: DataFrame, by: list[str], weight: str | None = None, squares: bool = False) -> DataFrame:
    """(by, _n, _s, _g): number of frames, sum of x and sum of the outer products of x, flattened. A row stands for as many
    equal frames as its column `weight` says. `squares`: outer products of all x_i * x_j, i <= j, in place of those of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for types, name, x, w in _by_group(batches, by, weight):
                i, j = np.triu_indices(x.shape[1])
                q = x[:, i] * x[:, j] if squares else x
                if w is None:
                    yield types, name, len(x), x.sum(axis=0), (q.T @ q).ravel()
                else:
                    yield types, name, int(w.sum()), w @ x, ((q * w[:, None]).T @ q).ravel()

        yield from _summed(parts(), by)

    kinds = _schema(df, by)
    return _add_up(df.select(*by, "x", *([weight] if weight else [])).mapInArrow(run, f"{kinds}, {_SUMS}"), by, kinds)


def covariances(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, i, j, c): population covariance of each pair of positions, i <= j, counting from 0 (weight: see gramians)."""
    g = gramians(df, by, weight).withColumn("_p", F.size("_s"))
    each = g.select(*by, "_n", "_s", "_p", F.posexplode("_g").alias("_at", "_v"))
    i, j = F.floor(F.col("_at") / F.col("_p")).cast("int"), (F.col("_at") % F.col("_p")).cast("int")
    c = F.col("_v") / F.col("_n") - F.get("_s", F.col("i")) / F.col("_n") * F.get("_s", F.col("j")) / F.col("_n")
    return each.withColumn("i", i).withColumn("j", j).filter("i <= j").select(*by, "i", "j", c.alias("c"))


def principal_axes(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, variance, axis): eigenvalues in descending order and unit eigenvectors of the covariance (the largest
    entry of an axis is positive)."""
    return _axes_of(gramians(df, by), by)


def _axes_of(sums: DataFrame, by: list[str]) -> DataFrame:
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, variance, axes = pdf["_s"].map(len).to_numpy(), [], []
            for n, s, g in zip(pdf["_n"], pdf["_s"], pdf["_g"]):
                p, mean = len(s), np.array(s) / n
                values, vectors = np.linalg.eigh(np.array(g).reshape(p, p) / n - np.outer(mean, mean))
                vectors = vectors[:, ::-1].T
                sign = np.sign(vectors[np.arange(p), np.abs(vectors).argmax(axis=1)])
                variance.append(np.maximum(values[::-1], 0))
                axes += list(vectors * sign[:, None])
            if axes:
                rows = pdf[by].loc[pdf.index.repeat(sizes)].reset_index(drop=True)
                yield rows.assign(i=np.concatenate([np.arange(p) for p in sizes]), variance=np.concatenate(variance), axis=axes)

    return sums.mapInPandas(solve, f"{_schema(sums, by)}, i int, variance double, axis array<double>")


def whitening(df: DataFrame, by: list[str], components: int | DataFrame, axes: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(by, m, mean), written: the matrix and the mean with which frames are whitened (see whiten)."""
    sums = gramians(df, by, weight)
    if axes is None:
        sums = write_through(sums)
        axes = _axes_of(sums, by)
    axes = _first_axes(axes, by, components)
    basis = axes.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("variance") > 1e-12, 1 / F.sqrt("variance")).otherwise(0.0).alias("w"), "axis"))), lambda s: F.transform(s["axis"], lambda a: a * s["w"])).alias("m"))
    mean = sums.select(*by, F.transform("_s", lambda v: v / F.col("_n")).alias("mean"))
    return write_through(basis.join(mean, by))


def whiten(df: DataFrame, by: list[str], components: int | DataFrame, axes: DataFrame | None = None) -> DataFrame:
    """Frames centred and projected onto the first principal axes, each with variance 1 (axes without variance give 0).
    `components` is their number, or a table (by, components)."""
    return project(df, whitening(df, by, components, axes), by)


def _first_axes(axes: DataFrame, by: list[str], components: int | DataFrame) -> DataFrame:
    if isinstance(components, int):
        return axes.filter(F.col("i") < components)
    return axes.join(components.select(*by, F.col("components").alias("_k")), by).filter(F.col("i") < F.col("_k")).drop("_k")


def project(df: DataFrame, models: DataFrame, by: list[str], *keep: str) -> DataFrame:
    """(by, keep, x) with x := m (x - mean), one model (by, m, mean) per group; `keep` are columns of either table."""
    centred = F.zip_with("x", "mean", lambda a, b: a - b)
    dot = lambda row: F.aggregate(F.zip_with(row, "_c", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    joined = df.join(models, by).withColumn("_c", centred)
    return joined.select(*by, *(keep or ("frame",)), F.transform("m", dot).alias("x"))


def _start(p: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(p, p)))[0]


def _turns(moments: np.ndarray, start: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (group, p, p) after the rounds of fast_ica, and their last change, from the fourth moments of whitened
    frames (group, p, p, p, p)."""
    w, change, live = np.repeat(start[None], len(moments), axis=0), np.ones(len(moments)), np.arange(len(moments))
    for _ in range(rounds):
        m, old = moments[live], w[live]
        y = np.einsum("gabcd,gid->gabci", m, old)
        y = np.einsum("gabci,gic->gabi", y, old)
        u, _, v = np.linalg.svd(np.einsum("gabi,gib->gia", y, old) - 3 * old)
        w[live] = u @ v
        change[live] = np.max(1 - np.abs(np.sum(w[live] * old, axis=2)), axis=1)
        live = live[change[live] > tolerance]
        if not len(live):
            break
    return w, change


def _by_moments(z: DataFrame, by: list[str], rounds: int, tolerance: float, seed: int, weight: str | None) -> DataFrame:
    """(by, w, change) from one pass over whitened frames, as a round needs no more than their fourth moments."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["_s"].map(len).to_numpy()
            for p in np.unique(sizes):
                mine, most = pdf[sizes == p], max(1, _HELD // p**4)
                i, j = np.triu_indices(p)
                at = np.zeros((p, p), int)
                at[i, j] = at[j, i] = np.arange(len(i))
                for a in range(0, len(mine), most):
                    part = mine.iloc[a : a + most]
                    t = np.stack(part["_g"]).reshape(-1, len(i), len(i)) / part["_n"].to_numpy()[:, None, None]
                    w, change = _turns(t[:, at.ravel()][:, :, at.ravel()].reshape(-1, p, p, p, p), _start(p, seed), rounds, tolerance)
                    yield part[by].assign(w=list(w.reshape(len(w), -1)), change=change)

    return gramians(z, by, weight, squares=True).mapInPandas(solve, f"{_schema(z, by)}, w array<double>, change double")


def _by_passes(z: DataFrame, by: list[str], rounds: int, tolerance: float, seed: int, weight: str | None) -> DataFrame:
    """(by, w, change) from a pass over the whitened frames of the groups that still change in each round. Runs a job for
    each round."""
    z = write_through(z)
    kinds = _schema(z, by)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[by].assign(w=[_start(p, seed).ravel() for p in pdf["p"]], change=1.0)

    sizes = z.groupBy(*by).agg(F.first(F.size("x")).alias("p"))
    active = write_through(sizes.mapInPandas(begin, f"{kinds}, w array<double>, change double"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                rows, types = batch.to_pandas(), [batch.schema.field(c).type for c in by]
                for name, part in rows.groupby(by, dropna=False):
                    x = np.stack(part["x"])
                    n = part[weight].to_numpy() if weight else np.ones(len(x), int)
                    w = np.array(part["w"].iloc[0]).reshape(x.shape[1], x.shape[1])
                    g = ((x @ w.T) ** 3 * n[:, None]).T @ x
                    yield types, name if isinstance(name, tuple) else (name,), int(n.sum()), w.ravel() * n.sum(), g.ravel()

        yield from _summed(parts(), by)

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        p = int(round(len(r["_s"]) ** 0.5))
        old = np.array(r["_s"]).reshape(p, p) / r["_n"]
        new = np.array(r["_g"]).reshape(p, p) / r["_n"] - 3 * old
        u, _, v = np.linalg.svd(new)
        new = u @ v
        change = float(np.max(1 - np.abs(np.sum(new * old, axis=1))))
        return pd.DataFrame({**{c: [r[c]] for c in by}, "w": [new.ravel()], "change": [change]})

    settled = []
    for _ in range(rounds):
        sums = z.join(active.drop("change"), by).select(*by, "x", "w", *([weight] if weight else [])).mapInArrow(step, f"{kinds}, {_SUMS}")
        turned = write_through(_add_up(sums, by, kinds).groupBy(*by).applyInPandas(turn, f"{kinds}, w array<double>, change double"))
        settled.append(turned.filter(F.col("change") <= tolerance))
        active = turned.filter(F.col("change") > tolerance)
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, settled).unionByName(active)


def ica_model(
    df: DataFrame, by: list[str], components: int | DataFrame, rounds: int = 200, tolerance: float = 1e-4, seed: int = 0, axes: DataFrame | None = None, weight: str | None = None
) -> DataFrame:
    """(by, m, mean, w, change, converged), written: of each group the model with which `project` turns frames into their
    sources (see fast_ica); a row of `df` stands for as many equal frames as its column `weight` says."""
    base = whitening(df, by, components, axes, weight)
    keep = [weight] if weight else []
    few = base.filter(F.size("m") <= MOMENTS)
    turned = _by_moments(project(df, few, by, *(keep or by)).select(*by, "x", *keep), by, rounds, tolerance, seed, weight)
    if not (isinstance(components, int) and components <= MOMENTS):
        many = base.filter(F.size("m") > MOMENTS)
        if not many.isEmpty():
            turned = turned.unionByName(_by_passes(project(df, many, by, *(keep or by)).select(*by, "x", *keep), by, rounds, tolerance, seed, weight))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(m=[[list(r) for r in np.array(w).reshape(len(m), -1) @ np.stack(m)] for w, m in zip(pdf["w"], pdf["m"])])

    both = base.join(turned, by).withColumn("converged", F.col("change") <= tolerance)
    return write_through(both.mapInPandas(combine, both.schema))


def fast_ica(
    df: DataFrame, by: list[str], components: int | DataFrame, rounds: int = 200, tolerance: float = 1e-4, seed: int = 0, axes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(sources, unmixing): symmetric FastICA with the cubic nonlinearity on whitened frames. `components` is a number, or a
    table (by, components); `axes` are the principal axes, if they are known already.

    Every round needs the mean of x * (w x)**3 per group. With at most MOMENTS components that follows from the fourth
    moments of the group's whitened frames, which one pass sums, so the rounds run on small tables; with more, every
    round is a pass over the frames of the groups that still change. The square results of a group are made orthogonal
    and go into the next round. A group is done when no row of its matrix turns by more than `tolerance` (1 - |cosine|).
    unmixing has (by, w, change, converged): groups that haven't settled after `rounds` rounds, such as those without
    sources, aren't converged. Sources are defined up to order and sign. Runs jobs while it is called.
    """
    model = ica_model(df, by, components, rounds, tolerance, seed, axes)
    return project(df, model.select(*by, "m", "mean"), by), model.select(*by, "w", "change", "converged")


def mixing(axes: DataFrame, model: DataFrame, by: list[str], components: int | DataFrame) -> DataFrame:
    """(by, comp, at, weight): how much of each source stands in each position of the frames (counting from 0): the axes, with
    their spread, turned by the unmixing matrix of fast_ica. Small matrices of a group."""
    kinds = _schema(model, by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        w = np.array(pdf["w"].iloc[0]).reshape(len(pdf), len(pdf))
        a = w @ (np.stack(pdf["axis"]) * np.sqrt(np.maximum(pdf["variance"].to_numpy(), 0))[:, None])
        k, p = a.shape
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * (k * p) for c in by}, "comp": np.repeat(np.arange(k), p), "at": np.tile(np.arange(p), k), "weight": a.ravel()})

    return _first_axes(axes, by, components).join(model.select(*by, "w"), by).groupBy(*by).applyInPandas(solve, f"{kinds}, comp int, at int, weight double")


def optimal_filters(df: DataFrame, by: list[str], templates: DataFrame) -> DataFrame:
    """(by, unit, f): f = inv(R) t / (t' inv(R) t) with R the second moments of a group's frames and t the template
    (by, unit, t array<double>); a singular R is solved by least squares."""
    kinds = _schema(df, by)
    unit = templates.schema["unit"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        p = len(r["_s"])
        inverse = np.linalg.pinv(np.array(r["_g"]).reshape(p, p) / r["_n"], hermitian=True)
        t = np.stack(pdf["t"])
        f = t @ inverse
        f /= np.sum(f * t, axis=1)[:, None]
        return pd.DataFrame({**{c: [r[c]] * len(pdf) for c in by}, "unit": pdf["unit"], "f": list(f)})

    return gramians(df, by).join(templates, by).groupBy(*by).applyInPandas(solve, f"{kinds}, unit {unit}, f array<double>")


def wiener_weights(correlations: DataFrame, by: list[str]) -> DataFrame:
    """(by, w): filter of least squares from input autocorrelations and cross-correlations (by, lag, auto, cross):
    a Toeplitz system of order + 1 equations per group."""
    kinds = _schema(correlations, by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        k = np.arange(len(pdf))
        r = pdf["auto"].to_numpy()[np.abs(k[:, None] - k)]
        w = np.linalg.lstsq(r, pdf["cross"].to_numpy(), rcond=None)[0]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "w": [w]})

    return correlations.groupBy(*by).applyInPandas(solve, f"{kinds}, w array<double>")


def crosstalk(traces: DataFrame, pairs: DataFrame, order: int) -> DataFrame:
    """(a, b, ratio): of each pair of channels the larger share of one's variance that a causal filter of the other
    explains. `traces` has channel, frame, v; `pairs` has a < b, already limited to near channels."""
    from arrayloom.functions.signal import cross_correlation, with_halo

    p = pairs.select("a", "b")
    ways = p.select("a", "b", F.col("a").alias("ref"), F.col("b").alias("other")).unionByName(p.select("a", "b", F.col("b").alias("ref"), F.col("a").alias("other")))
    x = traces.select(F.col("channel").alias("other"), "frame", F.col("v").alias("x"))
    y = traces.select(F.col("channel").alias("ref"), "frame", F.col("v").alias("y"))
    by = ["a", "b", "ref"]
    both = write_through(ways.join(x, "other").join(y, ["ref", "frame"]).select(*by, "frame", "x", "y"))
    auto = cross_correlation(both.withColumn("x2", F.col("x")), by, order, "x", "x2").withColumnRenamed("r", "auto")
    cross = cross_correlation(both, by, order, "y", "x").withColumnRenamed("r", "cross")
    w = write_through(wiener_weights(auto.join(cross, [*by, "lag"]), by))
    line = Window.partitionBy(*by, "chunk").orderBy("frame")
    near = with_halo(both.join(w, by), "frame", order, 0)
    fit = sum((F.get("w", F.lit(k)) * F.coalesce(F.lag("x", k).over(line), F.lit(0.0)) for k in range(order + 1)), F.lit(0.0))
    fitted = near.withColumn("e", fit).filter("core")
    ratios = fitted.groupBy(*by).agg(F.try_divide(F.var_samp("e"), F.var_samp("y")).alias("r"))
    return ratios.groupBy("a", "b").agg(F.max("r").alias("ratio"))


def filtered_sources(df: DataFrame, filters: DataFrame, by: list[str]) -> DataFrame:
    """(by, unit, frame, v): each frame through each filter (by, unit, f) of its group, turned so that peaks point down."""
    both = df.join(filters.select(*by, "unit", "f"), by)
    dot = F.aggregate(F.zip_with("f", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return both.select(*by, "unit", "frame", (-dot).alias("v"))
