"""Batch correction of an embedding: soft clustering with a diversity penalty, then a ridge removal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import chunk_count, cogrouped, cut_lineage, into_chunks

CHUNK_ROWS = 4096
LANES = 64
MODEL = 1 << 22          # numbers in a model that tasks are sent whole (32 MB); a larger one travels as rows beside chunks of cells


def harmony(embedding: DataFrame, batches: Sequence[str], lam: float = 1.0, theta: float = 2.0,
            sigma: float = 0.1, n_clusters: int | None = None, max_rounds: int = 10, cluster_rounds: int = 3,
            tolerance: float = 1e-4, dims: int | None = None, key: Sequence[str] = ("sample", "cell_id"),
            vec: str = "vec", trace: list | None = None, centres: Sequence[Sequence[float]] | None = None,
            model_size: int = MODEL) -> DataFrame:
    """Corrected coordinates ``(key..., batches..., vec)``; one or more batch columns. A missing batch is a batch of its own.

    The model has a centre per cluster, and a penalty and a correction per cluster and batch combination. Up to ``model_size``
    numbers it goes to the tasks whole, which read the cells where they lie; a larger one stays a table, whose rows of one
    combination meet chunks of its cells. Only sums per (combination, cluster) leave a task. ``trace`` collects the
    objective of every round: distances, entropy and diversity. ``centres`` gives the start, else it is the first cells by hash.
    """
    key, batches = list(key), list(batches)
    ids = list(dict.fromkeys([*key, *batches]))
    coordinates = F.col(vec) if dims is None else F.slice(vec, 1, dims)
    cells = cut_lineage(embedding.select(*ids, coordinates.alias("_z0")))
    sizes = cut_lineage(cells.groupBy(*batches).agg(F.count(F.lit(1)).alias("_n")))
    total, combinations = sizes.agg(F.sum("_n"), F.count(F.lit(1))).first()
    if combinations < 2:
        return cells.select(*ids, F.col("_z0").alias("vec"))
    k = n_clusters or max(1, min(100, round(total / 30)))
    start = _unit(np.array(_first_cells(cells, key, k, total) if centres is None else centres, float))
    correct = _with_model if combinations * start.size <= model_size else _with_chunks
    return correct(cells, sizes, batches, key, ids, start, lam, theta, sigma, max_rounds, cluster_rounds, tolerance, trace)


def _first_cells(cells: DataFrame, key: Sequence[str], k: int, total: int) -> list:
    """The first ``k`` vectors in hash order (k is at most a few hundred), found below a bound on the hash."""
    mark, wanted = F.xxhash64(*key), 4 * k + 40
    while True:
        bound = (1 << 63) - 1 if wanted >= total else (wanted << 64) // total - (1 << 63)
        found = cells.filter(mark <= bound).select(mark.alias("_h"), *key, "_z0").collect()
        if len(found) >= min(k, total):
            return [r["_z0"] for r in sorted(found, key=lambda r: (r["_h"], str(tuple(r[c] for c in key))))[:k]]
        wanted *= 4


def _with_model(cells, sizes, batches, key, ids, start, lam, theta, sigma, max_rounds, cluster_rounds, tolerance, trace):
    """Rounds with the model in the tasks: a pass over the cells and its sums for every clustering round, one table a round."""
    rows = sorted(sizes.collect(), key=lambda r: str(tuple(r)))          # no more than the model has
    n = np.array([r["_n"] for r in rows], float)
    codes = [pd.factorize(np.array([r[b] for r in rows], object), use_na_sentinel=False)[0] for b in batches]
    kinds = ", ".join(f"_k{i} {cells.schema[b].dataType.simpleString()}" for i, b in enumerate(batches))
    numbers = cells.sparkSession.createDataFrame([(i, *[r[b] for b in batches]) for i, r in enumerate(rows)], f"_b int, {kinds}")
    same = [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(batches)]
    cells = cut_lineage(cells.join(F.broadcast(numbers), same).select(*ids, "_z0", F.col("_z0").alias("_z"), "_b"))
    y, w, before = start, np.ones((len(rows), len(start))), None
    for _ in range(max_rounds):
        for _ in range(cluster_rounds):
            used = y, w
            o, s, t, obj = _sums_in_tasks(cells, y, w, sigma)
            y, w, beta = _unit(s.sum(axis=0)), w.copy(), np.zeros_like(t)
            for j in range(len(y)):
                w[:, j], beta[:, j], apart = _cluster_step(o[:, j], t[:, j], n, n.sum(), w[:, j], codes, lam, theta)
                obj += sigma * theta * apart
        # the last sums belong to ``used``: its memberships with the corrections solved from them
        cells = cut_lineage(cells.mapInPandas(_mover(*used, beta, sigma), cells.schema))
        if trace is not None:
            trace.append(obj)
        if before is not None and abs(before - obj) < tolerance * abs(before):
            break
        before = obj
    return cells.select(*ids, F.col("_z").alias("vec"))


def _sums_in_tasks(cells, y, w, sigma):
    """Sums per (combination, cluster): weights, unit vectors, vectors; and distances with entropy over all."""
    (c, k), d = w.shape, y.shape[1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o, s, t, obj = np.zeros((c, k)), np.zeros((c, k, d)), np.zeros((c, k, d)), np.zeros((c, k))
        for part in parts:
            if part.empty:
                continue
            z, z0, b = np.stack(part["_z"].to_numpy()), np.stack(part["_z0"].to_numpy()), part["_b"].to_numpy()
            r, near = _memberships(z, y, w[b], sigma)
            cost, unit = r * near + sigma * r * np.log(np.maximum(r, 1e-300)), _unit(z)
            for i in np.unique(b):
                its = b == i
                o[i] += r[its].sum(axis=0)
                obj[i] += cost[its].sum(axis=0)
                s[i] += r[its].T @ unit[its]
                t[i] += r[its].T @ z0[its]
        for i in np.flatnonzero(o.any(axis=1)):
            yield pd.DataFrame({"_b": i, "k": np.arange(k), "o": o[i], "obj": obj[i], "s": list(s[i]), "t": list(t[i])})

    parts = cells.select("_b", "_z", "_z0").mapInPandas(run, "_b int, k int, o double, obj double, s array<double>, t array<double>")
    summed = parts.groupBy("_b", "k").agg(F.sum("o").alias("o"), F.sum("obj").alias("obj"), *[
        F.array(*[F.sum(F.col(v)[i]) for i in range(d)]).alias(v) for v in ("s", "t")])
    o, s, t, obj = np.zeros((c, k)), np.zeros((c, k, d)), np.zeros((c, k, d)), 0.0
    for r in sorted(summed.collect(), key=lambda r: (r["_b"], r.k)):
        o[r["_b"], r.k], s[r["_b"], r.k], t[r["_b"], r.k] = r.o, r.s, r.t
        obj += r.obj
    return o, s, t, obj


def _mover(y, w, beta, sigma):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if part.empty:
                continue
            b = part["_b"].to_numpy()
            z0, moved = np.stack(part["_z0"].to_numpy()), np.empty((len(b), y.shape[1]))
            r, _ = _memberships(np.stack(part["_z"].to_numpy()), y, w[b], sigma)
            for i in np.unique(b):
                moved[b == i] = z0[b == i] - r[b == i] @ beta[i]
            yield part.assign(_z=list(moved))
    return run


def _with_chunks(cells, sizes, batches, key, ids, start, lam, theta, sigma, max_rounds, cluster_rounds, tolerance, trace):
    """Rounds with the model as a table, for one too large to be sent to every task."""
    missing = [f"_m{i}" for i in range(len(batches))]                    # joins and cogroups go by value, so a missing batch needs one
    flags = [F.col(b).isNull().alias(m) for b, m in zip(batches, missing)]
    held = {b: F.coalesce(b, F.lit("").cast(cells.schema[b].dataType), F.lit(0).cast(cells.schema[b].dataType)).alias(b) for b in batches}
    cells = cells.select(*[held.get(c, F.col(c)) for c in cells.columns], *flags)
    sizes = sizes.select(*held.values(), "_n", *flags)
    names, ids, batches = batches, [*ids, *missing], [*batches, *missing]
    cells = cut_lineage(into_chunks(cells, batches, sizes, key, CHUNK_ROWS).withColumn("_z", F.col("_z0")))
    spread = cut_lineage(sizes.withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunk_count(CHUNK_ROWS) - 1))))
    every = F.array(*[F.struct(F.lit(i).alias("k"), F.array(*[F.lit(float(x)) for x in c]).alias("y"))
                      for i, c in enumerate(start)])
    model = sizes.select(*batches, F.explode(every).alias("_m")).select(
        *batches, "_m.k", "_m.y", F.lit(1.0).alias("w"), F.array().cast("array<double>").alias("beta"))
    types = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in batches)
    large = sizes.agg(F.max("_n")).first()[0] > CHUNK_ROWS * LANES
    model, before = cut_lineage(model), None
    for _ in range(max_rounds):
        used = None
        for _ in range(cluster_rounds):
            used = model
            sums = _cluster_sums(cells, used, spread, batches, sigma, types, large)
            model = cut_lineage(_update(sums, used, sizes, batches, names, lam, theta, sigma, types))
        fixed = used.drop("beta").join(model.select(*batches, "k", "beta"), [*batches, "k"])
        cells = cut_lineage(_correct(cells, fixed, spread, batches, sigma, ids))
        objective = model.agg(F.sum("obj")).first()[0]
        if trace is not None:
            trace.append(objective)
        if before is not None and abs(before - objective) < tolerance * abs(before):
            break
        before = objective
    back = [F.when(~F.col(f"_m{names.index(c)}"), F.col(c)).alias(c) if c in names else F.col(c) for c in ids if c not in missing]
    return cells.select(*back, F.col("_z").alias("vec"))


def _cluster_step(o, t, n, everything, w, codes, lam, theta):
    """Penalties and corrections of one cluster from its sums per batch combination, and how far it is from diverse.

    All cells are reassigned at once, so the penalty moves only part of the way (in logs) to its new
    value each time; otherwise batches would swap clusters back and forth.
    """
    step, apart = 1.0 / (1.0 + theta), 0.0
    w = w ** (1 - step)
    for code in codes:
        seen, due = np.bincount(code, weights=o), o.sum() * np.bincount(code, weights=n) / everything
        w = w * ((due + 1) / (seen + 1))[code] ** (theta * step)
        apart += float(seen @ np.log((seen + 1) / (due + 1)))
    if len(codes) == 1:
        # intercept eliminated by hand: the system is an arrow matrix
        shrink = o / (o + lam)
        left = o.sum() - (o * shrink).sum()
        base = (t.sum(0) - (shrink[:, None] * t).sum(0)) / max(left, 1e-12)
        return w, (t - o[:, None] * base) / (o + lam)[:, None], apart
    design = np.concatenate([np.ones((len(o), 1)), *[np.eye(c.max() + 1)[c] for c in codes]], axis=1)
    ridge = np.diag([1e-12] + [lam] * (design.shape[1] - 1))
    solved = np.linalg.solve(design.T @ (design * o[:, None]) + ridge, design.T @ t)
    return w, design[:, 1:] @ solved[1:], apart


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def _memberships(z: np.ndarray, y: np.ndarray, w: np.ndarray, sigma: float):
    near = 2 * (1 - _unit(z) @ y.T)
    e = -near / sigma
    r = np.exp(e - e.max(axis=1, keepdims=True)) * w
    r /= r.sum(axis=1, keepdims=True)
    return r, near


def _beside(model, spread, batches):
    return model.join(spread.select(*batches, "_chunk"), batches)


def _cluster_sums(cells, model, spread, batches, sigma, types, large):
    """Sums per (combination, cluster, chunk); folded into at most ``LANES`` rows when chunks are many."""
    columns = [*batches, "k", "lane", "o", "s", "t", "obj"]

    def sums(key, part, m):
        if part.empty or m.empty:
            return pd.DataFrame(columns=columns)
        m = m.sort_values("k")
        z, z0 = np.stack(part["_z"].to_numpy()), np.stack(part["_z0"].to_numpy())
        r, near = _memberships(z, np.stack(m["y"].to_numpy()), m["w"].to_numpy(), sigma)
        obj = (r * near).sum(0) + sigma * (r * np.log(np.maximum(r, 1e-300))).sum(0)
        out = pd.DataFrame({"k": m["k"].to_numpy(), "lane": int(key[-1]) % LANES, "o": r.sum(0),
                            "s": list(r.T @ _unit(z)), "t": list(r.T @ z0), "obj": obj})
        for c, v in zip(batches, key):
            out[c] = v
        return out[columns]

    schema = f"{types}, k int, lane int, o double, s array<double>, t array<double>, obj double"
    parts = cogrouped(cells, _beside(model, spread, batches), [*batches, "_chunk"], sums, schema)

    if not large:
        return parts

    def add(part):
        return part.head(1).assign(o=part["o"].sum(), obj=part["obj"].sum(), s=[np.sum(np.stack(part["s"].to_numpy()), axis=0)],
                                   t=[np.sum(np.stack(part["t"].to_numpy()), axis=0)])

    return parts.groupBy(*batches, "k", "lane").applyInPandas(add, schema)


def _update(sums, used, sizes, batches, names, lam, theta, sigma, types):
    """Per cluster: new centre, penalty and ridge solution, from one row per batch combination and lane."""
    columns = [*batches, "k", "y", "w", "beta", "obj"]
    n_all = sizes.agg(F.sum("_n").alias("_all")).scalar()

    def solve(key, part):
        rows = part.groupby(batches, sort=True, as_index=False).agg(
            o=("o", "sum"), obj=("obj", "sum"), n=("_n", "first"), _w=("_w", "first"), everything=("_all", "first"),
            s=("s", lambda v: np.sum(np.stack(v.to_numpy()), axis=0)),
            t=("t", lambda v: np.sum(np.stack(v.to_numpy()), axis=0)))
        y = _unit(np.sum(np.stack(rows["s"].to_numpy()), axis=0)[None, :])[0]
        codes = [rows.groupby([b, f"_m{i}"], sort=True).ngroup().to_numpy() for i, b in enumerate(names)]
        w, beta, apart = _cluster_step(rows["o"].to_numpy(), np.stack(rows["t"].to_numpy()), rows["n"].to_numpy(), rows["everything"].iloc[0],
                                       rows["_w"].to_numpy(), codes, lam, theta)
        return rows[batches].assign(k=key[0], y=[y] * len(rows), w=w, beta=list(beta), obj=rows["obj"] + sigma * theta * apart / len(rows))[columns]

    last = used.select(*batches, "k", F.col("w").alias("_w"))
    sized = sums.join(sizes, batches).join(last, [*batches, "k"]).withColumn("_all", n_all)
    return sized.groupBy("k").applyInPandas(
        solve, f"{types}, k int, y array<double>, w double, beta array<double>, obj double")


def _correct(cells, model, spread, batches, sigma, ids):
    names = [*ids, "_z0", "_chunk", "_z"]

    def move(part, m):
        if part.empty or m.empty:
            return pd.DataFrame(columns=names)
        m = m.sort_values("k")
        r, _ = _memberships(np.stack(part["_z"].to_numpy()), np.stack(m["y"].to_numpy()), m["w"].to_numpy(), sigma)
        moved = np.stack(part["_z0"].to_numpy()) - r @ np.stack(m["beta"].to_numpy())
        return part.assign(_z=list(moved))[names]

    schema = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in names)
    return cogrouped(cells, _beside(model, spread, batches), [*batches, "_chunk"], move, schema)


def batch_gap(embedding: DataFrame, batch: str, vec: str = "vec") -> DataFrame:
    """Mean squared distance of the batch centroids from the overall one, a measure of remaining batch effect."""
    long = embedding.select(F.col(batch).alias("_b"), F.posexplode(vec).alias("_p", "_v"))
    per = long.groupBy("_b", "_p").agg(F.avg("_v").alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = per.groupBy("_p").agg((F.sum(F.col("_m") * F.col("_n")) / F.sum("_n")).alias("_all"))
    return per.join(whole, "_p").groupBy("_b").agg(
        F.sum((F.col("_m") - F.col("_all")) * (F.col("_m") - F.col("_all"))).alias("g")).agg(F.avg("g").alias("gap"))
