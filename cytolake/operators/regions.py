"""Copy-number summaries: genes placed in chromosome regions, region means, mixtures, profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import cut_lineage, salted_join
from ..schema import CELL_KEY


def gene_positions(values: DataFrame, genes: DataFrame) -> DataFrame:
    """Attach chromosome and position to every row; unplaced genes fall out."""
    return values.join(genes.select("gene", "chr", "pos"), "gene")


def genes_in_regions(genes: DataFrame, regions: DataFrame) -> DataFrame:
    """Genes whose position lies inside a region of their chromosome."""
    inside = (F.col("g.chr") == F.col("r.chr")) & F.col("g.pos").between(F.col("r.start"), F.col("r.end"))
    return genes.alias("g").join(regions.alias("r"), inside).select("g.gene", "g.chr", "g.pos", "r.region")


def region_means(values: DataFrame, factors: DataFrame, placed: DataFrame, min_genes: int = 1,
                 value: str = "v") -> DataFrame:
    """Mean over a region's genes of (expression - normalising factor), for every cell and region.

    The region list is a scalar subquery (one array of a few dozen names), exploded on the cells,
    so zero-only regions appear without joining cells with regions. A cell's sums meet it as one map of as many entries,
    so what is joined has a row per cell, not one per cell and region.
    """
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n_genes")).filter(
        F.col("n_genes") >= min_genes)
    listed = sizes.agg(F.collect_list(F.struct("region", "n_genes"))).scalar()
    sums = values.join(placed.select("gene", "region"), "gene").groupBy(*CELL_KEY, "region").agg(
        F.sum(value).alias("_s")).filter(F.col("region").isNotNull())
    held = sums.groupBy(*CELL_KEY).agg(F.map_from_entries(F.collect_list(F.struct("region", "_s"))).alias("_held"))
    grid = factors.join(held, CELL_KEY, "left").select(*CELL_KEY, "norm_factor", "_held", F.explode(listed).alias("_r"))
    found = F.coalesce(F.try_element_at("_held", F.col("_r.region")), F.lit(0.0))
    return grid.select(*CELL_KEY, "_r.region", (found / F.col("_r.n_genes") - F.col("norm_factor")).alias("x"))


def region_zscores(means: DataFrame) -> DataFrame:
    """z-score of each region over the cells. The means are written down, since they are read twice."""
    means = cut_lineage(means)
    stats = means.groupBy("region").agg(F.avg("x").alias("_m"), F.stddev_samp("x").alias("_s"))
    return means.join(stats, "region").withColumn(
        "x", F.coalesce(F.try_divide(F.col("x") - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def _log_density(x, mean, var):
    return -(x - mean) * (x - mean) / (2 * var) - F.ln(2 * F.lit(3.141592653589793) * var) / 2


REST = 1e-9                     # gain in log-likelihood a cell at which a region has come to rest
MODEL = ("p2", "m1", "m2", "v1", "v2")
BINS, FAR = 256, 2048           # bins a standard deviation, and the outermost one


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rounds on the histogram of one region until they rest: at most 2 FAR + 1 rows, whatever the number of cells."""
    one = pdf.iloc[0]
    c, t = pdf["_c"].to_numpy(float), pdf["_t"].to_numpy()
    n, floor = c.sum(), max(one.v1 * 1e-3, 1e-9)
    p2, m1, m2, v1, v2 = (float(one[k]) for k in MODEL)
    before = -np.inf
    while True:
        a = np.log(max(1 - p2, 1e-300)) - (t - m1) ** 2 / (2 * v1) - np.log(2 * np.pi * v1) / 2
        b = np.log(max(p2, 1e-300)) - (t - m2) ** 2 / (2 * v2) - np.log(2 * np.pi * v2) / 2
        like = float(c @ np.logaddexp(a, b))
        if not like - before > REST / 10 * n:
            break
        before = like
        r = c / (1 + np.exp(np.minimum(a - b, 700.0)))
        w2, w1, p2 = r.sum(), n - r.sum(), r.sum() / n
        if w1 > 1e-9:
            m1 = float((c - r) @ t) / w1
            v1 = max(float((c - r) @ (t - m1) ** 2) / w1, floor)
        if w2 > 1e-9:
            m2 = float(r @ t) / w2
            v2 = max(float(r @ (t - m2) ** 2) / w2, floor)
    return pd.DataFrame([[one.region, p2, m1, m2, v1, v2]], columns=["region", *MODEL])


def _near_rest(scores: DataFrame, params: DataFrame) -> DataFrame:
    """Put the parameters where the rounds rest on each region's histogram, which sums over all cells build."""
    at = (F.col("x") - F.col("m")) / F.sqrt(F.greatest(F.col("v1"), F.lit(1e-18))) * BINS
    held = salted_join(scores, params.select("region", "m", "v1"), ["region"], CELL_KEY).groupBy(
        "region", F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), at))).alias("_bin")).agg(
        F.count("x").alias("_c"), F.avg("x").alias("_t")).filter("_c > 0")
    found = held.join(params.select("region", *MODEL), "region").groupBy("region").applyInPandas(
        _settled, params.select("region", *MODEL).schema)
    return cut_lineage(params.drop(*MODEL).join(found, "region"))


def region_mixture(scores: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One versus two Gaussians per region over the cells, all regions in each aggregation.

    Returns ``models(region, ..., delta_bic, ll_path)`` and the posterior of the upper component per cell.
    The quartiles are the start. Rounds run first on one histogram per region (fixed number of bins, built from all cells), then on
    the cells until a region's likelihood grows by no more than ``REST`` a cell; only regions that still move take part. So the
    cells are read a few times, not once for each of hundreds of rounds. ``rounds`` asks instead for that many plain
    rounds on the cells. Parameters have a row per region and meet the cells in a salted join, which Spark broadcasts if small.
    A missing score takes no part in the fit and has no posterior.
    """
    x = F.col("x")
    scores = cut_lineage(scores.select(*CELL_KEY, "region", "x").filter(x.isNotNull()))
    start = scores.groupBy("region").agg(
        F.count(x).cast("double").alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"),
        F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.75)), 10000).alias("q"))
    floor = F.greatest(F.col("v") * 1e-3, F.lit(1e-9))
    params = cut_lineage(start.select(
        "region", "n", "m", "v", F.lit(0.5).alias("p2"), F.col("q")[0].alias("m1"), F.col("q")[1].alias("m2"),
        F.greatest(F.col("v"), floor).alias("v1"), F.greatest(F.col("v"), floor).alias("v2"),
        F.lit(None).cast("double").alias("ll"), F.array().cast("array<double>").alias("ll_path")))

    def expected(p):
        joined = salted_join(scores, p.select("region", *MODEL), ["region"], CELL_KEY)
        tiny = F.lit(1e-300)
        logs = joined.withColumns({        # in logs, so that a cell far from both still leans to the nearer one
            "_a": F.ln(F.greatest(1 - F.col("p2"), tiny)) + _log_density(x, F.col("m1"), F.col("v1")),
            "_b": F.ln(F.greatest(F.col("p2"), tiny)) + _log_density(x, F.col("m2"), F.col("v2"))})
        gap = F.col("_a") - F.col("_b")
        return logs.withColumns({"r": 1 / (1 + F.exp(F.least(gap, F.lit(700.0)))),
                                 "_l": F.greatest("_a", "_b") + F.log1p(F.exp(-F.abs(gap)))})

    def step(p):
        r = F.col("r")
        sums = expected(p).groupBy("region").agg(
            F.sum(r).alias("w2"), F.sum(r * x).alias("s2"), F.sum(r * x * x).alias("q2"),
            F.sum(1 - r).alias("w1"), F.sum((1 - r) * x).alias("s1"), F.sum((1 - r) * x * x).alias("q1"),
            F.sum("_l").alias("_ll"))
        keep = p.select("region", "n", "m", "v", "m1", "m2", "v1", "v2", "ll_path")

        def mean(w, s, old):
            return F.when(F.col(w) > 1e-9, F.col(s) / F.col(w)).otherwise(F.col(old))

        def var(w, s, q, old):
            v = F.col(q) / F.col(w) - (F.col(s) / F.col(w)) * (F.col(s) / F.col(w))
            return F.when(F.col(w) > 1e-9, F.greatest(v, floor)).otherwise(F.col(old))

        return cut_lineage(keep.join(sums, "region").select(
            "region", "n", "m", "v", (F.col("w2") / F.col("n")).alias("p2"),
            mean("w1", "s1", "m1").alias("m1"), mean("w2", "s2", "m2").alias("m2"),
            var("w1", "s1", "q1", "v1").alias("v1"), var("w2", "s2", "q2", "v2").alias("v2"),
            F.col("_ll").alias("ll"), F.concat("ll_path", F.array("_ll")).alias("ll_path")))

    if rounds is None:
        moving, resting = _near_rest(scores, params), None
        while not moving.isEmpty():          # ends: the likelihood is bounded, and who stays has gained REST a cell
            moving = step(moving)
            earlier = F.try_element_at("ll_path", F.lit(-2))
            stays = F.coalesce(earlier.isNull() | (F.col("ll") - earlier > REST * F.col("n")), F.lit(False))
            done = moving.filter(~stays)
            resting = done if resting is None else resting.unionByName(done)
            moving = moving.filter(stays)
        params = params if resting is None else cut_lineage(resting)
    else:
        for _ in range(rounds):
            params = step(params)

    upper = F.col("m2") >= F.col("m1")
    posteriors = expected(params).select(
        *CELL_KEY, "region", F.when(upper, F.col("r")).otherwise(1 - F.col("r")).alias("posterior"))
    ml_var = F.greatest(F.col("v") * (F.col("n") - 1) / F.col("n"), F.lit(1e-12))
    one = -0.5 * F.col("n") * (F.ln(2 * F.lit(3.141592653589793) * ml_var) + 1)
    bic1 = -2 * one + 2 * F.ln("n")
    bic2 = -2 * F.col("ll") + 5 * F.ln("n")
    models = params.select("region", "n", "p2", "m1", "m2", "v1", "v2", "ll_path",
                           (bic1 - bic2).alias("delta_bic"))
    return models, posteriors


def profile_scores(posteriors: DataFrame, regions: Sequence[str], limit: float = 4.0) -> DataFrame:
    """Posteriors z-scored per region and clipped at +-``limit``, one column per listed region."""
    kept = posteriors.filter(F.col("region").isin(list(regions)))
    stats = kept.groupBy("region").agg(F.avg("posterior").alias("_m"), F.stddev_samp("posterior").alias("_s"))
    z = F.coalesce(F.try_divide(F.col("posterior") - F.col("_m"), F.col("_s")), F.lit(0.0))
    clipped = kept.join(stats, "region").withColumn(
        "_z", F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))
    return (clipped.groupBy(*CELL_KEY).pivot("region", list(regions)).agg(F.first("_z"))
            .na.fill(0.0, list(regions)))


LEAVES = 2048                   # cluster features that are merged pair by pair
DEPTH = 12                      # the finest grid has 2 ** DEPTH cells across the range of the scores


def cluster_features(rows: DataFrame, leaves: int = LEAVES) -> tuple[DataFrame, Column]:
    """At most ``leaves`` features ``(_leaf, n, centre)`` of the vectors ``_v``, and the column that names a row's leaf.

    The leaves are the different vectors where these are few enough, else the cells of the finest grid that has few enough filled ones;
    grids halve from one to the next. Sums make the features, so tasks and partitions merge in any order, and how many
    rows share a leaf does not matter.
    """
    lo, hi = rows.agg(F.min(F.array_min("_v")), F.max(F.array_max("_v"))).first()
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    width = (hi - lo) / 2 ** DEPTH or 1.0
    dims = rows.select(F.max(F.size("_v"))).first()[0] or 0

    def place(x: Column) -> Column:
        return F.least(F.floor((x - lo) / width), F.lit(2 ** DEPTH - 1)).cast("bigint")

    def grid(by: int) -> Column:
        return F.transform("_v", lambda x: F.shiftright(place(x), by))

    keys = [F.col("_v"), *map(grid, range(DEPTH + 1))]
    placed = rows.select("_v", *[place(F.col("_v")[i]).alias(f"p{i}") for i in range(dims)])      # a place is found once for all grids
    hashes = [F.xxhash64("_v"), *[F.xxhash64(*[F.shiftright(f"p{i}", by) for i in range(dims)] or [F.lit(0)]) for by in range(DEPTH + 1)]]
    about = placed.agg(*[F.approx_count_distinct(h, 0.02).alias(f"c{i}") for i, h in enumerate(hashes)]).first()
    centre = F.array(*[F.avg(F.col("_v")[i]) for i in range(dims)]).alias("centre")
    for key, n in zip(keys, about):              # ends: the last grid has one cell
        if n <= 2 * leaves:
            features = cut_lineage(rows.groupBy(key.alias("_leaf")).agg(F.count(F.lit(1)).alias("n"), centre))
            if features.count() <= leaves:
                break
    return features, key


def _linked(centres: np.ndarray, k: int) -> np.ndarray:
    """Complete-linkage cut into ``k`` clusters, each named by its first row.

    In a round all pairs that are each other's nearest (ties to the first) merge, which builds the same tree as
    one merge after another; the ``k`` - 1 highest merges are then left out.
    """
    d = np.sqrt(sum((c[:, None] - c[None, :]) ** 2 for c in centres.T)).round(9)
    np.fill_diagonal(d, np.inf)
    alive, merges, turn = np.arange(len(centres)), [], 0
    while len(alive) > 1:
        near, at = d.argmin(axis=1), np.arange(len(alive))
        low = np.flatnonzero((near[near] == at) & (at < near))
        high = near[low]
        merges += [(h, turn, a, b) for h, a, b in zip(d[low, high], alive[low], alive[high])]
        d[low] = np.maximum(d[low], d[high])
        d[:, low] = np.maximum(d[:, low], d[:, high])
        kept = np.delete(at, high)
        d, alive, turn = d[np.ix_(kept, kept)], alive[kept], turn + 1
    name = np.arange(len(centres))
    for _, _, a, b in sorted(merges)[:max(0, len(centres) - k)]:
        name[name == name[b]] = min(name[a], name[b])
    return name


def profile_clusters(profiles: DataFrame, regions: Sequence[str], k: int = 4, leaves: int = LEAVES) -> DataFrame:
    """Hierarchical cut (complete linkage, Euclidean) of the profiles into ``k`` clusters, numbered from 1 by rising mean
    absolute score, so cluster 1 is the flattest profile.

    All cells build the cluster features; only these, ``leaves`` at most, go into one task for merging. With no more different
    profiles than that the cut is that of the cells themselves. A missing score counts as 0; fewer different profiles than ``k``
    give as many clusters.
    """
    values = F.array(*[F.coalesce(F.col(f"`{r}`").cast("double"), F.lit(0.0)) + 0.0 for r in regions])
    rows = cut_lineage(profiles.select(*CELL_KEY, values.alias("_v")))
    features, leaf = cluster_features(rows, leaves)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: tuple(pdf["centre"].iloc[i]))]
        return pdf[["_leaf"]].assign(_c=_linked(np.stack(pdf["centre"].to_numpy()), k))

    kind = features.schema["_leaf"].dataType.simpleString()
    named = features.groupBy().applyInPandas(merge, f"_leaf {kind}, _c bigint")
    found = cut_lineage(rows.withColumn("_leaf", leaf).join(F.broadcast(named), "_leaf").select(*CELL_KEY, "_v", "_c"))
    size = F.aggregate("_v", F.lit(0.0), lambda t, x: t + F.abs(x))
    order = found.groupBy("_c").agg(F.avg(size).alias("_s"))
    ranked = order.select("_c", F.row_number().over(W.orderBy("_s", "_c")).alias("profile"))
    return found.join(F.broadcast(ranked), "_c").select(*CELL_KEY, "profile")


def malignant_call(profiles: DataFrame, normal: int = 1) -> DataFrame:
    """``normal`` for the flat profile, ``tumor`` for every other."""
    return profiles.withColumn(
        "cand_tumor", F.when(F.col("profile") == normal, "normal").otherwise("tumor"))
