"""Normalisation, variable features and scaling on the sparse long form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import sparse_mean, sparse_variance
from ..runtime import cut_lineage, running_total, salted_join
from ..schema import CELL_KEY


def log_normalize(counts: DataFrame, totals: DataFrame | None = None, scale: float = 1e4,
                  base: float | None = None, name: str = "v") -> DataFrame:
    """``ln(1 + cnt / total * scale)``; zeros stay absent.

    Totals are those of the rows given, summed over each cell's window in the one shuffle by cell (a
    cell has at most one row per feature), or ``n_count`` of the cell table ``totals``.
    """
    if totals is None:
        summed = counts.withColumn("n_count", F.sum("cnt").over(W.partitionBy(*CELL_KEY)))
    else:
        summed = counts.join(totals.select(*CELL_KEY, "n_count"), CELL_KEY)
    v = F.ln(F.lit(1.0) + F.try_divide(F.col("cnt"), F.col("n_count")) * F.lit(float(scale)))
    if base is not None:
        v = v / F.lit(float(np.log(base)))
    return summed.withColumn(name, v).drop("n_count")


def to_log2(values: DataFrame, value: str = "v", name: str = "v2") -> DataFrame:
    """Natural-log expression to base two: ``log2(exp(v) - 1 + 1)``."""
    return values.withColumn(name, F.log2(F.exp(F.col(value)) - F.lit(1.0) + F.lit(1.0)))


def normalizing_factor(values: DataFrame, genes: DataFrame, value: str = "v") -> DataFrame:
    """Mean expression per cell over all rows of ``genes``, zeros included."""
    n_genes = genes.agg(F.count(F.lit(1))).scalar()
    return (values.groupBy(*CELL_KEY).agg(F.sum(value).alias("_s"))
            .select(*CELL_KEY, F.try_divide(F.col("_s"), n_genes).alias("norm_factor")))


def gene_moments(values: DataFrame, cells: DataFrame, by: Sequence[str] = ("sample",),
                 value: str = "cnt") -> DataFrame:
    """Mean and variance per gene over every cell of the group, absent rows counted as zeros."""
    by = list(by)
    n = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    v = F.col(value).cast("double")
    sums = values.groupBy(*by, "gene").agg(
        F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.count_if(v != 0).alias("nnz"))
    return salted_join(sums, n, by, ["gene"]).select(
        *by, "gene", "n", "nnz", sparse_mean(F.col("s1"), F.col("n")).alias("mu"),
        sparse_variance(F.col("s1"), F.col("s2"), F.col("n")).alias("var"))


def quadratic_trend(moments: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Least squares of log10 variance on 1, x, x^2 (x = centred log10 mean), by Cramer's rule.

    Only sums of powers leave the gene table, so the fit is two aggregations for all samples at once.
    Adds ``sd_fit``; genes without variance are left out.
    """
    by = list(by)
    usable = (moments.filter((F.col("mu") > 0) & (F.col("var") > 0))
              .withColumn("lx", F.log10("mu")).withColumn("ly", F.log10("var")))
    centre = usable.groupBy(*by).agg(F.avg("lx").alias("cx"))
    usable = (salted_join(usable, centre, by, ["gene"]).withColumn("x", F.col("lx") - F.col("cx"))
              .drop("lx", "cx"))
    x, y = F.col("x"), F.col("ly")
    sums = usable.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("a0"), F.sum(x).alias("a1"), F.sum(x * x).alias("a2"),
        F.sum(x * x * x).alias("a3"), F.sum(x * x * x * x).alias("a4"),
        F.sum(y).alias("b0"), F.sum(x * y).alias("b1"), F.sum(x * x * y).alias("b2"))
    solved = sums.selectExpr(
        *by,
        "a0*(a2*a4-a3*a3) - a1*(a1*a4-a2*a3) + a2*(a1*a3-a2*a2) AS det",
        "b0*(a2*a4-a3*a3) - a1*(b1*a4-a3*b2) + a2*(b1*a3-a2*b2) AS d0",
        "a0*(b1*a4-a3*b2) - b0*(a1*a4-a2*a3) + a2*(a1*b2-b1*a2) AS d1",
        "a0*(a2*b2-b1*a3) - a1*(a1*b2-b1*a2) + b0*(a1*a3-a2*a2) AS d2",
    ).selectExpr(*by, "try_divide(d0,det) AS c0", "try_divide(d1,det) AS c1", "try_divide(d2,det) AS c2")
    fit = F.col("c0") + F.col("c1") * x + F.col("c2") * x * x
    return (salted_join(usable, solved, by, ["gene"])
            .withColumn("sd_fit", F.sqrt(F.pow(F.lit(10.0), fit)))
            .drop("c0", "c1", "c2", "x", "ly"))


def loess_trend(moments: DataFrame, by: Sequence[str] = ("sample",), span: float = 0.3) -> DataFrame:
    """Local quadratic fit of log10 variance on log10 mean with tricube weights, evaluated at every mean. Adds ``sd_fit``.

    Features of equal mean become one level with a count and a sum. The window of a level is its
    ``ceil(span * features)`` nearest features (3 at least); it reaches at most that many features to either side, so the levels of a
    sample are cut by running counts into stretches of half a window, and each task gets one stretch and the
    levels within a window of its edges. No task holds a sample, and nothing is interpolated. A level with
    fewer than three levels in its window keeps its own mean; features without mean or variance are left out.
    """
    by = list(by)
    usable = moments.filter((F.col("mu") > 0) & (F.col("var") > 0)).withColumn("_x", F.log10("mu"))
    levels = usable.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_w"), F.sum(F.log10("var")).alias("_s"))
    placed = cut_lineage(running_total(levels, by, [F.col("_x")], F.col("_w"), "_upto"))
    window = F.least(F.col("_n"), F.greatest(F.lit(3), F.ceil(F.lit(float(span)) * F.col("_n"))))
    sizes = (placed.groupBy(*by).agg(F.max("_upto").alias("_n"))
             .select(*by, "_n", window.alias("_q"), F.ceil(window / 2).alias("_step")))
    start = F.col("_upto") - F.col("_w")
    first = F.greatest(F.lit(0), F.floor((start - F.col("_q")) / F.col("_step")))
    last = F.least(F.floor((F.col("_n") - 1) / F.col("_step")), F.ceil((F.col("_upto") + F.col("_q")) / F.col("_step")) - 1)
    home = F.floor(start / F.col("_step"))
    sent = salted_join(placed, sizes, by, ["_x"]).withColumn("_chunk", F.explode(F.sequence(first, last))).select(
        *by, "_chunk", "_x", "_w", "_s", "_q", (home == F.col("_chunk")).alias("_own"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_x", ignore_index=True)
        own = pdf["_own"].to_numpy()
        heights = _local_heights(pdf["_x"].to_numpy(), pdf["_w"].to_numpy(float), pdf["_s"].to_numpy(), int(pdf["_q"].iloc[0]), np.flatnonzero(own))
        return pdf.loc[own, [*by, "_x"]].assign(_fit=heights)

    fitted = sent.groupBy(*by, "_chunk").applyInPandas(fit, levels.select(*by, "_x", F.col("_s").alias("_fit")).schema)
    return usable.join(fitted, [*by, "_x"]).withColumn("sd_fit", F.sqrt(F.pow(F.lit(10.0), F.col("_fit")))).drop("_x", "_fit")


def _local_heights(x: np.ndarray, w: np.ndarray, s: np.ndarray, q: int, at: np.ndarray) -> np.ndarray:
    """Fits at the levels ``at`` of rising ``x`` with counts ``w`` and sums ``s``."""
    before = np.concatenate([[0.0], np.cumsum(w)])
    right = np.searchsorted(before, before[:-1] + q) - 1       # last level of the least window that begins at each level
    ends = np.append(x, np.inf)[np.minimum(right, len(x))]
    heights = s[at] / w[at]
    for k, i in enumerate(at):
        h = np.maximum(x[i] - x[:i + 1], ends[:i + 1] - x[i]).min()
        lo, hi = np.searchsorted(x, x[i] - h, "left"), np.searchsorted(x, x[i] + h, "right")
        u = (x[lo:hi] - x[i]) / h if h > 0 else np.zeros(0)
        near = np.abs(u) < 1
        if near.sum() < 3:
            continue
        u, n, y = u[near], w[lo:hi][near], s[lo:hi][near]
        k3 = (1 - np.abs(u) ** 3) ** 3
        a0, a1, a2, a3, a4 = ((n * k3 * u ** p).sum() for p in range(5))
        b0, b1, b2 = ((y * k3 * u ** p).sum() for p in range(3))
        minors = a2 * a4 - a3 * a3, a1 * a4 - a2 * a3, a1 * a3 - a2 * a2
        heights[k] = (b0 * minors[0] - b1 * minors[1] + b2 * minors[2]) / (a0 * minors[0] - a1 * minors[1] + a2 * minors[2])
    return heights


def variable_features(counts: DataFrame, cells: DataFrame, n: int = 2000, trend: str = "quadratic",
                      by: Sequence[str] = ("sample",)) -> DataFrame:
    """The ``n`` genes per sample with the highest variance of the clipped standardised counts.

    Returns ``(sample, gene, score, rk)``.
    """
    by = list(by)
    return top_features(standardized_variance(counts, cells, trend, by), n, by)


def standardized_variance(counts: DataFrame, cells: DataFrame, trend: str = "quadratic",
                          by: Sequence[str] = ("sample",)) -> DataFrame:
    """Variance of ``min((v - mu) / sd_fit, sqrt(n))`` per gene, from the non-zero rows alone."""
    by = list(by)
    # the gene tables are small next to the counts and used several times
    moments = cut_lineage(gene_moments(counts, cells, by))
    fitted = cut_lineage({"quadratic": quadratic_trend, "loess": loess_trend}[trend](moments, by))
    z = F.least(F.coalesce(F.try_divide(F.col("cnt") - F.col("mu"), F.col("sd_fit")), F.lit(0.0)), F.sqrt("n"))
    kept = ("n", "nnz", "mu", "var", "sd_fit")     # one row per gene: carried through the sums, not joined again
    squares = counts.select(*by, "gene", "cnt").join(fitted.select(*by, "gene", *kept), [*by, "gene"]).groupBy(
        *by, "gene").agg(F.sum(z * z).alias("zz"), *[F.first(c).alias(c) for c in kept])
    zero = F.try_divide(F.col("mu"), F.col("sd_fit"))
    return squares.select(
        *by, "gene", "mu", "var", "sd_fit",
        F.coalesce((F.col("zz") + (F.col("n") - F.col("nnz")) * zero * zero) / (F.col("n") - 1),
                   F.lit(0.0)).alias("score"))


def top_features(scored: DataFrame, n: int, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Highest scores per group; the rank limit is applied before the shuffle as well as after it."""
    order = W.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "gene")
    return (scored.select(*by, "gene", "score").withColumn("rk", F.row_number().over(order))
            .filter(F.col("rk") <= n))


def consensus_features(ranked: DataFrame, n: int = 2000) -> DataFrame:
    """Genes chosen by most samples; equal counts go to the lower median rank."""
    votes = ranked.groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_samples"), F.median("rk").alias("median_rk"))
    return votes.orderBy(F.desc("n_samples"), "median_rk", "gene").limit(n)


def scale(values: DataFrame, cells: DataFrame, features: DataFrame, by: Sequence[str] = (),
          clip: float = 10.0, value: str = "v") -> tuple[DataFrame, DataFrame]:
    """Per-gene z-scores over all cells, kept sparse.

    Returns the rows of non-zero values with ``z``, and the gene table with ``zero_z``, the score
    of every absent row. ``features`` has ``gene`` (and the ``by`` columns when grouped).
    """
    by = list(by)
    kept = cut_lineage(values.join(features.select(*by, "gene"), [*by, "gene"], "left_semi"))
    if by:
        stats = gene_moments(kept, cells, by, value)
    else:
        stats = gene_moments(kept.withColumn("_all", F.lit(0)), cells.withColumn("_all", F.lit(0)),
                             ["_all"], value).drop("_all")
    stats = stats.withColumn("sd", F.sqrt("var"))
    zero = _clipped(F.try_divide(-F.col("mu"), F.col("sd")), clip)
    stats = cut_lineage(stats.select(*by, "gene", "n", "mu", "sd", zero.alias("zero_z")))
    return scale_with(kept, stats, by, clip, value), stats


def scale_with(values: DataFrame, stats: DataFrame, by: Sequence[str] = (), clip: float = 10.0,
               value: str = "v") -> DataFrame:
    """z-scores of non-zero values by the means and deviations of another set of cells."""
    z = _clipped(F.try_divide(F.col(value) - F.col("mu"), F.col("sd")), clip)
    return (values.join(stats.select(*by, "gene", "mu", "sd"), [*by, "gene"])
            .withColumn("z", z).drop("mu", "sd"))


def _clipped(z: Column, clip: float) -> Column:
    """Upper-clipped score, zero for a gene without variance (``least`` alone would skip the NULL)."""
    return F.least(F.coalesce(z, F.lit(0.0)), F.lit(float(clip)))
