"""Poisson-lognormal likelihood fits and quantile mapping to quasi-counts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import spread
from ..schema import CELL_KEY

STEPS = 240
DEPTH = 40.0          # the integrand is followed down to exp(-DEPTH) of its top
NODE, STRIP = 0.45, 0.25      # most steps of ``_slopes``, in widths of the top and as such
BLOCK = 1 << 16       # numbers in memory at once there, about


def log_factorial(y: np.ndarray) -> np.ndarray:
    """ln y! by Stirling's series, from ten on; below that through the next ten factors."""
    z = y + 11.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)
    return series - np.log(y[:, None] + np.arange(1.0, 11.0)).sum(axis=1)


def _top(y: np.ndarray, mu, sigma) -> np.ndarray:
    """Where each integrand is greatest, by Newton's steps."""
    x = np.where(y > 0, np.log(np.maximum(y, 0.5)), np.minimum(mu, 0.0))
    for _ in range(200):
        rate = np.exp(x)
        step = (y - rate - (x - mu) / sigma ** 2) / (rate + 1 / sigma ** 2)
        x = x + np.clip(step, -1.0, 1.0)
        if np.all(np.abs(step) < 1e-12 * (1 + np.abs(x))):
            break
    return x


def _around_top(y: np.ndarray, mu, sigma):
    """Top x of each integrand, steps d around it, their width, and the integrand at x + d over that at x.

    From the top the integrand's logarithm falls by e^x (e^d - 1 - d) + d^2 / (2 sigma^2) exactly. The
    trapezoid rule runs over the d where that is below ``DEPTH``, so its nodes are as dense as the top is narrow.
    """
    x = _top(y, mu, sigma)
    rate = np.exp(x)

    def reach(sign: int) -> np.ndarray:
        lo, hi = np.zeros_like(x), np.zeros_like(x) + math.sqrt(2 * DEPTH) * sigma
        for _ in range(60):
            mid = (lo + hi) / 2
            far = rate * (np.expm1(sign * mid) - sign * mid) + mid ** 2 / (2 * sigma ** 2) > DEPTH
            lo, hi = np.where(far, lo, mid), np.where(far, mid, hi)
        return hi

    left, right = reach(-1), reach(1)
    h = (left + right) / STEPS
    d = -left[:, None] + h[:, None] * np.arange(STEPS + 1)
    wide = sigma[:, None] if np.ndim(sigma) else sigma
    return x, d, h, np.exp(-rate[:, None] * (np.expm1(d) - d) - d * d / (2 * wide ** 2))


def _log_pmf(y, mu, sigma, x, h, heights) -> np.ndarray:
    top = y * x - np.exp(x) - log_factorial(y) - (x - mu) ** 2 / (2 * sigma ** 2) - np.log(sigma * math.sqrt(2 * math.pi))
    return top + np.log(heights.sum(axis=1) * h)


def poisson_lognormal_log_pmf(y: np.ndarray, mu, sigma) -> np.ndarray:
    """ln P(y) for counts whose log rate is normal(mu, sigma), for counts of any size; mu and sigma are numbers or one for each count."""
    y = np.asarray(y, dtype=float)
    x, _, h, heights = _around_top(y, mu, sigma)
    return _log_pmf(y, mu, sigma, x, h, heights)


def _spans(rate: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right of its top an integrand is followed: Newton's steps from above on a convex function, so never too short."""
    wide = 1 / sigma ** 2
    left = math.sqrt(2 * DEPTH) * sigma
    right = math.sqrt(2 * DEPTH) * np.minimum(sigma, 1 / np.sqrt(rate + wide))
    right = np.minimum(right, np.log(2 * DEPTH / np.maximum(rate, 1e-300) + 2))
    for _ in range(8):
        e = np.exp(-left)
        left = left - (rate * (e - 1 + left) + left * left * wide / 2 - DEPTH) / (rate * (1 - e) + left * wide)
        e = np.exp(right)
        right = right - (rate * (e - 1 - right) + right * right * wide / 2 - DEPTH) / (rate * (e - 1) + right * wide)
    return left, right


def _slopes(y: np.ndarray, mu: np.ndarray, sigma: np.ndarray, constant: np.ndarray | None = None) -> np.ndarray:
    """ln P and its first and second derivatives by mu and ln sigma (five columns after it), from the moments of z = (x - mu) / sigma.

    The trapezoid rule's error falls with exp(-2 pi a / step), a being how far the integrand stays tame off the real line: pi / 2, and less the narrower its
    top. Steps of ``NODE`` widths of the top, and of ``STRIP`` at most, leave about 1e-15, so narrow tops take few nodes and wide ones what they need.
    ``constant`` is ln y! where that is known already.
    """
    out = np.empty((len(y), 6))
    constant = log_factorial(y) if constant is None else constant
    x = _top(y, mu, sigma)
    rate = np.exp(x)
    left, right = _spans(rate, sigma)
    nodes = np.ceil((left + right) / np.minimum(NODE / np.sqrt(rate + 1 / sigma ** 2), STRIP))
    nodes = (16 * np.ceil(np.maximum(nodes, 32) / 16)).astype(np.int64)
    half = (left + right) / 2
    order = np.argsort(nodes, kind="stable")
    sizes, first = np.unique(nodes[order], return_index=True)
    for size, lo, hi in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        at = np.linspace(-1.0, 1.0, size + 1)
        powers = np.stack([at ** p for p in range(5)], axis=1)
        for start in range(lo, hi, max(1, BLOCK // size)):
            rows = order[start:min(hi, start + max(1, BLOCK // size))]
            r, s = rate[rows, None], sigma[rows]
            d = (half[rows] - left[rows])[:, None] + half[rows, None] * at
            fall = np.exp(d) if float(r.max()) < 1e3 else np.expm1(d) + 1.0
            fall -= 1.0
            fall -= d
            fall *= r
            d *= d
            d *= (0.5 / s ** 2)[:, None]
            fall += d
            np.negative(fall, out=fall)
            np.exp(fall, out=fall)
            m0, m1, m2, m3, m4 = (fall @ powers).T
            m1, m2, m3, m4 = m1 / m0, m2 / m0, m3 / m0, m4 / m0
            b = half[rows] / s
            e = (x[rows] - mu[rows] + half[rows] - left[rows]) / s + b * m1          # mean of z, then its central moments
            v = b ** 2 * (m2 - m1 ** 2)
            c3 = b ** 3 * (m3 - 3 * m1 * m2 + 2 * m1 ** 3)
            c4 = b ** 4 * (m4 - 4 * m1 * m3 + 6 * m1 ** 2 * m2 - 3 * m1 ** 4)
            top = y[rows] * x[rows] - rate[rows] - constant[rows] - (x[rows] - mu[rows]) ** 2 / (2 * s ** 2)
            out[rows, 0] = top + np.log(m0 * (2 * half[rows] / size) / (s * math.sqrt(2 * math.pi)))
            out[rows, 1] = e / s
            out[rows, 2] = e * e + v - 1
            out[rows, 3] = (v - 1) / s ** 2
            out[rows, 4] = (2 * e * v + c3 - 2 * e) / s
            out[rows, 5] = 4 * e * e * v + 4 * e * c3 + c4 - v * v - 2 * (e * e + v)
    return out


#: Beyond these the likelihood is flat in double precision (all counts equal, or zeros and ones only).
MU_BOUNDS, LOG_SIGMA_BOUNDS = (-40.0, 40.0), (math.log(0.02), math.log(20.0))
#: Newton's steps begin at the best of these and of the grid: from a grid that ends far from a cell's maximum most steps were the way there.
STARTS = np.array([(m, s) for m in (-40.0, -36.0, -32.0, -28.0, -24.0, -20.0, -16.0, -12.0, -8.0, -4.0, 0.0, 4.0) for s in (1.0, 2.0, 4.0, 7.0, 9.0, 11.0, 13.0, 16.0)])


def maximise(y: np.ndarray, n: np.ndarray, cell: np.ndarray, mu: np.ndarray, sigma: np.ndarray, tolerance: float = 1e-6, rounds: int = 200):
    """Newton's steps on (mu, ln sigma) of many histograms at once: ``n[i]`` times the count ``y[i]`` in ``cell[i]``.

    Returns mu, sigma, the log likelihood, and the greatest slope left that does not point out of the bounds. A step that lowers a cell's likelihood is halved.
    """
    at = np.stack([mu, np.log(sigma)], axis=1).astype(float)
    low, high = (np.array([b[k] for b in (MU_BOUNDS, LOG_SIGMA_BOUNDS)]) for k in range(2))
    at = np.clip(at, low, high)

    known, noise = log_factorial(y), 1e-14 * np.bincount(cell, n, len(at))      # of a sum over so many counts, mostly zeros

    def look(points: np.ndarray, which: np.ndarray) -> np.ndarray:
        wanted = np.zeros(len(points), bool)
        wanted[which] = True
        rows = np.flatnonzero(wanted[cell])
        c = cell[rows]
        each = _slopes(y[rows], points[c, 0], np.exp(points[c, 1]), known[rows]) * n[rows, None]
        return np.stack([np.bincount(c, each[:, p], len(points)) for p in range(6)], axis=1)[which]

    now, todo, slope = np.full((len(at), 6), -np.inf), np.arange(len(at)), np.full(len(at), np.inf)
    now[todo] = look(at, todo)
    scale = np.ones(len(at))
    for _ in range(rounds):
        g = now[:, 1:3]
        out = ((at <= low) & (g < 0)) | ((at >= high) & (g > 0))
        slope = np.abs(np.where(out, 0.0, g)).max(axis=1)
        todo = np.flatnonzero((slope >= tolerance) & (scale > 1e-12))
        if not len(todo):
            break
        h = np.stack([now[todo, 3], now[todo, 4], now[todo, 4], now[todo, 5]], axis=1).reshape(-1, 2, 2)
        h[out[todo, 0], 0, 1] = h[out[todo, 0], 1, 0] = 0.0
        h[out[todo, 1], 0, 1] = h[out[todo, 1], 1, 0] = 0.0
        values, vectors = np.linalg.eigh(h)
        values = -np.maximum(np.abs(values), 1e-9)              # uphill even where the likelihood is not concave
        free = np.where(out[todo], 0.0, g[todo])
        step = -np.einsum("nij,nj,nkj,nk->ni", vectors, 1 / values, vectors, free)
        # mu is measured in sigmas, so a far maximum is a few steps away
        most = np.stack([2.0 * np.maximum(1.0, np.exp(at[todo, 1])), np.full(len(todo), 2.0)], axis=1)
        step *= np.minimum(1.0, (most / np.maximum(np.abs(step), 1e-300)).min(axis=1, keepdims=True))
        # a step that ends at a bound: the other number follows the one that is held there
        held = np.clip(at[todo] + step, low, high) - at[todo]
        over = (at[todo] + step < low) | (at[todo] + step > high)
        for k in range(2):
            cut = over[:, k] & ~over[:, 1 - k]
            follow = (free[:, 1 - k] + h[:, 0, 1] * held[:, k]) / np.maximum(np.abs(h[:, 1 - k, 1 - k]), 1e-9)
            step[cut, 1 - k] = np.clip(follow, -most[:, 1 - k], most[:, 1 - k])[cut]
            step[cut, k] = held[cut, k]
        step *= scale[todo, None]
        tried = at.copy()
        tried[todo] = np.clip(at[todo] + step, low, high)
        new = look(tried, todo)
        better = new[:, 0] >= now[todo, 0] - 1e-12 * np.abs(now[todo, 0]) - noise[todo]
        at[todo[better]], now[todo[better]], scale[todo[better]] = tried[todo[better]], new[better], 1.0
        scale[todo[~better]] /= 4
    return at[:, 0], np.exp(at[:, 1]), now[:, 0], slope


def poisson_lognormal_pmf(y: np.ndarray, mu: float, sigma: float) -> np.ndarray:
    return np.exp(poisson_lognormal_log_pmf(y, mu, sigma))


def fit_poisson_lognormal(counts: DataFrame, n_genes: int, mus: Sequence[float], sigmas: Sequence[float], refine: bool = False) -> DataFrame:
    """Most likely (mu, sigma) of every cell on a grid: ``(sample, cell_id, mu, sigma, ll)``; with ``refine`` the maximum that Newton's
    steps reach from there or from a better one of ``STARTS``, with ``grid_ll`` and ``slope``, the greatest derivative left.

    A cell becomes the histogram of its counts (zeros included), one row; a task works out the likelihood of a count
    when it first meets it, and every grid point of a cell is then one product.
    """
    grid = np.array(sorted((float(m), float(s)) for m in mus for s in sigmas))
    points = np.concatenate([grid, STARTS]) if refine else grid
    seen = counts.groupBy(*CELL_KEY, F.col("cnt").cast("double").alias("cnt")).agg(F.count(F.lit(1)).alias("n"))
    held = seen.groupBy(*CELL_KEY).agg(F.collect_list("cnt").alias("_y"), F.collect_list("n").alias("_n"), F.sum("n").alias("_rows"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met, table = np.zeros(0), np.zeros((0, len(points)))

        def logs(y: np.ndarray) -> np.ndarray:
            nonlocal met, table
            new = np.setdiff1d(y, met)
            if len(new):
                if len(met) > 1 << 16:
                    met, table, new = met[:0], table[:0], np.unique(y)
                rows = [np.stack([poisson_lognormal_log_pmf(new[lo:lo + 4096], m, s) for m, s in grid.tolist()], axis=1)
                        for lo in range(0, len(new), 4096)]
                more = points[len(grid):]
                far = _slopes(np.repeat(new, len(more)), np.tile(more[:, 0], len(new)), np.tile(more[:, 1], len(new)))[:, 0]
                met, table = np.concatenate([met, new]), np.concatenate([table, np.hstack([np.concatenate(rows), far.reshape(len(new), len(more))])])
                order = np.argsort(met)
                met, table = met[order], table[order]
            return table[np.searchsorted(met, y)]

        for pdf in batches:
            for first in range(0, len(pdf), 1024):
                part = pdf.iloc[first:first + 1024]
                ys, ns, tops, lls, starts = [], [], [], [], []
                for y, n, total in zip(part["_y"], part["_n"], part["_rows"]):
                    y, n = np.append(np.asarray(y, float), 0.0), np.append(np.asarray(n, float), n_genes - total)
                    order = np.argsort(y, kind="stable")
                    ys.append(y[order])
                    ns.append(n[order])
                known, at = logs(np.concatenate(ys)), 0
                for y, n in zip(ys, ns):
                    ll = n @ known[at:at + len(y)]
                    at += len(y)
                    near = np.round(ll[:len(grid)], 6)
                    tops.append(np.flatnonzero(near == near.max())[-1])      # of equal ones the greatest (mu, sigma)
                    lls.append(ll[tops[-1]])
                    starts.append(int(np.argmax(ll)) if ll.max() > lls[-1] else tops[-1])
                out = part[list(CELL_KEY)].copy()
                out["mu"], out["sigma"], out["ll"] = grid[tops, 0], grid[tops, 1], lls
                if refine:
                    cell = np.repeat(np.arange(len(ys)), [len(y) for y in ys])
                    out["mu"], out["sigma"], out["ll"], out["slope"] = maximise(np.concatenate(ys), np.concatenate(ns), cell, points[starts, 0], points[starts, 1])
                    out["grid_ll"] = lls
                yield out

    keys = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in CELL_KEY)
    more = ", slope double, grid_ll double" if refine else ""
    return spread(held, CELL_KEY).mapInPandas(best, f"{keys}, mu double, sigma double, ll double{more}")


def scale_of(zero_share: float, shape: float) -> float:
    """The mu at which a count is zero with the given probability, by narrowing a bracket 64-fold a round."""
    t = np.arange(-1200, 1201) / 100.0
    weight = np.exp(-t * t / 2)
    weight /= weight.sum()
    lo, hi = -60.0, 60.0
    while hi - lo > 1e-12 * max(1.0, abs(lo)):
        mus = np.linspace(lo, hi, 65)
        zero = np.exp(-np.exp(np.minimum(mus[:, None] + shape * t, 700.0))) @ weight
        k = int(np.searchsorted(-zero, -zero_share, side="right")) - 1      # the last mu whose share is not below
        if not 0 <= k < 64:
            return float(mus[np.clip(k, 0, 64)])
        lo, hi = mus[k], mus[k + 1]
        if lo == mus[0] and hi == mus[-1]:
            break
    return float(lo)


TABLES = 1 << 24     # quantiles a task keeps
EXACT = 256          # counts below this are summed one by one
KNOTS = 16           # for each doubling of the counts beyond


def quantiles(mu: float, shape: float, shares: np.ndarray) -> np.ndarray:
    """Least counts from 1 on at which the zero-truncated distribution reaches the ascending ``shares`` (below 1).

    Small counts are summed. Beyond, sums between knots that double every ``KNOTS`` are integrals of the smooth pmf with the end terms of Euler's
    formula; between two knots the cumulative function is the cubic with the right values and slopes, and a bisection finds all shares at once.
    """
    small = np.cumsum(poisson_lognormal_pmf(np.arange(EXACT, dtype=float), mu, shape))
    goal = small[0] + shares * (1 - small[0])
    out = np.maximum(1, np.searchsorted(small, goal, side="left"))
    rest = goal > small[-1]
    if not rest.any():
        return out.astype(np.int64)
    nodes, weights = np.polynomial.legendre.leggauss(6)
    step = math.log(2) / KNOTS
    s0, upto, knots, values, slopes = math.log(EXACT - 1), float(small[-1]), [], [], []

    def smooth(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(y) and its slope by y at y = e^s."""
        e = 1e-4
        around = poisson_lognormal_log_pmf(np.exp(np.concatenate([s - e, s, s + e])), mu, shape).reshape(3, -1)
        p = np.exp(around[1])
        return p, p * (around[2] - around[0]) / (2 * e) / np.exp(s)

    while True:                                   # an octave a round
        at = s0 + step * np.arange(KNOTS + 1)
        inner = (at[:-1, None] + step / 2 * (1 + nodes)).ravel()
        areas = (np.exp(poisson_lognormal_log_pmf(np.exp(inner), mu, shape) + inner).reshape(KNOTS, -1) * weights).sum(axis=1) * step / 2
        p, dp = smooth(at)
        ends = p / 2 + dp / 12
        cdf = upto + np.concatenate([[0.0], np.cumsum(areas)]) + ends - ends[0]
        slope = (p + dp / 2) * np.exp(at)
        keep = slice(0 if not knots else 1, None)
        knots.append(at[keep])
        values.append(cdf[keep])
        slopes.append(slope[keep])
        if cdf[-1] >= goal[-1] or cdf[-1] <= upto:
            break
        upto, s0 = float(cdf[-1]), float(at[-1])
    knots, values, slopes = map(np.concatenate, (knots, values, slopes))
    g = goal[rest]
    i = np.clip(np.searchsorted(values, g, side="left") - 1, 0, len(knots) - 2)
    width = knots[i + 1] - knots[i]
    lo, hi = np.zeros(len(g)), np.ones(len(g))
    for _ in range(52):
        t = (lo + hi) / 2
        cubic = (values[i] * (1 + 2 * t) * (1 - t) ** 2 + width * slopes[i] * t * (1 - t) ** 2
                 + values[i + 1] * t * t * (3 - 2 * t) - width * slopes[i + 1] * t * t * (1 - t))
        lo, hi = np.where(cubic < g, t, lo), np.where(cubic < g, hi, t)
    out[rest] = np.ceil(np.round(np.exp(knots[i] + hi * width), 7))
    return out.astype(np.int64)


def quasi_counts(values: DataFrame, n_genes: int, shape: float = 2.2, value: str = "tpm",
                 mus: Sequence[float] | None = None, name: str = "qumi") -> DataFrame:
    """Map every cell's non-zero values by rank to Poisson-lognormal quantiles; zeros stay zeros.

    The scale of a cell is the mu that gives its share of zeros (half a zero where it has none); with ``mus``, the greatest of
    those whose zero probability is not below that share, or the least one. Value ranks ``(values <= v) / (non-zeros + 1)`` go
    to the zero-truncated distribution. Cells with as many non-zeros share a scale and quantiles, which a task keeps up to
    ``TABLES`` numbers, so rows need no sort by that number.
    """
    grid = None if mus is None else np.sort(np.asarray(mus, dtype=float))

    # per-cell window: a cell has at most n_genes rows; both counts share one sort
    cell = W.partitionBy(*CELL_KEY).orderBy(value)
    placed = values.withColumns({"_nnz": F.count(F.lit(1)).over(cell.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
                                 "_le": F.count(F.lit(1)).over(cell.rangeBetween(W.unboundedPreceding, W.currentRow))})

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[float, np.ndarray]] = {}
        held = 0
        zero = None if grid is None else np.array([poisson_lognormal_pmf(np.zeros(1), m, shape)[0] for m in grid])
        for pdf in batches:
            nnz, le = pdf["_nnz"].to_numpy(), pdf["_le"].to_numpy()
            scales, out = np.empty(len(pdf)), np.empty(len(pdf), np.int64)
            for n in np.unique(nnz):
                if n not in known:
                    share = max(1 - n / n_genes, 0.5 / n_genes)
                    mu = scale_of(share, shape) if grid is None else grid[max(0, int((zero >= 1 - n / n_genes).sum()) - 1)]
                    known[n], held = (mu, quantiles(mu, shape, np.arange(1, n + 1) / (n + 1.0))), held + int(n)
                    while held > TABLES and len(known) > 1:      # the oldest go first
                        held -= len(known.pop(next(iter(known)))[1])
                mu, table = known[n]
                rows = nnz == n
                scales[rows], out[rows] = mu, table[le[rows] - 1]
            yield pdf.drop(columns=["_nnz", "_le"]).assign(mu=scales, **{name: out})

    fields = values.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", mu double, {name} bigint"
    return placed.mapInPandas(look_up, schema)
