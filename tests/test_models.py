"""Components, batch correction, doublets, mixtures and quasi-counts."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import batch, doublets, normalize, pca, quantile, regions
from cytolake.plans import analyses, presets


def planted_counts(spark, types=2, per=25, doublets_=5, genes=30, samples=("a",), seed=1):
    """Cells of ``types`` kinds, each high in its own genes, and sums of two kinds at the end."""
    rng, rows = np.random.default_rng(seed), []
    for s in samples:
        made = []
        for t in range(types):
            mean = np.ones(genes)
            mean[t::types] = 12
            made += [rng.poisson(mean) for _ in range(per)]
        made += [made[i] + made[per + i] for i in range(doublets_)]
        rows += [(s, c, g, int(v)) for c, m in enumerate(made) for g, v in enumerate(m) if v]
    counts = spark.createDataFrame(rows, "sample string, cell_id bigint, gene bigint, cnt bigint")
    return counts, counts.groupBy("sample", "cell_id").agg(F.sum("cnt").alias("n_count"))


def dense_z(scaled, stats, cells, sample=None):
    z, g = scaled.toPandas(), stats.toPandas()
    if sample:
        z, g = z[z["sample"] == sample], g[g["sample"] == sample]
    g = g.sort_values("gene").reset_index(drop=True)
    ids = sorted(cells.filter(F.col("sample") == sample).toPandas().cell_id) if sample else sorted(cells.toPandas().cell_id)
    out = np.tile(g.zero_z.to_numpy(), (len(ids), 1))
    gi, ci = {x: i for i, x in enumerate(g.gene)}, {x: i for i, x in enumerate(ids)}
    for r in z.itertuples():
        out[ci[r.cell_id], gi[r.gene]] = r.z
    return out


def test_components_per_sample_match_svd(spark, monkeypatch):
    monkeypatch.setattr(pca, "GRAM_ROWS", 16)       # several partial matrices per sample
    monkeypatch.setattr(pca, "CHUNK_ROWS", 16)
    counts, cells = planted_counts(spark, samples=("a", "b"))
    feats = normalize.variable_features(counts, cells, 20)
    scaled, stats = normalize.scale(normalize.log_normalize(counts), cells, feats, ["sample"])
    emb, model, _ = pca.fit(scaled, stats, cells, 4, by=["sample"])
    for s in ("a", "b"):
        z = dense_z(scaled, stats, cells, s)
        _, sv, vt = np.linalg.svd(z, full_matrices=False)
        got = emb.filter(F.col("sample") == s).toPandas().sort_values("cell_id")
        assert np.abs(np.abs(np.stack(got.vec)) - np.abs(z @ vt[:4].T)).max() < 1e-8
        m = model.filter(F.col("sample") == s).toPandas().sort_values("pc")
        assert m.sdev.to_numpy() == pytest.approx(sv[:4] / np.sqrt(len(z) - 1))
        load = np.stack(m.loading)
        assert np.abs(load @ load.T - np.eye(4)).max() < 1e-8
        assert all(row[np.abs(row).argmax()] > 0 for row in load)


def test_loess_and_quadratic_agree_on_a_smooth_trend(spark):
    rows = [("s", g, float(m), float(m ** 1.5)) for g, m in enumerate(np.geomspace(0.1, 50, 200))]
    mom = spark.createDataFrame(rows, "sample string, gene bigint, mu double, var double")
    for fit in (normalize.quadratic_trend, normalize.loess_trend):
        got = fit(mom).toPandas().sort_values("gene")
        assert np.abs(got.sd_fit ** 2 / got["var"] - 1).max() < 0.01


@pytest.mark.parametrize("ties, span", [(1, 0.3), (4, 0.3), (1, 1.0), (40, 0.1), (1, 0.01)])
def test_local_trend_is_the_direct_fit_at_every_mean(spark, ties, span):
    rng = np.random.default_rng(3)
    mu = np.concatenate([rng.lognormal(0, 1, 240), rng.lognormal(3, .1, 60)])
    mu = np.repeat(mu[:len(mu) // ties], ties)
    var = mu ** 1.5 * rng.lognormal(0, .3, len(mu))
    rows = [(s, g, float(m), float(v)) for s in ("a", "b") for g, (m, v) in enumerate(zip(mu, var))]
    rows += [("a", 900, 0.0, 1.0), ("a", 901, 1.0, 0.0), ("c", 1, 2.0, 3.0), ("c", 2, 5.0, 7.0), ("d", 1, None, 1.0)]
    mom = spark.createDataFrame(rows, "sample string, gene bigint, mu double, var double")
    got = normalize.loess_trend(mom.repartition(5), span=span).toPandas()
    assert len(got) == 2 * len(mu) + 2 and list(got.columns) == ["sample", "gene", "mu", "var", "sd_fit"]
    x, y, q = np.log10(mu), np.log10(var), min(len(mu), max(3, int(np.ceil(span * len(mu)))))
    want = []
    for x0 in x:
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1]
        near = d < h
        if len(set(x[near])) < 3:
            want.append(y[x == x0].mean())
        else:
            k = (1 - (d[near] / h) ** 3) ** 3
            want.append(np.polyfit((x[near] - x0) / h, y[near], 2, w=np.sqrt(k))[2])
    for s in ("a", "b"):
        fit = got[got["sample"] == s].sort_values("gene").sd_fit.to_numpy()
        assert np.allclose(2 * np.log10(fit), want, atol=1e-7)
    alone = got[got["sample"] == "c"]
    assert np.allclose(alone.sd_fit ** 2, alone["var"])
    assert normalize.loess_trend(mom.limit(0)).count() == 0


def test_batch_gap_falls_and_one_batch_is_untouched(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        b = i % 2
        p = rng.normal(0, 0.3, 4) + (np.array([4, 0, 0, 0]) if i % 4 < 2 else np.array([0, 4, 0, 0])) + b * np.array([0, 0, 2, 1])
        rows.append(("s", i, f"b{b}", f"t{i % 3}", [float(v) for v in p]))
    df = spark.createDataFrame(rows, "sample string, cell_id bigint, batch string, tumor string, vec array<double>")
    trace = []
    fixed = batch.harmony(df, ["batch"], lam=1.0, max_rounds=4, n_clusters=5, trace=trace)
    before, after = batch.batch_gap(df, "batch").first().gap, batch.batch_gap(fixed, "batch").first().gap
    assert after < before / 10 and fixed.count() == 240
    two = batch.harmony(df, ["batch", "tumor"], lam=1.0, max_rounds=2, n_clusters=5)
    assert batch.batch_gap(two, "batch").first().gap < before / 4
    same = batch.harmony(df.withColumn("batch", F.lit("x")), ["batch"])
    assert same.orderBy("cell_id").first().vec == rows[0][4]


def test_correction_with_the_model_as_a_table_equals_the_one_in_tasks(spark):
    rng = np.random.default_rng(8)
    rows = [("s", i, ["x", "y", None][i % 3], "t" if i % 2 else "n", [float(v) for v in rng.normal(i % 3 + 2 * (i % 5), 1, 4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "sample string, cell_id bigint, batch string, tumor string, vec array<double>")
    for by in (["batch"], ["batch", "tumor"]):
        found, traces = [], []
        for size in (batch.MODEL, 0):
            traces.append([])
            fixed = batch.harmony(df, by, max_rounds=2, cluster_rounds=2, n_clusters=4, trace=traces[-1], model_size=size)
            found.append(fixed.orderBy("cell_id").toPandas())
        assert np.allclose(np.stack(found[0].vec), np.stack(found[1].vec), atol=1e-9) and np.allclose(*traces)
        assert [r.batch for r in fixed.orderBy("cell_id").collect()] == [r[2] for r in rows]


def test_planted_doublets_score_above_singlets(spark):
    counts, cells = planted_counts(spark)
    rates = spark.createDataFrame([("a", 0.1)], "sample string, doublet_rate double")
    got = doublets.doublet_scores(counts, cells, rates, n_features=30, n_pcs=5).toPandas()
    assert got.scrublet_score.between(0, 1).all() and len(got) == 55
    assert got[got.cell_id >= 50].scrublet_score.mean() > 3 * got[got.cell_id < 50].scrublet_score.mean()


def test_classifier_finds_planted_doublets(spark):
    counts, cells = planted_counts(spark)
    got = doublets.classify(counts, cells, rate=0.18, n_features=30, n_pcs=5, k=10, p_ns=(0.2, 0.25, 0.3),
                            p_ks=(0.15, 0.2)).toPandas()
    called = got[got.doublet_finder == "Doublet"]
    assert len(got) == 55 and 3 <= len(called) <= 10
    assert (called.cell_id >= 50).sum() >= 3


def test_pairs_are_proper_and_repeatable(spark):
    _, cells = planted_counts(spark)
    a = doublets.synthetic_pairs(cells.repartition(5), 2.0).toPandas()
    b = doublets.synthetic_pairs(cells.coalesce(1), 2.0).toPandas()
    assert sorted(map(tuple, a.values)) == sorted(map(tuple, b.values))
    assert len(a) == 220 and (a.groupby("sim").parent.nunique() == 2).all()


def test_scores_come_from_counts_without_lists(spark, monkeypatch):
    def listed(*_, **__):
        raise AssertionError("neighbours were listed")
    monkeypatch.setattr(doublets.graph, "knn", listed)
    counts, cells = planted_counts(spark, samples=("a", "b"))
    rates = spark.createDataFrame([("a", 0.1), ("b", 0.1)], "sample string, doublet_rate double")
    assert doublets.doublet_scores(counts, cells, rates, n_features=30, n_pcs=5).filter("scrublet_score IS NOT NULL").count() == 110


@pytest.mark.parametrize("pairs", [1 << 22, 7])
def test_sparse_rows_are_summed_by_their_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(pca, "PAIRS", pairs)
    seen, add = spark.sparkContext.accumulator(0), pca._add_pairs

    def counted(total, sizes, idx, dz):
        seen.add(len(sizes))
        add(total, sizes, idx, dz)
    monkeypatch.setattr(pca, "_add_pairs", counted)
    width, rng = 200, np.random.default_rng(3)
    held = [sorted(rng.choice(width, n, replace=False).tolist()) for n in (0, 1, 2, 3, 0, 5, 1, 4)]
    held += [list(range(width))] * 1100         # a second piece, of full rows
    dz = [rng.normal(size=len(h)).tolist() for h in held]
    rows = spark.createDataFrame([("s", h, z) for h, z in zip(held[:8], dz[:8])] + [("t", h, z) for h, z in zip(held[8:], dz[8:])], "g string, idx array<int>, dz array<double>")
    blocks = pca.gram(rows.coalesce(1), width, ["g"], spark.createDataFrame([("s", 8), ("t", 1100)], "g string, _n bigint")).toPandas()
    assert seen.value == 8
    for g, part in (("s", slice(0, 8)), ("t", slice(8, None))):
        x = np.zeros((len(held[part]), width + 1))
        x[:, width] = 1
        for i, (h, z) in enumerate(zip(held[part], dz[part])):
            x[i, h] = z
        got = np.zeros((width + 1, width + 1))
        for b, data in blocks[blocks.g == g][["block", "data"]].itertuples(index=False):
            got[b * pca.BLOCK:b * pca.BLOCK + pca.BLOCK] = np.asarray(data).reshape(-1, width + 1)
        assert np.allclose(got, x.T @ x)


def test_mixture_likelihood_rises_and_prefers_two_where_planted(spark):
    rng = np.random.default_rng(5)
    rows = [("s", i, "two", float(v)) for i, v in enumerate(np.r_[rng.normal(-2, .5, 100), rng.normal(2, .5, 100)])]
    rows += [("s", i, "one", float(v)) for i, v in enumerate(rng.normal(0, 1, 200))]
    df = spark.createDataFrame(rows, "sample string, cell_id bigint, region string, x double")
    models, post = regions.region_mixture(df, rounds=12)
    got = {r.region: r for r in models.collect()}
    assert got["two"].delta_bic > 10 > got["one"].delta_bic
    for r in got.values():
        assert all(b >= a - 1e-6 for a, b in zip(r.ll_path, r.ll_path[1:]))
    p = post.filter("region = 'two'").toPandas().sort_values("cell_id").posterior.to_numpy()
    assert p[:100].mean() < 0.05 and p[100:].mean() > 0.95


def test_mixture_rests_where_plain_rounds_lead(spark):
    rng = np.random.default_rng(6)
    parts = {"apart": np.r_[rng.normal(-2, .5, 300), rng.normal(2, .5, 100)], "near": np.r_[rng.normal(-1, 1, 200), rng.normal(1.5, .7, 200)],
             "far": np.r_[rng.normal(0, 1, 399), 60.0], "single": np.array([3.0]), "same": np.full(50, 2.0)}
    rows = [("s", i, k, float(v)) for k, vs in parts.items() for i, v in enumerate(vs)] + [("s", 999, "near", None), ("s", 1, "none", None)]
    df = spark.createDataFrame(rows, "sample string, cell_id bigint, region string, x double")
    models, post = regions.region_mixture(df.repartition(6))
    got = {r.region: r for r in models.collect()}
    assert set(got) == set(parts)
    for k in ("apart", "near"):
        x, q = np.sort(parts[k]), len(parts[k])
        p, m, v = .5, np.array([x[q // 4 - 1], x[3 * q // 4 - 1]]), np.full(2, x.var(ddof=1))
        for _ in range(3000):
            d = np.array([1 - p, p]) * np.exp(-(x[:, None] - m) ** 2 / (2 * v)) / np.sqrt(2 * np.pi * v)
            r = d / d.sum(axis=1, keepdims=True)
            like, w = np.log(d.sum(axis=1)).sum(), r.sum(axis=0)
            p, m = w[1] / q, (r * x[:, None]).sum(axis=0) / w
            v = (r * (x[:, None] - m) ** 2).sum(axis=0) / w
        g = got[k]
        assert np.allclose([g.p2, g.m1, g.m2, g.v1, g.v2], [p, *m, *v], atol=5e-3) and abs(g.ll_path[-1] - like) < 1e-4
        assert 2 <= len(g.ll_path) <= 10 and g.ll_path[-1] >= g.ll_path[0] - 1e-9
    assert post.filter("region = 'apart'").count() == 400
    assert regions.region_mixture(df.limit(0))[0].count() == 0


def test_poisson_lognormal_and_quasi_counts(spark):
    y = np.arange(4000.0)
    assert quantile.poisson_lognormal_pmf(y, 0.5, 1.0).sum() == pytest.approx(1, abs=1e-6)
    rng = np.random.default_rng(8)
    rows = [("s", c, g, float(v)) for c in range(4) for g, v in enumerate(rng.lognormal(0, 2, 200)) if v > 1.0]
    tpm = spark.createDataFrame(rows, "sample string, cell_id bigint, gene bigint, tpm double")
    got = quantile.quasi_counts(tpm, 200).toPandas()
    assert len(got) == len(rows) and (got.qumi >= 1).all()
    for _, cell in got.groupby("cell_id"):
        assert cell.sort_values("tpm").qumi.is_monotonic_increasing


def test_poisson_lognormal_at_large_counts():
    """Against a grid of four million nodes, at counts from 0 to 5,000."""
    y = np.array([0.0, 1, 10, 400, 5000])
    for mu, sigma in ((-2, 2.2), (1, 2.2), (4, 1.0), (1, 3.4)):
        t = np.linspace(-12, 12, 4_000_001)
        want = []
        for v in y:
            lp = v * (mu + sigma * t) - np.exp(mu + sigma * t) - math.lgamma(v + 1) - t * t / 2
            want.append(np.exp(lp - lp.max()).sum() * (t[1] - t[0]) / math.sqrt(2 * math.pi) * math.exp(lp.max()))
        assert quantile.poisson_lognormal_pmf(y, mu, sigma) == pytest.approx(want, rel=1e-6)


def test_quasi_count_quantiles_are_the_least_ones():
    mu, shares = quantile.scale_of(0.4, 2.2), np.arange(1, 400) / 400
    assert quantile.poisson_lognormal_pmf(np.zeros(1), mu, 2.2)[0] == pytest.approx(0.4)
    got = quantile.quantiles(mu, 2.2, shares)
    cdf = np.cumsum(quantile.poisson_lognormal_pmf(np.arange(got[-1] + 1.0), mu, 2.2))
    goal = 0.4 + shares * 0.6
    assert got[-1] > 500 and (cdf[got] >= goal - 1e-12).all() and (cdf[got - 1] < goal + 1e-12).all()


def test_fit_recovers_the_grid_point(spark):
    rng = np.random.default_rng(9)
    v = rng.poisson(rng.lognormal(0.5, 1.0, 3000))
    rows = [("s", 1, g, int(n)) for g, n in enumerate(v) if n]
    counts = spark.createDataFrame(rows, "sample string, cell_id bigint, gene bigint, cnt bigint")
    got = quantile.fit_poisson_lognormal(counts, 3000, [-0.5, 0.5, 1.5], [0.5, 1.0, 2.0]).first()
    assert (got.mu, got.sigma) == (0.5, 1.0)


def test_newton_rests_where_zeros_outweigh_all(spark):
    # cells of 20 counts among 20,000 features, whose maxima lie far from the grid
    kept = [[4, 5, 5, 10, 17, 20, 20, 21, 23, 25, 25, 28, 31, 32, 35, 35, 39, 40, 44, 47, 49], [2, 2, 2, 8, 11, 13, 20, 20, 21, 22, 37, 40, 41, 43, 44, 46, 50]]
    rows = [("s", c, g, n) for c, counts in enumerate(kept) for g, n in enumerate(counts)]
    counts = spark.createDataFrame(rows, "sample string, cell_id bigint, gene bigint, cnt bigint")
    got = quantile.fit_poisson_lognormal(counts, 20000, [-6.0, -4.0, -2.0], [1.0, 2.2, 3.4], refine=True).toPandas()
    assert len(got) == 2 and (got.slope < 1e-6).all() and (got.ll >= got.grid_ll).all()


def test_newton_walks_to_the_bounds_in_few_rounds(monkeypatch):
    rng, seen, slopes = np.random.default_rng(21), [], quantile._slopes
    ys, ns = zip(*(np.unique(rng.integers(1, 51, rng.integers(20, 60)).astype(float), return_counts=True) for _ in range(12)))
    cell = np.repeat(np.arange(12), [len(y) + 1 for y in ys])
    n = np.concatenate([np.append(1.2e6 - n.sum(), n) for n in ns])

    def look(y, *rest):
        seen.append(len(y))
        return slopes(y, *rest)
    monkeypatch.setattr(quantile, "_slopes", look)
    *_, left = quantile.maximise(np.concatenate([np.append(0.0, y) for y in ys]), n, cell, np.full(12, -6.0), np.full(12, 1.0))
    assert left.max() < 1e-6 and sum(seen) <= 25 * len(cell)


def test_slopes_against_a_dense_sum():
    rng = np.random.default_rng(22)
    y = np.concatenate([np.zeros(15), rng.integers(1, 60, 15), rng.integers(100, 20000, 10)]).astype(float)
    mu, sigma = rng.uniform(-40, 10, 40), np.exp(rng.uniform(math.log(0.02), math.log(20), 40))
    for i, got in enumerate(quantile._slopes(y, mu, sigma)):
        top = quantile._top(y[i:i + 1], mu[i:i + 1], sigma[i:i + 1])[0]
        d = np.linspace(-10 * sigma[i], 10 * sigma[i], 400_001)
        fall = -math.exp(top) * (np.expm1(np.minimum(d, 700)) - d) - d * d / (2 * sigma[i] ** 2)
        w, z = np.exp(fall), (top - mu[i] + d) / sigma[i]
        mean = (w * z).sum() / w.sum()
        v, c3, c4 = ((w * (z - mean) ** p).sum() / w.sum() for p in (2, 3, 4))
        want = [y[i] * top - math.exp(top) - math.lgamma(y[i] + 1) - (top - mu[i]) ** 2 / (2 * sigma[i] ** 2)
                + math.log(w.sum() * (d[1] - d[0]) / (sigma[i] * math.sqrt(2 * math.pi))),
                mean / sigma[i], mean ** 2 + v - 1, (v - 1) / sigma[i] ** 2, (2 * mean * v + c3 - 2 * mean) / sigma[i],
                4 * mean ** 2 * v + 4 * mean * c3 + c4 - v * v - 2 * (mean ** 2 + v)]
        assert got == pytest.approx(want, rel=1e-8, abs=1e-9)


def test_planted_copy_number_gain_is_called(spark):
    from cytolake.plans import analyses

    rng, rows = np.random.default_rng(11), []
    for c in range(60):
        mean = np.full(60, 6.0)
        if c >= 40:
            mean[:20] *= 4          # region A is gained in the last 20 cells
        rows += [("s", c, g, int(v)) for g, v in enumerate(rng.poisson(mean)) if v]
    counts = spark.createDataFrame(rows, "sample string, cell_id bigint, gene bigint, cnt bigint")
    genes = spark.createDataFrame([(g, "chr1", g) for g in range(60)], "gene bigint, chr string, pos int")
    table = spark.createDataFrame([("A", "chr1", 0, 19), ("B", "chr1", 20, 39), ("C", "chr1", 40, 59)],
                                  "region string, chr string, start int, end int")
    got = analyses.malignant_cells(counts, genes, table, ["A"], clusters=2, rounds=8).toPandas()
    assert len(got) == 60
    assert ((got.cand_tumor == "tumor") == (got.cell_id >= 40)).all()


def plain_cut(x, k):
    """One merge after another, by the largest distance between members."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    name, alive = np.arange(len(x)), len(x)
    while alive > k:
        a, b = sorted(divmod(int(d.argmin()), len(x)))
        d[a] = np.where(np.isinf(d[a]) | np.isinf(d[b]), np.inf, np.maximum(d[a], d[b]))
        d[:, a] = d[a]
        d[b] = d[:, b] = np.inf
        name[name == b] = a
        alive -= 1
    return name


def pairs_alike(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_profile_cut_equals_the_plain_one_on_1500_cells(spark):
    rng = np.random.default_rng(3)
    x = np.clip(rng.normal(0, 1, (1500, 3)) + rng.choice([-2, 0, 3], (1500, 1)), -4, 4)
    df = spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(x)], "sample string, cell_id bigint, a double, b double, c double")
    got = regions.profile_clusters(df, ["a", "b", "c"]).toPandas().sort_values("cell_id")
    assert pairs_alike(got.profile, plain_cut(x, 4)[got.cell_id])
    flat = got.assign(s=np.abs(x).sum(1)).groupby("profile").s.mean()
    assert flat.is_monotonic_increasing and list(flat.index) == [1, 2, 3, 4]


def test_profile_cut_on_cluster_features(spark):
    rng = np.random.default_rng(4)
    middle = np.repeat([[0, 0], [3, 3], [-3, 3], [3, -3]], [900, 60, 30, 10], axis=0)
    x = middle + rng.normal(0, .2, middle.shape)
    df = spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(x)], "sample string, cell_id bigint, a double, b double")
    got = regions.profile_clusters(df, ["a", "b"], leaves=40).toPandas().sort_values("cell_id")
    assert pairs_alike(got.profile, np.repeat([0, 1, 2, 3], [900, 60, 30, 10])) and set(got.profile[:900]) == {1}


def test_profile_cut_of_copies_missing_scores_and_no_cells(spark):
    kind = "sample string, cell_id bigint, a double, b double"
    df = spark.createDataFrame([("s", i, 0.0 if i % 3 else None, -0.0) for i in range(500)] + [("s", 500, 4.0, 4.0)], kind)
    got = regions.profile_clusters(df, ["a", "b"]).toPandas().sort_values("cell_id")
    assert len(got) == 501 and list(got.profile) == [1] * 500 + [2]
    assert regions.profile_clusters(df.limit(0), ["a", "b"]).count() == 0


def test_quantiles_by_knots_equal_summing_every_count():
    for share, n in ((0.4, 400), (0.9, 60), (0.05, 1500)):
        mu = quantile.scale_of(share, 2.2)
        assert quantile.poisson_lognormal_pmf(np.zeros(1), mu, 2.2)[0] == pytest.approx(share, abs=1e-9)
        shares = np.arange(1, n + 1) / (n + 1.0)
        cdf = np.cumsum(np.concatenate([quantile.poisson_lognormal_pmf(np.arange(a, a + 10000.0), mu, 2.2) for a in range(0, 60000, 10000)]))
        want = np.maximum(1, np.searchsorted(cdf, cdf[0] + shares * (1 - cdf[0])))
        assert want[-1] < 60000 and (quantile.quantiles(mu, 2.2, shares) == want).all()


def test_newton_finds_the_maximum():
    rng = np.random.default_rng(3)
    tables = [np.unique(rng.poisson(np.exp(rng.normal(m, s, 3000))), return_counts=True) for m, s in ((-3, 1.5), (-1, 0.4), (1, 2.5), (3, 0.8))]
    tables += [(np.array([0, 1]), np.array([90, 10])), (np.array([7]), np.array([50])), (np.array([0, 10 ** 6]), np.array([5, 5]))]
    y, n = (np.concatenate([t[k] for t in tables]).astype(float) for k in range(2))
    cell = np.repeat(np.arange(len(tables)), [len(t[0]) for t in tables])
    mu, sigma, ll, slope = quantile.maximise(y, n, cell, np.full(len(tables), 0.0), np.full(len(tables), 1.0))
    assert (slope[:4] < 1e-6).all() and np.isfinite(ll).all()
    for c in range(4):
        assert abs(mu[c] - (-3, -1, 1, 3)[c]) < 0.3 and abs(sigma[c] - (1.5, 0.4, 2.5, 0.8)[c]) < 0.3
    for c, (v, k) in enumerate(tables):
        for m in mu[c] + np.array([-0.1, 0, 0.1]):
            for s in sigma[c] * np.array([0.9, 1, 1.1]):
                inside = quantile.MU_BOUNDS[0] <= m <= quantile.MU_BOUNDS[1] and quantile.LOG_SIGMA_BOUNDS[0] <= np.log(s) <= quantile.LOG_SIGMA_BOUNDS[1]
                assert not inside or k @ quantile.poisson_lognormal_log_pmf(v.astype(float), m, s) <= ll[c] + 1e-6


def test_slopes_are_the_derivatives():
    y, e = np.array([0.0, 1, 5, 300]), 1e-5
    mu, u = np.array([-2.0, 0.5, 1, 4]), np.log([1.2, 0.7, 2.0, 0.5])
    at = quantile._slopes(y, mu, np.exp(u))
    by_mu = [quantile._slopes(y, mu + s * e, np.exp(u)) for s in (-1, 1)]
    by_u = [quantile._slopes(y, mu, np.exp(u + s * e)) for s in (-1, 1)]
    for (a, b), first, second in ((by_mu, 1, (3, 4)), (by_u, 2, (4, 5))):
        assert np.allclose((b[:, 0] - a[:, 0]) / (2 * e), at[:, first], rtol=1e-5, atol=1e-6)
        assert np.allclose((b[:, 1:3] - a[:, 1:3]) / (2 * e), at[:, second], rtol=1e-4, atol=1e-5)


def test_features_follow_the_presets_trend_and_groups(spark):
    counts, cells = planted_counts(spark)
    cells = cells.withColumn("patient", F.when(F.col("cell_id") % 7 > 0, F.concat(F.lit("p"), F.col("cell_id") % 3)))
    preset = presets.Preset(n_features=12)
    genes = lambda df: [r.gene for r in df.collect()]
    for trend in ("loess", "quadratic"):
        want = normalize.consensus_features(normalize.variable_features(counts, cells, 12, trend), 12)
        assert sorted(genes(analyses.choose_features(counts, cells, replace(preset, trend=trend)))) == sorted(genes(want))
    known = cells.filter("patient IS NOT NULL")
    moved = counts.join(known.select("sample", "cell_id", "patient"), ["sample", "cell_id"]).drop("sample").withColumnRenamed("patient", "sample")
    renamed = known.drop("sample").withColumnRenamed("patient", "sample")
    want = normalize.consensus_features(normalize.variable_features(moved, renamed, 12, "loess"), 12)
    assert sorted(genes(analyses.choose_features(counts, cells, replace(preset, features_by=("patient",))))) == sorted(genes(want))


def test_quasi_counts_sort_once_and_tables_may_be_dropped(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [("s", c, g, int(rng.integers(1, 30))) for c in range(40) for g in range(5 + c % 9)]
    values = spark.createDataFrame(rows, "sample string, cell_id bigint, gene bigint, cnt bigint")
    kept = {(r.cell_id, r.gene): (r.mu, r.qumi) for r in quantile.quasi_counts(values, 60, value="cnt").collect()}
    monkeypatch.setattr(quantile, "TABLES", 10, raising=False)
    found = quantile.quasi_counts(values, 60, value="cnt")
    assert {(r.cell_id, r.gene): (r.mu, r.qumi) for r in found.collect()} == kept and len(kept) == len(rows)
    plan = quantile.quasi_counts(values, 60, value="cnt")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_region_means_are_computed_once_for_the_scores(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    values = spark.createDataFrame([("s", 1, "g1", 2.0), ("s", 1, "g2", 4.0), ("s", 2, "g3", 3.0)], "sample string, cell_id int, gene string, v double")
    placed = spark.createDataFrame([("g1", "A"), ("g2", "A"), ("g3", "B"), ("g4", "C")], "gene string, region string")
    factors = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 0.5), ("s", 3, 0.0)], "sample string, cell_id int, norm_factor double")
    means = regions.region_means(values, factors, placed)
    got = {(r.cell_id, r.region): r.x for r in means.collect()}
    assert got == {(1, "A"): 2.0, (1, "B"): -1.0, (1, "C"): -1.0, (2, "A"): -0.5, (2, "B"): 2.5, (2, "C"): -0.5, (3, "A"): 0.0, (3, "B"): 0.0, (3, "C"): 0.0}
    z = regions.region_zscores(means.mapInPandas(counted, means.schema))
    assert len(z.collect()) == 9 and seen.value == 9
