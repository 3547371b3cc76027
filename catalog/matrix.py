"""Normalisation, features, components, graphs, doublets, mixtures and markers (section I)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cytolake.operators import batch, doublets, graph, labels, markers, normalize, pca, qc, quantile, regions, reshape, shares
from cytolake.plans import analyses, atlas, label_maps
from cytolake.plans.presets import PRESETS
from cytolake.runtime import cut_lineage
from cytolake.schema import CELL_KEY

from . import basic, fixtures as fx
from .basic import R, VST, r6
from .fixtures import sql

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


@register("i1_log_normalize", sql(f"SELECT sample, cell_id, gene, {R('v')} FROM lognorm", "lognorm"))
def i1(s, d):
    return normalize.log_normalize(fx.counts(s, d)).select(*CELL_KEY, "gene", r6("v"))


@register("i1_log_normalize_tokens", sql(
    """SELECT sample, cell_id, gene, round(ln(1 + cnt / SUM(cnt) OVER (PARTITION BY sample, cell_id) * 10000), 6) AS v
       FROM token_counts""", "token_counts"))
def i1_tokens(s, d):
    return normalize.log_normalize(fx.token_counts(s, d)).select(*CELL_KEY, "gene", r6("v"))


@register("i2_log2_cpm", sql(
    """SELECT sample, cell_id, gene, round(log2(1 + cnt / SUM(cnt) OVER (PARTITION BY sample, cell_id) * 1000000), 6) AS v2
       FROM counts""", "counts"))
def i2(s, d):
    v = normalize.log_normalize(fx.counts(s, d), scale=1e6)
    return normalize.to_log2(v).select(*CELL_KEY, "gene", r6("v2"))


@register("i3_variable_features", sql(
    f"SELECT sample, gene, {R('mu')}, {R('var')}, {R('sd_fit')}, {R('score')} FROM scored", "counts", "per_sample", **VST))
def i3(s, d):
    scored = normalize.standardized_variance(cut_lineage(fx.counts(s, d)), fx.cells(s, d))
    return scored.select("sample", "gene", *[r6(c) for c in ("mu", "var", "sd_fit", "score")])


LOCAL = dict(
    mom=VST["mom"],
    levels="""SELECT sample, log10(mu) AS x, COUNT(*) AS w, SUM(log10(var)) AS s FROM mom WHERE mu > 0 AND var > 0 GROUP BY 1, 2""",
    sizes="""SELECT sample, least(SUM(w), greatest(3, ceil(0.3::DOUBLE * SUM(w)))) AS q FROM levels GROUP BY 1""",
    pairs="""SELECT sample, a.x, a.s / a.w AS own, b.x - a.x AS d, b.w, b.s,
         SUM(b.w) OVER (PARTITION BY sample, a.x ORDER BY abs(b.x - a.x)) AS reach FROM levels a JOIN levels b USING (sample)""",
    widths="SELECT sample, x, MIN(abs(d)) AS h FROM pairs JOIN sizes USING (sample) WHERE reach >= q GROUP BY 1, 2",
    near="""SELECT sample, x, own, w, s, d / h AS u, pow(1 - pow(abs(d / h), 3), 3) AS k FROM pairs JOIN widths USING (sample, x)
         WHERE h > 0 AND abs(d) < h""",
    sums="""SELECT sample, x, COUNT(*) AS c, SUM(w*k) AS a0, SUM(w*k*u) AS a1, SUM(w*k*u*u) AS a2, SUM(w*k*u*u*u) AS a3,
         SUM(w*k*u*u*u*u) AS a4, SUM(s*k) AS b0, SUM(s*k*u) AS b1, SUM(s*k*u*u) AS b2 FROM near GROUP BY 1, 2""",
    heights="""SELECT sample, levels.x, CASE WHEN c >= 3 THEN (b0*(a2*a4-a3*a3) - b1*(a1*a4-a2*a3) + b2*(a1*a3-a2*a2))
         / (a0*(a2*a4-a3*a3) - a1*(a1*a4-a2*a3) + a2*(a1*a3-a2*a2)) ELSE s / w END AS height FROM levels LEFT JOIN sums USING (sample, x)""",
    fit="""SELECT mom.sample, gene, n, nnz, mu, var, sqrt(pow(10, height)) AS sd_fit
         FROM mom JOIN heights ON mom.sample = heights.sample AND log10(mu) = heights.x WHERE mu > 0 AND var > 0""",
    scored=VST["scored"])


@register("i3_variable_features_loess", sql(
    f"SELECT sample, gene, {R('sd_fit')}, {R('score')} FROM scored", "counts", "per_sample", **LOCAL))
def i3_loess(s, d):
    scored = normalize.standardized_variance(cut_lineage(fx.counts(s, d)), fx.cells(s, d), "loess")
    return scored.select("sample", "gene", r6("sd_fit"), r6("score"))


CONSENSUS = dict(VST, chosen="""SELECT gene FROM ranked GROUP BY 1 ORDER BY COUNT(*) DESC, median(rk), gene LIMIT 50""")


@register("i4_scale", sql(
    """SELECT v.sample, v.cell_id, gene, round(least((v - mu) / sd, 10), 6) AS z, round(least(-mu / sd, 10), 6) AS zero_z
       FROM lognorm v JOIN (SELECT gene, s1 / n AS mu, sqrt((s2 - s1 * s1 / n) / (n - 1)) AS sd FROM
       (SELECT gene, SUM(v) AS s1, SUM(v * v) AS s2, (SELECT COUNT(*) FROM cells) AS n FROM lognorm
        WHERE gene IN (SELECT gene FROM chosen) GROUP BY 1)) USING (gene)""",
    "lognorm", "per_sample", **CONSENSUS))
def i4(s, d):
    counts, cells = cut_lineage(fx.counts(s, d)), fx.cells(s, d)
    chosen = cut_lineage(normalize.consensus_features(normalize.variable_features(counts, cells, 100), 50))
    scaled, genes = normalize.scale(normalize.log_normalize(counts), cells, chosen)
    return scaled.join(genes.select("gene", "zero_z"), "gene").select(*CELL_KEY, "gene", r6("z"), r6("zero_z"))


MARKERS = """SELECT g.gene, g.grp, n_cells, COALESCE(s, 0) / n_cells AS avg_exp, 100.0 * COALESCE(p, 0) / n_cells AS pct_exp
    FROM (SELECT grp, COUNT(*) AS n_cells, 'Brand#' || CAST(i AS VARCHAR) AS gene
          FROM cells CROSS JOIN range(1, 26) t(i) GROUP BY grp, i) g
    LEFT JOIN (SELECT gene, grp, SUM(exp(v) - 1) AS s, COUNT(*) FILTER (v > 0) AS p
               FROM brand_lognorm JOIN cells USING (sample, cell_id) GROUP BY 1, 2) USING (gene, grp)"""
SCALED = """SELECT *, CASE WHEN sd > 0 THEN greatest(-2.5, least(2.5, (ln(1 + avg_exp) - mean) / sd)) END AS avg_exp_scaled
    FROM (SELECT *, AVG(ln(1 + avg_exp)) OVER w AS mean, stddev_samp(ln(1 + avg_exp)) OVER w AS sd FROM m
          WINDOW w AS (PARTITION BY gene))"""


@register("i20_marker_summary", sql(
    f"SELECT gene, grp, n_cells, {R('avg_exp')}, {R('pct_exp')}, {R('avg_exp_scaled')} FROM z",
    "brand_lognorm", "cells", m=MARKERS, z=SCALED))
def i20(s, d):
    v = normalize.log_normalize(fx.brand_counts(s, d))
    found = markers.marker_summary(v, fx.cells(s, d), basic.BRANDS, "grp")
    return found.select("gene", "grp", "n_cells", r6("avg_exp"), r6("pct_exp"), r6("avg_exp_scaled"))


@register("i20_marker_summary_one_group", sql(
    f"SELECT gene, grp, n_cells, {R('avg_exp')}, {R('pct_exp')}, round(ln(1 + avg_exp), 6) AS avg_exp_scaled FROM m WHERE grp = 'ASIA'",
    "brand_lognorm", "cells", m=MARKERS))
def i20_one(s, d):
    v = normalize.log_normalize(fx.brand_counts(s, d))
    found = markers.marker_summary(v, fx.cells(s, d), basic.BRANDS, "grp", groups=["ASIA"])
    return found.select("gene", "grp", "n_cells", r6("avg_exp"), r6("pct_exp"), r6("avg_exp_scaled"))


@register("i21_distribution", sql(
    """SELECT metric, sample, grp, COUNT(*) AS n, MIN(value) AS v_min, round(quantile_cont(value, 0.25), 6) AS v_q1,
       round(median(value), 6) AS v_median, round(AVG(value), 6) AS v_mean, round(quantile_cont(value, 0.75), 6) AS v_q3,
       MAX(value) AS v_max FROM (UNPIVOT (SELECT sample, grp, CAST(n_count AS DOUBLE) AS n_count,
       CAST(n_feature AS DOUBLE) AS n_feature, CAST(pct_mt AS DOUBLE) AS pct_mt FROM described)
       ON n_count, n_feature, pct_mt INTO NAME metric VALUE value) GROUP BY 1, 2, 3""", "described"))
def i21(s, d):
    found = qc.distribution(basic.described(s, d), ["n_count", "n_feature", "pct_mt"], ["sample", "grp"])
    return found.select("metric", "sample", "grp", "n", "v_min", r6("v_q1"), r6("v_median"), r6("v_mean"),
                        r6("v_q3"), "v_max")


# ---- components

def scaled_parts(s, d):
    counts = cut_lineage(fx.counts(s, d))
    cells = cut_lineage(qc.cell_metrics(counts))
    ranked = normalize.variable_features(counts, cells, 2000)
    chosen = cut_lineage(normalize.consensus_features(ranked, 200))
    v = normalize.log_normalize(counts, cells)
    return *normalize.scale(v, cells, chosen), cells


@register("i5_pca")
def i5(s, d):
    scaled, genes, cells = scaled_parts(s, d)
    embedding, _, _ = pca.fit(scaled, genes, cells, 20)
    return embedding.select(*CELL_KEY, F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@register("i6_component_sdev", sql(
    "SELECT i AS pc, round(stddev_samp(vec[i]), 6) AS sdev FROM vectors, range(1, 65) t(i) GROUP BY 1", "vectors"))
def i6(s, d):
    return pca.component_sdev(fx.vectors(s, d)).select("pc", r6("sdev"))


@register("i7_batch_correction")
def i7(s, d):
    fixed = batch.harmony(fx.vectors(s, d), ["batch"], lam=1.0)
    return fixed.select("cell_id", "batch", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@register("i7_correction_round", sql(
    """SELECT r.cell_id, r.batch, list(round(r.vec[i] - c, 6) ORDER BY i) AS vec FROM (SELECT cell_id, i, SUM(r * beta) AS c FROM r JOIN betas
       ON r.batch IS NOT DISTINCT FROM betas.batch AND r.k = betas.k GROUP BY 1, 2) JOIN r USING (cell_id) WHERE r.k = 1 GROUP BY 1, 2""", "vectors",
    units="SELECT *, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS u FROM vectors",
    centres="SELECT row_number() OVER (ORDER BY cell_id) AS k, u AS y FROM units ORDER BY cell_id LIMIT 3",
    e="SELECT cell_id, batch, vec, k, -20 * (1 - list_dot_product(u, y)) AS e FROM units, centres",
    p="SELECT *, exp(e - MAX(e) OVER (PARTITION BY cell_id)) AS p FROM e",
    r="SELECT *, p / SUM(p) OVER (PARTITION BY cell_id) AS r FROM p",
    sums="SELECT batch, k, i, SUM(r) AS o, SUM(r * vec[i]) AS t FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS i FROM r) GROUP BY 1, 2, 3",
    bases="SELECT k, i, (SUM(t) - SUM(o / (o + 1) * t)) / greatest(SUM(o) - SUM(o * o / (o + 1)), 1e-12) AS base FROM sums GROUP BY 1, 2",
    betas="SELECT batch, k, i, (t - o * base) / (o + 1) AS beta FROM sums JOIN bases USING (k, i)"))
def i7_round(s, d):
    """One round from given centres: memberships, corrections, corrected vectors."""
    vectors = fx.vectors(s, d)
    first = [r.vec for r in vectors.orderBy("cell_id").select("cell_id", "vec").limit(3).collect()]
    fixed = batch.harmony(vectors, ["batch"], lam=1.0, max_rounds=1, cluster_rounds=1, centres=first)
    return fixed.select("cell_id", "batch", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


# ---- graphs over the embedding vectors

def brute(points: str, k: str, by: str = "sample") -> dict:
    """SQL form of the exact k nearest neighbours, by (distance, id)."""
    return dict(pairs=f"""SELECT a.{by}, a.cell_id AS i, b.cell_id AS j,
            round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d2
            FROM {points} a JOIN {points} b USING ({by})""",
                near=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}, i ORDER BY d2, j) AS rk FROM pairs)
            WHERE rk <= {k}""")


def neighbours(s, d, k=20):
    return graph.knn(fx.vectors(s, d), k)


@register("i8_knn", sql("SELECT i, rk, j, round(d2, 6) AS d2 FROM near", "vectors", **brute("vectors", "20")))
def i8(s, d):
    return neighbours(s, d).select("i", "rk", "j", r6("d2"))


@register("e8_similarity_join", sql("SELECT i, COUNT(*) AS k, round(MAX(d2), 6) AS reach FROM near GROUP BY 1", "vectors", **brute("vectors", "30")))
def e8(s, d):
    return neighbours(s, d, 30).groupBy("i").agg(F.count(F.lit(1)).alias("k"), F.round(F.max("d2"), 6).alias("reach"))


@register("i8_knn_probed", sql("SELECT cell_id AS i, least(20, COUNT(*) OVER ()) AS n, TRUE AS recalled FROM vectors", "vectors"))
def i8_probed(s, d):
    """Length of every point's list, and whether all lists together hold 0.9 of the nearest neighbours."""
    near = cut_lineage(graph.knn(fx.vectors(s, d), 20, probe=8, pivot_rows=256).select("i", "j"))
    both = neighbours(s, d).select("i", "j").join(near.withColumn("hit", F.lit(1)), ["i", "j"], "left")
    recall = both.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled"))
    return near.groupBy("i").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(recall))     # one row


SNN = dict(brute("vectors", "20"), edges="""SELECT src, dst, s / (40.0 - s) AS w FROM
    (SELECT x.i AS src, y.i AS dst, COUNT(*) AS s FROM near x JOIN near y ON x.j = y.j AND x.i < y.i GROUP BY 1, 2)
    WHERE s / (40.0 - s) >= 1.0 / 15""")


@register("i9_snn_graph", sql("SELECT src, dst, round(w, 6) AS w FROM edges", "vectors", **SNN))
def i9(s, d):
    members, edges = graph.snn(neighbours(s, d), 20, by=["sample"], loops=True)
    return graph.between_cells(members, edges, ["sample"]).select("src", "dst", r6("w"))


@register("i10_modularity", sql(
    """SELECT round(SUM(ins) / SUM(tot) - SUM(tot * tot) / (SUM(tot) * SUM(tot)), 6) AS q FROM
       (SELECT a.batch, SUM(CASE WHEN a.batch = b.batch THEN w ELSE 0 END) AS ins, SUM(w) AS tot FROM
        (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges) e
        JOIN vectors a ON a.cell_id = e.src JOIN vectors b ON b.cell_id = e.dst GROUP BY 1)""", "vectors", **SNN))
def i10_q(s, d):
    members, edges = graph.snn(neighbours(s, d), 20, by=["sample"], loops=True)
    labelled = fx.vectors(s, d).select(F.col("cell_id").alias("node"), F.col("batch").alias("cluster"))
    return graph.modularity(edges, labelled, members=members).select(r6("q"))


@register("i10_communities")
def i10(s, d):
    members, edges = graph.snn(neighbours(s, d), 20, by=["sample"])
    return graph.communities(members, edges, [0.5, 1.0], ["sample"]).select("cell", "resolution", "cluster")


def region_levels(s, d):
    """Region and nation as the labels of two resolutions."""
    c = fx.cells(s, d)
    coarse = labels.nth_level(c, "grp").select(F.col("cell_id").alias("cell"), F.lit(0.1).alias("resolution"),
                                               F.col("level").alias("cluster"))
    return coarse.unionByName(c.select(F.col("cell_id").alias("cell"), F.lit(0.3).alias("resolution"), "cluster"))


@register("i11_resolution_tree", sql(
    """SELECT CAST(0.1 AS DOUBLE) AS from_resolution, g AS from_cluster, CAST(0.3 AS DOUBLE) AS to_resolution, cluster AS to_cluster, n,
       round(n / SUM(n) OVER (PARTITION BY cluster), 6) AS in_prop FROM
       (SELECT g, cluster, COUNT(*) AS n FROM (SELECT *, dense_rank() OVER (ORDER BY grp) AS g FROM cells) GROUP BY 1, 2)""",
    "cells"))
def i11(s, d):
    edges, _ = graph.resolution_tree(region_levels(s, d))
    return edges.withColumn("in_prop", F.round("in_prop", 6))


@register("i11_tree_nodes", sql(
    """SELECT resolution, cluster, COUNT(*) AS size, round(AVG(COALESCE(n_count, 0)), 6) AS mean_v FROM
       (SELECT cell_id, CAST(0.1 AS DOUBLE) AS resolution, dense_rank() OVER (ORDER BY grp) AS cluster FROM cells
        UNION ALL SELECT cell_id, 0.3, cluster FROM cells) LEFT JOIN metrics USING (cell_id) GROUP BY 1, 2""",
    "cells", "metrics"))
def i11_nodes(s, d):
    marker = basic.metrics(s, d).select(F.col("cell_id").alias("cell"), F.col("n_count").alias("v"))
    _, nodes = graph.resolution_tree(region_levels(s, d), marker)
    return nodes.withColumn("mean_v", F.round("mean_v", 6))


# ---- doublets

@register("i12_doublet_scores")
def i12(s, d):
    return scored_cells(s, d).withColumn("scrublet_score", F.round("scrublet_score", 6))


def scored_cells(s, d):
    counts = cut_lineage(fx.counts(s, d))
    cells = cut_lineage(qc.cell_metrics(counts))
    return doublets.doublet_scores(counts, cells, qc.expected_doublet_rate(cells))


STAGED = dict(brute("vectors", "21"),
              seen="""SELECT i, CAST(SUM(CASE WHEN b.batch >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS k_sim FROM near
              JOIN vectors b ON b.cell_id = j JOIN vectors a ON a.cell_id = i WHERE i <> j AND a.batch < 5 GROUP BY 1""",
              ratio="""SELECT COUNT(*) FILTER (batch >= 5) / COUNT(*) FILTER (batch < 5) AS r FROM vectors""",
              scores="""SELECT i, k_sim, (k_sim + 1) / 22.0 * 0.06 / r /
              (1 - 0.06 - (k_sim + 1) / 22.0 * (1 - 0.06 - 0.06 / r)) AS score FROM seen, ratio""")


def staged_scores(s, d):
    """Embedding vectors with half of the labels taken as synthetic doublets."""
    points = fx.vectors(s, d).select("sample", F.col("cell_id").alias("id"), (F.col("batch") >= 5).alias("is_sim"), "vec")
    near = graph.knn(points.withColumn("_real", ~F.col("is_sim")), 21, key="id", ask="_real")
    seen = doublets.synthetic_neighbours(near, points, ["sample"])
    n = points.groupBy("sample").agg((F.count_if("is_sim") / F.count_if(~F.col("is_sim"))).alias("r"))
    return seen.join(n, "sample").select("i", "k_sim", doublets.score_from_counts(
        F.col("k_sim"), F.col("k"), F.col("r"), F.lit(0.06)).alias("score"))


@register("i12_score_from_neighbours", sql("SELECT i, k_sim, round(score, 6) AS score FROM scores", "vectors", **STAGED))
def i12_staged(s, d):
    return staged_scores(s, d).withColumn("score", F.round("score", 6))


@register("d2_low_scores", sql("SELECT i, k_sim FROM scores WHERE round(score, 9) < 0.03", "vectors", **STAGED))
def d2(s, d):
    return doublets.keep_low_scores(staged_scores(s, d).withColumn("score", F.round("score", 9)), 0.03, "score").select("i", "k_sim")


@register("i13_doublet_classes")
def i13(s, d):
    return classified(s, d).withColumn("pann", F.round("pann", 6))


def classified(s, d):
    counts = cut_lineage(fx.counts(s, d))
    cells = cut_lineage(qc.cell_metrics(counts))
    return doublets.classify(counts, cells)


P_KS = ", ".join(f"({p})" for p in doublets.P_KS)
SHARES = dict(
    mixed="""SELECT p_n, cell_id, vec, batch >= 7 AS is_sim FROM vectors, (VALUES (0.1, 9), (0.2, 8), (0.3, 7)) t(p_n, least_batch)
             WHERE batch < 7 OR batch >= least_batch""",
    sizes="SELECT p_n, COUNT(*) AS n FROM mixed GROUP BY 1",
    **brute("mixed", "2000000000", "p_n"),
    others="""SELECT p_n, i, j, row_number() OVER (PARTITION BY p_n, i ORDER BY rk) AS rk FROM near WHERE i <> j""",
    upto="""SELECT o.p_n, o.i, rk, SUM(CASE WHEN b.is_sim THEN 1 ELSE 0 END) OVER (PARTITION BY o.p_n, o.i ORDER BY rk) AS fakes FROM others o
            JOIN mixed a ON a.p_n = o.p_n AND a.cell_id = o.i AND NOT a.is_sim JOIN mixed b ON b.p_n = o.p_n AND b.cell_id = o.j""",
    shares=f"""SELECT p_n, p_k, i, fakes / rk AS pann FROM upto JOIN (SELECT p_n, CAST(p_k AS DOUBLE) AS p_k,
              least(n - 1, greatest(1, round_even(CAST(p_k AS DOUBLE) * n, 0))) AS rk FROM sizes, (VALUES {P_KS}) t(p_k)) USING (p_n, rk)""")


def staged_shares(s, d):
    """Real cells = seven labels; growing sets of the other labels taken as artificial cells."""
    points = fx.vectors(s, d).select("sample", F.col("cell_id").alias("id"), "vec", (F.col("batch") >= 7).alias("is_sim"), (9 - F.col("batch")).alias("enters"))
    return shares.near_shares(points, [0.1, 0.2, 0.3], doublets.P_KS)


@register("i15_artificial_share", sql(
    "SELECT CAST(p_n AS DOUBLE) AS p_n, p_k, i, round(pann, 6) AS pann FROM shares", "vectors", **SHARES))
def i15(s, d):
    return staged_shares(s, d).select("p_n", "p_k", "i", r6("pann"))


DENSITY = dict(
    SHARES,
    stat="""SELECT *, lo - 4 * h AS a, (hi - lo + 8 * h) / 400 AS step FROM (SELECT p_n, p_k, COUNT(*) AS n, MIN(pann) AS lo, MAX(pann) AS hi,
            pow(1 / (4 * pi()), 0.1) * pow(243 / (35.0 * COUNT(*)), 0.2) * stddev_samp(pann) AS h FROM shares GROUP BY 1, 2) WHERE h > 0""",
    placed="SELECT p_n, p_k, (pann - a) / step AS at_ FROM shares JOIN stat USING (p_n, p_k)",
    bins="""SELECT p_n, p_k, b, SUM(w) AS w FROM (SELECT p_n, p_k, floor(at_) AS b, 1 - (at_ - floor(at_)) AS w FROM placed UNION ALL
            SELECT p_n, p_k, floor(at_) + 1, at_ - floor(at_) FROM placed) GROUP BY 1, 2, 3""",
    heights="""SELECT p_n, p_k, t.i AS g, SUM(CASE WHEN abs(t.i - b) <= floor(4 * h / step) THEN w * exp(-pow((t.i - b) * step / h, 2) / 2) ELSE 0 END) AS y
               FROM stat JOIN bins USING (p_n, p_k), range(401) t(i) GROUP BY 1, 2, 3""",
    seen="""SELECT p_n, p_k, floor(at_) AS g, at_ - floor(at_) AS f FROM (SELECT p_n, p_k, (lo + (hi - lo) * m / (n - 1) - a) / step AS at_ FROM
            (SELECT *, unnest(generate_series(0, n - 1)) AS m FROM stat))""",
    curve="""SELECT s.p_n, s.p_k, x.y + f * (z.y - x.y) AS y FROM seen s JOIN heights x ON x.p_n = s.p_n AND x.p_k = s.p_k AND x.g = s.g
             JOIN heights z ON z.p_n = s.p_n AND z.p_k = s.p_k AND z.g = s.g + 1""")


@register("i14_neighbourhood_sweep", sql(
    """SELECT p_k, round(AVG(bc), 6) AS mean_bc, round(var_samp(bc), 9) AS var_bc FROM (SELECT DISTINCT p_k, p_n FROM shares) LEFT JOIN
       (SELECT p_n, p_k, (pow(skewness(y), 2) + 1) / (kurtosis(y) + 3 * pow(COUNT(*) - 1, 2) /
        ((COUNT(*) - 2.0) * (COUNT(*) - 3))) AS bc FROM curve GROUP BY 1, 2) USING (p_n, p_k) GROUP BY 1""", "vectors", **DENSITY))
def i14(s, d):
    found = shares.sweep(cut_lineage(staged_shares(s, d)), ["sample"])
    return found.select("p_k", r6("mean_bc"), F.round("var_bc", 9).alias("var_bc"))


LABELLED = dict(
    hom="""SELECT sample, n, SUM((k / n) * (k / n)) AS h FROM (SELECT sample, cluster, COUNT(*) AS k FROM cells GROUP BY 1, 2)
           JOIN per_sample USING (sample) GROUP BY 1, 2""",
    expect="SELECT sample, round_even(round_even(0.08 * n, 0) * (1 - h), 0) AS n_exp FROM hom",
    ranks="SELECT *, row_number() OVER (PARTITION BY sample ORDER BY pct_mt DESC, cell_id) AS rk FROM metrics",
    classes="""SELECT sample, cell_id, CASE WHEN rk <= n_exp THEN 'Doublet' ELSE 'Singlet' END AS doublet_finder
           FROM ranks JOIN expect USING (sample)""")


def labelled(s, d):
    """The feature share stands in for the doublet share; labelling and rounding are what is checked."""
    n_exp = doublets.expected_doublets(fx.cells(s, d), "cluster", 0.08)
    return doublets.label_top(basic.metrics(s, d), "pct_mt", n_exp).select(*CELL_KEY, "doublet_finder")


@register("g3_label_top", sql("SELECT * FROM classes", "metrics", "cells", "per_sample", **LABELLED))
def g3(s, d):
    return labelled(s, d)


@register("d3_singlets", sql("SELECT sample, cell_id FROM classes WHERE doublet_finder = 'Singlet'",
                             "metrics", "cells", "per_sample", **LABELLED))
def d3(s, d):
    return doublets.keep_singlets(labelled(s, d)).select(*CELL_KEY)


# ---- regions

def region_posteriors(s, d):
    return regions.region_mixture(regions.region_zscores(basic.region_means(s, d)))


@register("i16_region_zscores", sql(
    """SELECT sample, cell_id, region, round((x - AVG(x) OVER w) / stddev_samp(x) OVER w, 6) AS x FROM means
       WINDOW w AS (PARTITION BY region)""", "lognorm", "genes", "regions", **basic.REGION_MEANS))
def i16_z(s, d):
    return regions.region_zscores(basic.region_means(s, d)).select(*CELL_KEY, "region", r6("x"))


@register("i16_region_mixture")
def i16(s, d):
    models, _ = region_posteriors(s, d)
    return models.select("region", "n", *[r6(c) for c in ("p2", "m1", "m2", "v1", "v2", "delta_bic")])


def _mixture_rounds(rounds: int) -> dict[str, str]:
    """Plain rounds from the quartiles, one view each."""
    floor, views = "greatest(v * 1e-3, 1e-9)", {}
    views["zs"] = "SELECT region, (x - AVG(x) OVER w) / stddev_samp(x) OVER w AS x FROM means WINDOW w AS (PARTITION BY region)"
    views["p0"] = """SELECT region, COUNT(*) AS n, var_samp(x) AS v, 0.5::DOUBLE AS p2, quantile_disc(x, 0.25) AS m1, quantile_disc(x, 0.75) AS m2,
        greatest(var_samp(x), 1e-9) AS v1, greatest(var_samp(x), 1e-9) AS v2, 0.0::DOUBLE AS ll FROM zs GROUP BY 1"""
    for i in range(rounds):
        views[f"d{i}"] = f"""SELECT *, ln(1 - p2) - (x - m1) * (x - m1) / (2 * v1) - ln(2 * pi() * v1) / 2 AS a,
            ln(p2) - (x - m2) * (x - m2) / (2 * v2) - ln(2 * pi() * v2) / 2 AS b FROM zs JOIN p{i} USING (region)"""
        views[f"p{i + 1}"] = f"""SELECT region, n, v, w2 / n AS p2, s1 / w1 AS m1, s2 / w2 AS m2, greatest(q1 / w1 - pow(s1 / w1, 2), {floor}) AS v1,
            greatest(q2 / w2 - pow(s2 / w2, 2), {floor}) AS v2, ll FROM (SELECT region, n, v, SUM(r) AS w2, SUM(r * x) AS s2, SUM(r * x * x) AS q2,
            SUM(1 - r) AS w1, SUM((1 - r) * x) AS s1, SUM((1 - r) * x * x) AS q1, SUM(greatest(a, b) + ln(1 + exp(-abs(a - b)))) AS ll
            FROM (SELECT *, 1 / (1 + exp(least(a - b, 700))) AS r FROM d{i}) GROUP BY 1, 2, 3)"""
    return views


@register("i16_mixture_rounds", sql(
    "SELECT region, n, " + ", ".join(R(c) for c in ("p2", "m1", "m2", "v1", "v2", "ll")) + " FROM p3",
    "lognorm", "genes", "regions", **basic.REGION_MEANS, **_mixture_rounds(3)))
def i16_rounds(s, d):
    models, _ = regions.region_mixture(regions.region_zscores(basic.region_means(s, d)), rounds=3)
    return models.select("region", F.col("n").cast("bigint").alias("n"), *[r6(c) for c in ("p2", "m1", "m2", "v1", "v2")],
                         F.round(F.element_at("ll_path", -1), 6).alias("ll"))


ARMS = ["Brand#7p", "Brand#7q", "Brand#10p", "Brand#10q", "Brand#22q"]


@register("i17_profile_clusters")
def i17(s, d):
    _, posteriors = region_posteriors(s, d)
    return regions.profile_clusters(regions.profile_scores(posteriors, ARMS), ARMS)


@register("i17_profile_scores", sql(
    """SELECT sample, cell_id, """ + ", ".join(
        f"""round(MAX(z) FILTER (region = '{a}'), 6) AS "{a}" """ for a in ARMS) + """ FROM (SELECT sample, cell_id, region,
        greatest(-4, least(4, (x - AVG(x) OVER w) / stddev_samp(x) OVER w)) AS z FROM means WINDOW w AS (PARTITION BY region))
        GROUP BY 1, 2""", "lognorm", "genes", "regions", **basic.REGION_MEANS))
def i17_scores(s, d):
    means = basic.region_means(s, d).withColumnRenamed("x", "posterior")
    found = regions.profile_scores(means, ARMS)
    return found.select(*CELL_KEY, *[F.round(F.col(f"`{a}`"), 6).alias(a) for a in ARMS])


def _values(columns):
    return "[" + ", ".join(f'"{c}"' for c in columns) + "]"


@register("i17_profile_cut", sql(
    """SELECT sample, cell_id, profile FROM homes JOIN named USING (id) JOIN ranked USING (c)""", "lognorm", "genes", "regions", **basic.REGION_MEANS,
    profiles="SELECT sample, cell_id, " + ", ".join(f"""round(MAX(z) FILTER (region = '{a}'), 6) + 0.0 AS "{a}" """ for a in ARMS) + """
        FROM (SELECT sample, cell_id, region, greatest(-4, least(4, (x - AVG(x) OVER w) / stddev_samp(x) OVER w)) AS z FROM means
        WINDOW w AS (PARTITION BY region)) GROUP BY 1, 2""",
    vecs=f"SELECT sample, cell_id, {_values(ARMS)} AS v FROM profiles",
    span="SELECT MIN(list_min(v)) AS lo, (MAX(list_max(v)) - MIN(list_min(v))) / 4096 AS width FROM vecs",
    keyed="""SELECT sample, cell_id, v, l, CASE WHEN l = 0 THEN v::VARCHAR ELSE
        list_transform(v, lambda x: least(floor((x - lo) / width), 4095)::BIGINT >> (l - 1))::VARCHAR END AS leaf FROM vecs, span, range(14) t(l)""",
    level="SELECT MIN(l) AS l FROM (SELECT l FROM keyed GROUP BY 1 HAVING COUNT(DISTINCT leaf) <= 2048)",
    leaves="""SELECT *, row_number() OVER (ORDER BY m) AS id FROM (SELECT leaf, ["""
        + ", ".join(f"AVG(v[{i + 1}])" for i in range(len(ARMS))) + """] AS m FROM keyed JOIN level USING (l) GROUP BY 1)""",
    homes="SELECT sample, cell_id, v, id FROM keyed JOIN level USING (l) JOIN leaves USING (leaf)",
    gaps="SELECT a.id AS i, b.id AS j, round(list_distance(a.m, b.m), 9) AS d FROM leaves a JOIN leaves b ON a.id <> b.id",
    walk="""SELECT 0 AS turn, id, id AS c, 0.0::DOUBLE AS h, 0 AS made FROM leaves UNION ALL
        SELECT w.turn + 1, w.id, COALESCE(m.low, w.c), COALESCE(m.h, w.h), CASE WHEN m.low IS NULL THEN w.made ELSE w.turn + 1 END FROM walk w LEFT JOIN (
        SELECT unnest([low, high]) AS x, low, h FROM (SELECT least(c, n) AS low, greatest(c, n) AS high, MIN(d) AS h FROM (
        SELECT c, n, d FROM (SELECT a.c AS c, b.c AS n, MAX(d) AS d FROM gaps JOIN walk a ON i = a.id JOIN walk b ON j = b.id WHERE a.c <> b.c GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY c ORDER BY d, n) = 1) GROUP BY 1, 2 HAVING COUNT(*) = 2)) m ON m.x = w.c
        WHERE (SELECT MIN(c) < MAX(c) FROM walk)""",
    undone="SELECT DISTINCT c, h, made FROM walk WHERE made > 0 ORDER BY h DESC, made DESC, c DESC LIMIT 3",
    named="""SELECT id, arg_max(w.c, w.made) AS c FROM walk w LEFT JOIN undone u ON w.c = u.c AND w.made = u.made
        WHERE u.c IS NULL GROUP BY 1""",
    ranked="""SELECT c, row_number() OVER (ORDER BY AVG(list_sum(list_transform(v, lambda x: abs(x)))), c) AS profile
        FROM homes JOIN named USING (id) GROUP BY 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def i17_cut(s, d):
    """Cut of given scores, so that it can be held against SQL."""
    return regions.profile_clusters(i17_scores(s, d), ARMS)


@register("h12_binary_call", sql(
    "SELECT sample, cell_id, cluster AS profile, CASE WHEN cluster = 1 THEN 'normal' ELSE 'tumor' END AS cand_tumor FROM cells", "cells"))
def h12(s, d):
    return regions.malignant_call(fx.cells(s, d).select(*CELL_KEY, F.col("cluster").alias("profile")))


# ---- Poisson-lognormal

MUS, SIGMAS, MU_GRID = [-6.0, -5.0, -4.0, -3.0, -2.0], [1.0, 1.6, 2.2, 2.8, 3.4], [round(-16 + 0.4 * i, 1) for i in range(41)]
NODES = """SELECT t, exp(-t * t / 2) / SUM(exp(-t * t / 2)) OVER () AS w FROM (SELECT (i - 800) / 100.0 AS t FROM range(1601) r(i))"""
FITS = dict(
    ng="SELECT COUNT(*) AS g FROM genes",
    held="""SELECT sample, cell_id, cnt, COUNT(*) AS n FROM counts GROUP BY 1, 2, 3 UNION ALL
            SELECT sample, cell_id, 0, g - COUNT(*) FROM counts, ng GROUP BY 1, 2, g""",
    nodes=NODES,
    lik="""SELECT cnt, mu, sigma, ln(greatest(SUM(w * exp(cnt * (mu + sigma * t) - exp(mu + sigma * t) - lgamma(cnt + 1.0))), 1e-300)) AS lp
           FROM (SELECT DISTINCT cnt FROM held), (SELECT unnest([-6.0, -5.0, -4.0, -3.0, -2.0])::DOUBLE AS mu),
           (SELECT unnest([1.0, 1.6, 2.2, 2.8, 3.4])::DOUBLE AS sigma), nodes GROUP BY 1, 2, 3""",
    ll="SELECT sample, cell_id, mu, sigma, SUM(n * lp) AS ll FROM held JOIN lik USING (cnt) GROUP BY 1, 2, 3, 4")


def n_parts(s, d):
    return fx.genes(s, d).count()


@register("i18_poisson_lognormal_fit", sql(
    """SELECT sample, cell_id, mu, sigma, round(ll, 4) AS ll FROM (SELECT *, row_number() OVER (PARTITION BY sample, cell_id
       ORDER BY round(ll, 6) DESC, mu DESC, sigma DESC) AS r FROM ll) WHERE r = 1""", "counts", "genes", **FITS))
def i18(s, d):
    found = quantile.fit_poisson_lognormal(fx.counts(s, d), n_parts(s, d), MUS, SIGMAS)
    return found.withColumn("ll", F.round("ll", 4))


@register("i18_poisson_lognormal_maximum", sql(
    """SELECT sample, cell_id, round(max(ll), 4) AS grid_ll, TRUE AS not_below, TRUE AS flat FROM ll GROUP BY 1, 2""", "counts", "genes", **FITS))
def i18_maximum(s, d):
    """Newton's maximum of every cell: never below the grid's, and without slope."""
    found = quantile.fit_poisson_lognormal(fx.counts(s, d), n_parts(s, d), MUS, SIGMAS, refine=True)
    return found.select(*CELL_KEY, F.round("grid_ll", 4).alias("grid_ll"), (F.col("ll") >= F.col("grid_ll")).alias("not_below"), (F.col("slope") < 1e-6).alias("flat"))


NARROW = {f"s{k + 1}": f"""SELECT nnz, p0, MAX(lo + i * width / 256) AS lo, ANY_VALUE(width) / 256 AS width FROM (
          SELECT nnz, p0, lo, width, i, SUM(w * exp(-exp(lo + i * width / 256 + 2.2 * t))) AS zero FROM s{k}, range(257) r(i), nodes GROUP BY ALL)
          WHERE zero >= p0 GROUP BY 1, 2""" for k in range(4)}


@register("i19_quasi_counts_fitted", sql(
    """SELECT p.sample, p.cell_id, p.gene, p.cnt, round(c.mu, 5) AS mu, MIN(c.y) AS qumi FROM placed p JOIN cdf c USING (nnz)
       WHERE c.cdf >= c.zero + p.u * (1 - c.zero) AND c.y >= 1 GROUP BY 1, 2, 3, 4, 5""", "counts", "genes",
    nodes=NODES,
    placed="""SELECT *, COUNT(*) OVER (PARTITION BY sample, cell_id) AS nnz,
           COUNT(*) OVER (PARTITION BY sample, cell_id ORDER BY cnt RANGE UNBOUNDED PRECEDING) / (COUNT(*) OVER (PARTITION BY sample, cell_id) + 1.0) AS u
           FROM counts""",
    s0="""SELECT DISTINCT nnz, greatest(1 - nnz / (SELECT COUNT(*) FROM genes), 0.5 / (SELECT COUNT(*) FROM genes)) AS p0,
          -60.0::DOUBLE AS lo, 120.0::DOUBLE AS width FROM placed""",
    **NARROW,
    pmf="""SELECT nnz, lo AS mu, y, SUM(w * exp(y * (lo + 2.2 * t) - exp(lo + 2.2 * t) - lgamma(y + 1.0))) AS p
           FROM s4, (SELECT i::BIGINT AS y FROM range(601) q(i)), nodes GROUP BY 1, 2, 3""",
    cdf="SELECT nnz, mu, y, SUM(p) OVER (PARTITION BY nnz ORDER BY y) AS cdf, FIRST_VALUE(p) OVER (PARTITION BY nnz ORDER BY y) AS zero FROM pmf"))
def i19_fitted(s, d):
    """Every cell's own scale instead of one of a list."""
    return quantile.quasi_counts(fx.counts(s, d), n_parts(s, d), value="cnt").withColumn("mu", F.round("mu", 5))


@register("i19_quasi_counts", sql(
    """SELECT p.sample, p.cell_id, p.gene, p.cnt, c.mu, MIN(c.y) AS qumi FROM placed p JOIN chosen c USING (sample, cell_id)
       WHERE c.cdf >= c.zero + p.u * (1 - c.zero) AND c.y >= 1 GROUP BY 1, 2, 3, 4, 5""", "counts", "genes",
    nodes=NODES,
    pmf="""SELECT mu, y, SUM(w * exp(y * (mu + 2.2 * t) - exp(mu + 2.2 * t) - lgamma(y + 1.0))) AS p
           FROM (SELECT round(-16 + 0.4 * i, 1)::DOUBLE AS mu FROM range(41) r(i)), (SELECT i::BIGINT AS y FROM range(401) q(i)), nodes GROUP BY 1, 2""",
    cdf="SELECT mu, y, SUM(p) OVER (PARTITION BY mu ORDER BY y) AS cdf FROM pmf",
    placed="""SELECT *, 1 - nnz / (SELECT COUNT(*) FROM genes) AS p0 FROM (SELECT *, COUNT(*) OVER (PARTITION BY sample, cell_id) AS nnz,
           COUNT(*) OVER (PARTITION BY sample, cell_id ORDER BY cnt RANGE UNBOUNDED PRECEDING) / (COUNT(*) OVER (PARTITION BY sample, cell_id) + 1.0) AS u
           FROM counts)""",
    scale="""SELECT sample, cell_id, MAX(mu) AS mu FROM (SELECT DISTINCT sample, cell_id, p0 FROM placed)
           JOIN (SELECT mu, cdf AS zero FROM cdf WHERE y = 0) ON zero >= p0 GROUP BY 1, 2""",
    chosen="""SELECT sample, cell_id, mu, y, cdf, FIRST_VALUE(cdf) OVER (PARTITION BY sample, cell_id ORDER BY y) AS zero
           FROM scale JOIN cdf USING (mu)"""))
def i19(s, d):
    return quantile.quasi_counts(fx.counts(s, d), n_parts(s, d), value="cnt", mus=MU_GRID)


# ---- whole analyses

KINDS = dict(joint="""SELECT 'buyer_' || CAST(cell_id AS VARCHAR) AS cell, gene, cnt FROM brand_counts UNION ALL
    SELECT 'seller_' || CAST(l_suppkey AS VARCHAR), p_brand, CAST(SUM(l_quantity) AS BIGINT) FROM lineitem
    JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    who="""SELECT 'buyer_' || CAST(cell_id AS VARCHAR) AS cell, 'buyer' AS kind, grp FROM cells UNION ALL
    SELECT 'seller_' || CAST(s_suppkey AS VARCHAR), 'seller', r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""",
    shown="SELECT cell, COALESCE(CASE WHEN grp <> 'ASIA' THEN grp END, 'NA') || '_' || kind AS key FROM who",
    logs="SELECT cell, gene, ln(1 + cnt / SUM(cnt) OVER (PARTITION BY cell) * 10000) AS v FROM joint",
    held="SELECT key, COUNT(*) AS n_cells FROM shown GROUP BY 1",
    sums="SELECT gene, key, SUM(exp(v) - 1) AS s, COUNT(*) AS p FROM logs JOIN shown USING (cell) GROUP BY 1, 2")


@register("marker_figure", sql(
    """SELECT h.key, split_part(h.key, '_', 1) AS grp, split_part(h.key, '_', 2) AS kind, b.gene, n_cells,
       round(COALESCE(s, 0) / n_cells, 6) AS avg_exp, round(100.0 * COALESCE(p, 0) / n_cells, 6) AS pct_exp FROM held h
       CROSS JOIN (SELECT 'Brand#' || CAST(i AS VARCHAR) AS gene FROM range(1, 26) t(i)) b
       LEFT JOIN sums USING (key, gene)""", "brand_counts", "cells", **KINDS))
def marker_figure(s, d):
    """Two datasets united, their groups pasted into one key with an emptied level, summarised, split again."""
    part = fx.table(s, d, "part").select("p_partkey", "p_brand")
    sold = fx.table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sellers = sold.groupBy(F.lit("-").alias("sample"), F.col("l_suppkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(
        F.sum("l_quantity").cast("bigint").alias("cnt"))
    who = (fx.table(s, d, "supplier").join(fx.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(fx.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.lit("-").alias("sample"), F.col("s_suppkey").alias("cell_id"), F.lit("seller").alias("kind"), F.col("r_name").alias("grp")))
    buyers = fx.cells(s, d).select(*CELL_KEY, F.lit("buyer").alias("kind"), "grp")
    found = analyses.marker_figure(
        {"buyer": (fx.brand_counts(s, d), buyers), "seller": (sellers, who)}, basic.BRANDS, ["grp", "kind"],
        {"grp": ["EUROPE", "AMERICA", "AFRICA", "MIDDLE EAST"]})
    return found.select(F.col("_key").alias("key"), "grp", "kind", "gene", "n_cells", r6("avg_exp"), r6("pct_exp"))


SETS = ["pa", "thyroid", "lung", "pancreas", "colon", "ovary", "mpnst", "skin", "hgg", "gbm_astrocytoma"]
OTHER_SAMPLES = {"pa": ["PA_c", "PA_a", "PA_b"], "hgg": ["DIPG", "GBM", "Adjacent"], "gbm_astrocytoma": ["Astrocytoma", "GBM_1"]}
# names and IDs written out or by rule, for the SQL alone
SAMPLES_SQL = """SELECT 0 AS ds, i - 1 AS i, s AS sample, id FROM (SELECT unnest(['PA_c', 'PA_a', 'PA_b']) AS s,
    unnest(['Tumor_Brain3', 'Tumor_Brain1', 'Tumor_Brain2']) AS id, unnest([1, 2, 3]) AS i)
    UNION ALL SELECT 1, i - 1, s, CASE WHEN i <= 12 THEN 'Tumor_Thyroid' || i ELSE 'Normal_Thyroid' || (i - 12) END FROM (SELECT unnest(['PT3', 'PT5', 'PT7',
    'PT8', 'PT9', 'PT10', 'PT12', 'AT9', 'AT13', 'AT16', 'AT17', 'AT20', 'Thy05', 'Thy06', 'N3-GEX']) AS s, unnest(range(1, 16)) AS i)
    UNION ALL SELECT 2, i - 1, s, CASE WHEN i <= 11 THEN 'Tumor_Lung' || i ELSE 'Normal_Lung' || (i - 11) END FROM (SELECT unnest(['P1_TI', 'P1_TM', 'P2_TI',
    'P2_TM', 'P3_TI1', 'P3_TI2', 'P3_TM1', 'P3_TM2', 'P4_TI', 'P4_TS1', 'P4_TS2', 'P1_NI', 'P1_NM', 'P2_NI', 'P2_NM', 'P3_NI', 'P3_NM', 'P4_NI',
    'P4_NS']) AS s, unnest(range(1, 20)) AS i)
    UNION ALL SELECT 3, i - 1, 'Primary00' || i, 'Tumor_Pancreas' || i FROM range(1, 4) t(i)
    UNION ALL SELECT 4, i - 1, 'T_cac' || i, 'Tumor_Colon' || i FROM range(1, 17) t(i)
    UNION ALL SELECT 4, 15 + i, 'B_cac' || n, 'Normal_Colon' || i FROM (SELECT unnest([4, 6, 7, 10, 11, 14, 15]) AS n, unnest(range(1, 8)) AS i)
    UNION ALL SELECT 5, i - 1, 'HGSOC' || i, 'Tumor_Ovary' || i FROM range(1, 8) t(i)
    UNION ALL SELECT 5, 6 + i, 'Normal' || i, 'Normal_Ovary' || i FROM range(1, 6) t(i)
    UNION ALL SELECT 6, i - 1, CASE WHEN i < 3 THEN 'biopsy' || i ELSE 'resection' || (i - 2) END, 'Tumor_MPNST' || i FROM range(1, 7) t(i)
    UNION ALL SELECT 7, i - 1, CASE WHEN i < 7 THEN 'Acral' || i ELSE 'Cutaneous' || (i - 6) END, 'Tumor_Skin' || i FROM range(1, 10) t(i)
    UNION ALL SELECT 8, i, s, id FROM (SELECT unnest(['DIPG', 'GBM', 'Adjacent']) AS s, unnest(['DIPG', 'GBM', 'Others']) AS id, unnest([0, 1, 2]) AS i)
    UNION ALL SELECT 9, i, s, id FROM (SELECT unnest(['Astrocytoma', 'GBM_1']) AS s,
    unnest(['Tumor_Brain_LGG_Astrocytoma', 'Tumor_Brain_HGG_GBM']) AS id, unnest([0, 1]) AS i)"""


def ten_sets(s, d):
    """The customers as the cells of ten datasets, with the samples these have and, where samples are listed, one that is not."""
    cells, out = fx.cells(s, d), {}
    for at, name in enumerate(SETS):
        known = OTHER_SAMPLES.get(name) or [*label_maps.sample_ids(name), "unlisted"]
        place = F.get(F.array(*map(F.lit, known)), F.floor(F.col("cell_id") / 10).cast("int") % len(known))
        own = cells.filter(F.col("cell_id") % 10 == at).select("cell_id", place.alias("sample"), F.col("grp").alias("celltype_broad"))
        if name == "colon":
            own = own.withColumn("condition", F.when(F.col("sample").startswith("B_"), "Normal").otherwise("Cancer"))
        if name == "hgg":
            own = own.select("cell_id", "sample", F.col("sample").alias("tumor"), F.col("celltype_broad").alias("celltype"))
        out[name] = own
    return out


@register("atlas_union", sql(
    """SELECT dataset, cell_id, sample, id AS "ID", tumor, tissue, celltype_broad, tissue1, list_position(['Brain', 'Thyroid', 'Lung', 'Pancreas', 'Colon',
       'Ovary', 'MPNST', 'Skin'], tissue1)::INTEGER AS tissue1_ord FROM (SELECT *, CASE WHEN ds IN (0, 8, 9) OR id = 'Others' THEN 'Brain'
       ELSE ['', 'Thyroid', 'Lung', 'Pancreas', 'Colon', 'Ovary', 'MPNST', 'Skin'][ds + 1] END AS tissue1 FROM placed)
       WHERE NOT (ds = 8 AND id = 'Others') AND NOT (ds IN (1, 2, 4, 5) AND tumor = 'Normal')""", "cells",
    names=SAMPLES_SQL,
    listed="SELECT ds, i, sample, id FROM names UNION ALL SELECT ds, MAX(i) + 1, 'unlisted', 'Others' FROM names WHERE ds BETWEEN 1 AND 7 GROUP BY 1",
    sizes="SELECT ds, COUNT(*) AS n FROM listed GROUP BY 1",
    placed="""SELECT ['pa', 'thyroid', 'lung', 'pancreas', 'colon', 'ovary', 'mpnst', 'skin', 'hgg', 'gbm_astrocytoma'][ds + 1] AS dataset, ds, cell_id,
        l.sample, id, grp AS celltype_broad, CASE WHEN ds = 8 THEN 'Brain' END AS tissue, CASE WHEN ds = 8 THEN 'Tumors'
        WHEN id LIKE 'Normal%' OR (ds IN (1, 2, 5) AND id = 'Others') THEN 'Normal' ELSE 'Tumor' END AS tumor
        FROM cells c JOIN sizes ON c.cell_id % 10 = ds JOIN listed l USING (ds) WHERE l.i = (cell_id // 10) % n"""))
def atlas_union(s, d):
    """Ten annotated datasets: IDs, tumour cells, union, tissue."""
    found = atlas.whole_atlas(ten_sets(s, d))
    return found.select("dataset", "cell_id", "sample", "ID", "tumor", "tissue", "celltype_broad", "tissue1", "tissue1_ord")


@register("atlas_pathology", sql(
    """SELECT cell_id, p AS "Pathology", list_position(['PA', 'DIPG', 'Grade II Astrocytoma', 'GBM'], p)::INTEGER AS "Pathology_ord", t AS celltype_broad1,
       COALESCE(p, 'NA') || '_' || t AS "Pathology_celltype" FROM (SELECT cell_id, CASE cluster % 5 WHEN 0 THEN 'PA' WHEN 1 THEN 'DIPG'
       WHEN 2 THEN 'Grade II Astrocytoma' WHEN 3 THEN 'GBM' END AS p, CASE cell_id % 3 WHEN 0 THEN 'TAM' WHEN 1 THEN 'Oligodendrocyte' ELSE 'Tumor' END AS t
       FROM cells)""", "cells"))
def atlas_pathology(s, d):
    """Myeloid cells, oligodendrocytes and tumour cells of several pathologies, one of them unknown, under a joint key."""
    cells = fx.cells(s, d).withColumn("ID", F.get(F.array(*map(F.lit, ["PA", "DIPG", "Astrocytoma", "GBM", "Medulloblastoma"])), F.col("cluster") % 5))
    parts = [cells.filter(F.col("cell_id") % 3 == i).withColumn("celltype_broad", F.lit(t)) for i, t in enumerate(["TAM", "Oligo", "Tumor"])]
    return atlas.with_pathology(reshape.unite(*parts)).select("cell_id", "Pathology", "Pathology_ord", "celltype_broad1", "Pathology_celltype")


MOUSE_IDS = ["Het_PA", "Normal_PA", "Tumor_Colon", "Tumor_GBM", "Tumor_PA", "Tumor_Pancreas1", "Tumor_Pancreas2", "Tumor1_Pancreas3",
             "Tumor2_Pancreas3", "Tumor1_MB", "Tumor2_MB", "Tumor3_MB", "Tumor1_Skin", "Tumor2_Skin", "WT_Colon", "else"]


@register("atlas_mouse_labels", sql(
    """SELECT cell_id, tissue AS tumor_tissue, CASE WHEN tissue IN ('Tumor_ON', 'GBM', 'MB') THEN 'Brain' ELSE substr(tissue, 7) END AS new_label,
       CASE WHEN tissue IN ('GBM', 'MB') THEN 'HGG' WHEN tissue = 'Tumor_ON' THEN 'LGG' END AS "HGG" FROM (SELECT cell_id, CASE
       WHEN i = 2 THEN 'Tumor_Colon' WHEN i = 3 THEN 'GBM' WHEN i = 4 THEN 'Tumor_ON' WHEN i BETWEEN 5 AND 8 THEN 'Tumor_Pancreas' WHEN i BETWEEN 9 AND 11 THEN 'MB'
       WHEN i IN (12, 13) THEN 'Tumor_Skin' END AS tissue FROM (SELECT cell_id, cell_id % 16 AS i FROM cells)) WHERE tissue IS NOT NULL""", "cells"))
def atlas_mouse(s, d):
    cells = fx.cells(s, d).withColumn("ID", F.get(F.array(*map(F.lit, MOUSE_IDS)), (F.col("cell_id") % 16).cast("int")))
    return atlas.mouse_tumors(cells).select("cell_id", "tumor_tissue", "new_label", "HGG")


@register("malignant_cells")
def malignant(s, d):
    """Copy-number call from counts to label."""
    return analyses.malignant_cells(cut_lineage(fx.counts(s, d)), fx.genes(s, d), fx.regions(s, d), ARMS)


@register("annotate_dataset")
def annotate(s, d):
    """Raw counts to labelled cells, with the fixture's limits."""
    preset = replace(PRESETS["colon"], min_features=30, max_count=1400, mt_pattern=basic.MT, ribo_patterns=tuple(basic.RIBO),
                     n_features=200, n_pcs=20, dims=10, resolutions=(0.3,), min_median_features=30)
    counts = cut_lineage(fx.counts(s, d))
    done = analyses.annotate(counts, fx.genes(s, d), fx.cells(s, d).select(*CELL_KEY, "grp"), preset,
                             label_maps.CELL_TYPES["colon"], tissue="Market")
    return done.select(*CELL_KEY, "n_count", "n_feature", "grp", "cluster", "celltype_broad", "tissue")
