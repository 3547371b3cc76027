"""Construction, filters, joins, aggregates, ranking and scalar operators (sections C to H)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from cytolake.functions import nulls, stats, text
from cytolake.operators import doublets, labels, markers, normalize, pca, qc, regions as reg, reshape
from cytolake.plans import label_maps
from cytolake.runtime import cut_lineage
from cytolake.schema import CELL_KEY

from . import fixtures as fx
from .fixtures import sql

MT, RIBO = "^Brand#2-", ["Brand#1", "Brand#3"]
QUERIES: dict = {}
ORACLES: dict = {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def metrics(s, d):
    flagged = qc.flag_features(fx.genes(s, d), {"mt": MT, "ribo": RIBO})
    return qc.cell_metrics(fx.counts(s, d), flagged, ["mt", "ribo"])


def passing(s, d):
    return qc.qc_filter(metrics(s, d), 30, 10, 1400)


def described(s, d):
    return reshape.attach(metrics(s, d), fx.cells(s, d), CELL_KEY)


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


R = "round({0}, 6) AS {0}".format
SQL_METRICS = f"sample, cell_id, n_count, n_feature, {R('pct_mt')}, {R('pct_ribo')}"


def show(df):
    return df.select("sample", "cell_id", "n_count", "n_feature", r6("pct_mt"), r6("pct_ribo"))


# ---- C: construction, reshape, projection

@register("c1_build_object", sql(
    "SELECT k.sample, k.cell_id, k.n_count, k.n_feature, cluster, grp FROM kept k LEFT JOIN cells USING (sample, cell_id)",
    "counts", "cells",
    common="SELECT gene FROM counts GROUP BY gene HAVING COUNT(*) >= 3",
    kept="""SELECT sample, cell_id, CAST(SUM(cnt) AS BIGINT) AS n_count, COUNT(*) AS n_feature
            FROM counts WHERE gene IN (SELECT gene FROM common) GROUP BY 1, 2 HAVING COUNT(*) >= 10"""))
def c1(s, d):
    _, cells = reshape.build_cells(fx.counts(s, d), fx.cells(s, d).drop("n_name"), 3, 10)
    return cells


@register("c2_split_by_key", sql(
    "SELECT sample, COUNT(*) AS n_cells, CAST(SUM(n_count) AS BIGINT) AS total FROM metrics GROUP BY 1", "metrics"))
def c2(s, d):
    return metrics(s, d).groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_count").alias("total"))


@register("c3_join_layers", sql(
    "SELECT gene, CAST(SUM(cnt) AS BIGINT) AS total, COUNT(*) AS n_cells FROM counts GROUP BY 1", "counts"))
def c3(s, d):
    return qc.gene_totals(fx.counts(s, d))


@register("c4_prefix_cells", sql(
    "SELECT sample, concat(sample, '_', CAST(cell_id AS VARCHAR)) AS cell_id, cluster FROM cells", "cells"))
def c4(s, d):
    return reshape.prefix_cells(fx.cells(s, d).select("sample", "cell_id", "cluster"))


@register("c5_constant_column", sql(
    "SELECT sample, cell_id, 'Market' AS tissue, 'customers' AS dataset FROM cells", "cells"))
def c5(s, d):
    return reshape.tag(fx.cells(s, d).select(*CELL_KEY), tissue="Market", dataset="customers")


@register("c6_copy_column", sql(
    "SELECT sample, cell_id, cluster, cluster AS chosen_cluster, grp AS label FROM cells", "cells"))
def c6(s, d):
    return reshape.copy_columns(fx.cells(s, d), chosen_cluster="cluster", label="grp").drop("n_name", "grp")


@register("c7_drop_column", sql("SELECT sample, cell_id, cluster, grp FROM cells", "cells"))
def c7(s, d):
    return fx.cells(s, d).drop("n_name")


@register("c8_keep_columns", sql(
    "SELECT region, chr FROM regions WHERE region IN ('Brand#7p', 'Brand#7q', 'Brand#10p', 'Brand#10q', 'Brand#22q')",
    "regions"))
def c8(s, d):
    return labels.keep_values(
        fx.regions(s, d), "region",
        ["Brand#7p", "Brand#7q", "Brand#10p", "Brand#10q", "Brand#22q"]).select("region", "chr")


@register("c9_slim_object", sql("SELECT sample, cell_id, gene, cnt FROM lognorm", "lognorm"))
def c9(s, d):
    return normalize.log_normalize(fx.counts(s, d)).select(*CELL_KEY, "gene", "cnt")


@register("c10_layer_access", sql(
    f"SELECT sample, cell_id, gene, {R('tpm')} FROM (SELECT sample, cell_id, gene, v AS tpm FROM lognorm)", "lognorm"))
def c10(s, d):
    layered = normalize.log_normalize(fx.counts(s, d)).withColumnRenamed("v", "tpm").drop("cnt")
    return layered.select(*CELL_KEY, "gene", r6("tpm"))


@register("c11_key_column", sql("SELECT gene_name AS row_name, chr, pos FROM genes", "genes"))
def c11(s, d):
    return fx.genes(s, d).drop("gene").withColumnRenamed("gene_name", "row_name")


@register("c12_rename_matching", sql("SELECT sample, cell_id, grp AS doublet_finder FROM cells", "cells"))
def c12(s, d):
    generated = fx.cells(s, d).select(*CELL_KEY, F.col("grp").alias("DF.classifications_0.25_0.09"))
    return reshape.rename_matching(generated, r"DF\.classifications.*", "doublet_finder")


@register("c13_densify", sql(
    """SELECT c.sample, c.cell_id, b.gene, COALESCE(k.cnt, 0) AS cnt FROM cells c
       CROSS JOIN (SELECT 'Brand#' || CAST(i AS VARCHAR) AS gene FROM range(1, 26) t(i)) b
       LEFT JOIN brand_counts k USING (sample, cell_id, gene)""", "cells", "brand_counts"))
def c13(s, d):
    return reshape.densify(fx.brand_counts(s, d), BRANDS, fx.cells(s, d))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@register("c14_equal_width_chunks", sql(
    """SELECT cell_id, CAST(least(7, greatest(1, ceil((cell_id - lo) * 7.0 / (hi - lo)))) AS INTEGER) AS chunk
       FROM cells, (SELECT MIN(cell_id) AS lo, MAX(cell_id) AS hi FROM cells)""", "cells"))
def c14(s, d):
    return reshape.equal_width_chunks(fx.cells(s, d).select("cell_id"), "cell_id", 7)


@register("c15_grouping_column", sql("SELECT grp AS ident, COUNT(*) AS n FROM cells GROUP BY 1", "cells"))
def c15(s, d):
    return labels.frequency(reshape.copy_columns(fx.cells(s, d), ident="grp"), "ident")


@register("c16_feature_set", sql(
    """SELECT g.gene, g.gene_name, k.gene IS NOT NULL AS is_variable FROM genes g LEFT JOIN
       (SELECT gene FROM counts GROUP BY gene HAVING SUM(cnt) > 700) k USING (gene)""", "counts", "genes"))
def c16(s, d):
    chosen = qc.gene_totals(fx.counts(s, d)).filter(F.col("total") > 700).select(
        "gene", F.lit(True).alias("is_variable"))
    return (reshape.attach(fx.genes(s, d).select("gene", "gene_name"), chosen, ["gene"])
            .na.fill(False, ["is_variable"]))


# ---- D: filters

@register("d1_qc_filter", sql(f"SELECT {SQL_METRICS} FROM passing", "passing"))
def d1(s, d):
    return show(passing(s, d))


@register("d1_qc_counts", sql(
    "SELECT * FROM counts WHERE (sample, cell_id) IN (SELECT (sample, cell_id) FROM passing)", "passing"))
def d1_counts(s, d):
    return reshape.restrict(fx.counts(s, d), passing(s, d))


@register("d4_equality", sql("SELECT sample, cell_id, n_name FROM cells WHERE grp <> 'ASIA'", "cells"))
def d4(s, d):
    return fx.cells(s, d).filter(F.col("grp") != "ASIA").select(*CELL_KEY, "n_name")


@register("d5_membership", sql("SELECT sample, cell_id, cluster FROM cells WHERE cluster IN (0, 1, 2, 3, 14)", "cells"))
def d5(s, d):
    return labels.keep_values(fx.cells(s, d), "cluster", [0, 1, 2, 3, 14]).select(*CELL_KEY, "cluster")


@register("d6_anti_membership", sql(
    """SELECT sample, cell_id, grp2 FROM (SELECT *, CASE WHEN cluster = 3 THEN NULL ELSE grp END AS grp2 FROM cells)
       WHERE grp2 IS NULL OR grp2 NOT IN ('ASIA', 'AFRICA')""", "cells"))
def d6(s, d):
    holed = fx.cells(s, d).withColumn("grp2", F.when(F.col("cluster") != 3, F.col("grp")))
    return labels.drop_values(holed, "grp2", ["ASIA", "AFRICA"]).select(*CELL_KEY, "grp2")


@register("d7_ident_subset", sql("SELECT sample, cell_id, n_name FROM cells WHERE grp IN ('ASIA', 'EUROPE')", "cells"))
def d7(s, d):
    return labels.keep_values(fx.cells(s, d), "grp", ["ASIA", "EUROPE"]).select(*CELL_KEY, "n_name")


@register("d8_drop_shallow_clusters", sql(
    """SELECT sample, cell_id, cluster, n_feature FROM described WHERE cluster IN
       (SELECT cluster FROM described GROUP BY 1 HAVING median(n_feature) >= 39)""", "described"))
def d8(s, d):
    return labels_only(qc.drop_shallow_clusters(described(s, d), "cluster", 39))


def labels_only(df):
    return df.select(*CELL_KEY, "cluster", "n_feature")


@register("d9_expressed_genes", sql(
    "SELECT sample, cell_id, gene, cnt FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING SUM(cnt) > 0)",
    "counts"))
def d9(s, d):
    return qc.expressed_genes(fx.counts(s, d)).select(*CELL_KEY, "gene", "cnt")


@register("d10_deep_cells", sql(
    """SELECT sample, cell_id, gene, cnt FROM counts WHERE (sample, cell_id) IN
       (SELECT (sample, cell_id) FROM counts GROUP BY sample, cell_id HAVING SUM(cnt) > 1200)""", "counts"))
def d10(s, d):
    return qc.deep_cells(fx.counts(s, d), 1200).select(*CELL_KEY, "gene", "cnt")


@register("d11_supported_genes", sql(
    """SELECT sample, cell_id, gene, cnt FROM counts WHERE gene IN
       (SELECT gene FROM counts JOIN genes USING (gene) WHERE pos <= 25 GROUP BY 1 HAVING COUNT(*) >= 5)""",
    "counts", "genes"))
def d11(s, d):
    listed = fx.genes(s, d).filter(F.col("pos") <= 25)
    return qc.supported_genes(fx.counts(s, d), listed, 5).select(*CELL_KEY, "gene", "cnt")


@register("d12_name_pattern", sql(
    "SELECT gene, gene_name FROM genes WHERE regexp_matches(gene_name, 'Brand#1|Brand#3')", "genes"))
def d12(s, d):
    return fx.genes(s, d).filter(text.name_matches("gene_name", RIBO)).select("gene", "gene_name")


# ---- E: joins

@register("e1_attach_metadata", sql(
    "SELECT sample, cell_id, n_count, n_feature, cluster, grp FROM described", "described"))
def e1(s, d):
    return described(s, d).select(*CELL_KEY, "n_count", "n_feature", "cluster", "grp")


@register("e3_label_map", sql(
    """SELECT sample, cell_id, cluster, CASE WHEN cluster IN (0, 1, 3, 4) THEN 'T/NK cell' WHEN cluster = 7 THEN 'TAM'
       WHEN cluster IN (5, 12) THEN 'Epithelial cell' WHEN cluster = 9 THEN 'Endothelial cell' ELSE 'Others' END
       AS celltype FROM cells""", "cells"))
def e3(s, d):
    table = s.createDataFrame(
        [(c, l) for l, cs in {"T/NK cell": [0, 1, 3, 4], "TAM": [7], "Epithelial cell": [5, 12],
                              "Endothelial cell": [9]}.items() for c in cs], "value int, label string")
    return labels.join_labels(fx.cells(s, d), "cluster", table, "celltype", "Others").select(
        *CELL_KEY, "cluster", "celltype")


def type_ladder(dataset):
    """One dataset's cluster map as a CASE expression."""
    default = label_maps.DEFAULT_TYPES.get(dataset, "Others")
    arms = " ".join(f"WHEN cluster IN ({', '.join(map(str, cs))}) THEN '{name}'"
                    for name, cs in label_maps.CELL_TYPES[dataset].items())
    return f"CASE {arms} ELSE {'NULL' if default is None else repr(default)} END"


@register("e3_cell_type_maps", sql(" UNION ALL ".join(
    f"SELECT '{name}' AS dataset, cell_id, {type_ladder(name)} AS celltype FROM cells" for name in label_maps.CELL_TYPES),
    "cells"))
def e3_maps(s, d):
    """Every dataset's cluster map on the same cluster numbers, as one table of labels."""
    table = reshape.unite(*[
        label_maps.label_table(s, types).withColumn("dataset", F.lit(name)) for name, types in label_maps.CELL_TYPES.items()])
    defaults = {name: label_maps.DEFAULT_TYPES.get(name, "Others") for name in label_maps.CELL_TYPES}
    cells = fx.cells(s, d).select(
        "cell_id", "cluster", F.explode(F.array(*[F.lit(n) for n in defaults])).alias("dataset"))
    found = cells.join(table.withColumnRenamed("value", "cluster"), ["dataset", "cluster"], "left")
    default = labels.map_labels("dataset", {k: v for k, v in defaults.items() if v is not None})
    return found.select("dataset", "cell_id", F.coalesce("label", default).alias("celltype"))


@register("e4_parallel_zip", sql(
    f"""SELECT sample, cell_id, {R('doublet_rate')} FROM passing JOIN
        (SELECT sample, 0.008 * COUNT(*) / 1000 AS doublet_rate FROM metrics GROUP BY 1) USING (sample)""", "passing"))
def e4(s, d):
    before = metrics(s, d)
    rates = qc.expected_doublet_rate(before).select("sample", "doublet_rate")
    return qc.with_rate(qc.qc_filter(before, 30, 10, 1400), rates).select(*CELL_KEY, r6("doublet_rate"))


@register("e5_gene_positions", sql(
    "SELECT sample, cell_id, gene, cnt, chr, pos FROM counts JOIN genes USING (gene)", "counts", "genes"))
def e5(s, d):
    return reg.gene_positions(fx.counts(s, d), fx.genes(s, d)).select(*CELL_KEY, "gene", "cnt", "chr", "pos")


@register("e6_region_range_join", sql(
    """SELECT region, COUNT(*) AS n_genes, MIN(pos) AS first_pos, MAX(pos) AS last_pos FROM genes g JOIN regions r
       ON g.chr = r.chr AND g.pos BETWEEN r."start" AND r."end" GROUP BY 1""", "genes", "regions"))
def e6(s, d):
    placed = reg.genes_in_regions(fx.genes(s, d), fx.regions(s, d))
    return placed.groupBy("region").agg(
        F.count(F.lit(1)).alias("n_genes"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


RATES = """SELECT * FROM (VALUES (500, 0.004), (1000, 0.008), (2000, 0.016), (3000, 0.023), (4000, 0.031),
    (5000, 0.039), (6000, 0.046), (7000, 0.054), (8000, 0.061), (9000, 0.069), (10000, 0.076)) t(recovered, rate)"""


@register("e7_multiplet_rate", sql(
    """SELECT n_nationkey, n, CAST(CASE WHEN n <= 500 THEN n / 125000.0 ELSE
       (SELECT max_by(rate, recovered) FROM rates WHERE recovered < n) END AS DOUBLE) AS multiplet_rate
       FROM (SELECT c_nationkey AS n_nationkey, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN customer ON o_custkey = c_custkey GROUP BY 1)""", rates=RATES))
def e7(s, d):
    n = fx.purchases(s, d).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("multiplet_rate", doublets.multiplet_rate(F.col("n")))


@register("e9_feature_restriction", sql(
    "SELECT sample, cell_id, gene, cnt FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING COUNT(*) > 25)",
    "counts"))
def e9(s, d):
    counts = fx.counts(s, d)
    chosen = qc.gene_totals(counts).filter(F.col("n_cells") > 25)
    return reshape.restrict(counts, chosen, ["gene"]).select(*CELL_KEY, "gene", "cnt")


# ---- F: aggregates

@register("f1_cell_totals", sql(
    "SELECT sample, cell_id, CAST(SUM(cnt) AS BIGINT) AS n_count FROM counts GROUP BY 1, 2", "counts"))
def f1(s, d):
    return qc.cell_metrics(fx.counts(s, d)).drop("n_feature")


@register("f2_detected_features", sql(
    "SELECT sample, cell_id, COUNT(*) AS n_feature FROM counts GROUP BY 1, 2", "counts"))
def f2(s, d):
    return qc.cell_metrics(fx.counts(s, d)).drop("n_count")


@register("f2_detected_tokens", sql(
    "SELECT sample, cell_id, COUNT(*) AS n_feature, CAST(SUM(cnt) AS BIGINT) AS n_count FROM token_counts GROUP BY 1, 2",
    "token_counts"))
def f2_tokens(s, d):
    return qc.cell_metrics(fx.token_counts(s, d))


@register("f3_gene_totals", sql(
    "SELECT gene, CAST(SUM(cnt) AS BIGINT) AS total, COUNT(*) AS n_cells FROM token_counts GROUP BY 1", "token_counts"))
def f3(s, d):
    return qc.gene_totals(fx.token_counts(s, d))


@register("f4_feature_share", sql(f"SELECT {SQL_METRICS} FROM metrics", "metrics"))
def f4(s, d):
    return show(metrics(s, d))


@register("f4_feature_share_first_pattern", sql(
    """SELECT sample, cell_id, round(100.0 * SUM(CASE WHEN regexp_matches(gene_name, 'Brand#1') THEN cnt ELSE 0 END)
       / SUM(cnt), 6) AS pct_ribo FROM counts JOIN genes USING (gene) GROUP BY 1, 2""", "counts", "genes"))
def f4_first(s, d):
    flagged = qc.flag_features(fx.genes(s, d), {"ribo": RIBO}, first_only=True)
    return qc.cell_metrics(fx.counts(s, d), flagged, ["ribo"]).select(*CELL_KEY, r6("pct_ribo"))


@register("f5_grouped_median", sql(
    "SELECT cluster, median(n_feature) AS median_n_feature FROM described GROUP BY 1", "described"))
def f5(s, d):
    return qc.median_by(described(s, d), "cluster", "n_feature", "median_n_feature")


@register("f6_global_median", sql("SELECT median(n_feature) AS median_n_feature FROM metrics", "metrics"))
def f6(s, d):
    return metrics(s, d).agg(F.median("n_feature").alias("median_n_feature"))


@register("f7_frequency", sql("SELECT sample, cell_id, cnt AS value, COUNT(*) AS n FROM counts GROUP BY 1, 2, 3", "counts"))
def f7(s, d):
    return labels.frequency(fx.counts(s, d).withColumnRenamed("cnt", "value"), *CELL_KEY, "value")


@register("f8_contingency", sql("SELECT cluster, sample, COUNT(*) AS n FROM cells GROUP BY 1, 2", "cells"))
def f8(s, d):
    return labels.frequency(fx.cells(s, d), "cluster", "sample")


@register("f8_contingency_wide", sql(
    """SELECT cluster, COUNT(*) FILTER (sample = 'AUTOMOBILE') AS "AUTOMOBILE",
       COUNT(*) FILTER (sample = 'BUILDING') AS "BUILDING", COUNT(*) FILTER (sample = 'FURNITURE') AS "FURNITURE",
       COUNT(*) FILTER (sample = 'HOUSEHOLD') AS "HOUSEHOLD", COUNT(*) FILTER (sample = 'MACHINERY') AS "MACHINERY"
       FROM cells GROUP BY 1""", "cells"))
def f8_wide(s, d):
    return labels.crosstab(fx.cells(s, d), "cluster", "sample",
                           ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@register("f9_distinct", sql(
    "SELECT grp, COUNT(DISTINCT n_name) AS n_levels, COUNT(DISTINCT sample) AS n_samples FROM cells GROUP BY 1", "cells"))
def f9(s, d):
    return fx.cells(s, d).groupBy("grp").agg(
        F.countDistinct("n_name").alias("n_levels"), F.countDistinct("sample").alias("n_samples"))


@register("f10_dimensions", sql(
    """SELECT sample, COUNT(DISTINCT cell_id) AS n_cells, COUNT(DISTINCT gene) AS n_genes, COUNT(*) AS n_nonzero
       FROM counts GROUP BY 1""", "counts"))
def f10(s, d):
    counts = fx.counts(s, d)
    genes = counts.groupBy("sample", "gene").agg(F.count(F.lit(1)).alias("k")).groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_genes"), F.sum("k").alias("n_nonzero"))
    return qc.cells_per_sample(qc.cell_metrics(counts)).join(genes, "sample")


@register("f11_summary", sql(
    """SELECT sample, COUNT(*) AS n, CAST(MIN(n_count) AS DOUBLE) AS v_min, quantile_cont(n_count, 0.25) AS v_q1,
       quantile_cont(n_count, 0.5) AS v_median, round(AVG(n_count), 6) AS v_mean,
       quantile_cont(n_count, 0.75) AS v_q3, CAST(MAX(n_count) AS DOUBLE) AS v_max FROM metrics GROUP BY 1""", "metrics"))
def f11(s, d):
    return qc.summary(metrics(s, d), "n_count", ["sample"]).withColumn("v_mean", F.round("v_mean", 6))


@register("f12_histogram", sql(
    """SELECT sample, cell_id, CAST(floor(ln(1 + cnt) / 0.5) AS INTEGER) AS bin, COUNT(*) AS n,
       floor(ln(1 + cnt) / 0.5) * 0.5 AS bin_low FROM counts GROUP BY 1, 2, 3, 5""", "counts"))
def f12(s, d):
    return qc.histogram(fx.counts(s, d), F.ln(F.lit(1.0) + F.col("cnt")), 0.5, CELL_KEY)


@register("f13_consensus_label", sql(
    """SELECT cluster, arg_min(sample, (-n, sample)) AS label, MAX(n) AS n_votes FROM
       (SELECT cluster, sample, COUNT(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1""", "cells"))
def f13(s, d):
    return labels.consensus(fx.cells(s, d), "cluster", "sample", "label")


@register("f14_homotypic", sql(
    """SELECT sample, round(SUM((n / total) * (n / total)), 6) AS homotypic FROM
       (SELECT sample, cluster, COUNT(*) AS n FROM cells GROUP BY 1, 2)
       JOIN (SELECT sample, COUNT(*) AS total FROM cells GROUP BY 1) USING (sample) GROUP BY 1""", "cells"))
def f14(s, d):
    return doublets.homotypic(fx.cells(s, d), "cluster").select("sample", r6("homotypic"))


@register("f15_norm_factor", sql(
    f"""SELECT sample, cell_id, {R('norm_factor')} FROM (SELECT sample, cell_id,
        SUM(v) / (SELECT COUNT(*) FROM genes) AS norm_factor FROM lognorm GROUP BY 1, 2)""", "lognorm", "genes"))
def f15(s, d):
    v = normalize.log_normalize(fx.counts(s, d))
    return normalize.normalizing_factor(v, fx.genes(s, d)).select(*CELL_KEY, r6("norm_factor"))


REGION_MEANS = dict(
    placed="""SELECT gene, region FROM genes g JOIN regions r ON g.chr = r.chr AND g.pos BETWEEN r."start" AND r."end" """,
    held="SELECT region, COUNT(*) AS n_genes FROM placed GROUP BY 1",
    factors="SELECT sample, cell_id, SUM(v) / (SELECT COUNT(*) FROM genes) AS norm_factor FROM lognorm GROUP BY 1, 2",
    means="""SELECT f.sample, f.cell_id, h.region, COALESCE(s.sv, 0) / h.n_genes - f.norm_factor AS x
             FROM factors f CROSS JOIN held h LEFT JOIN (SELECT sample, cell_id, region, SUM(v) AS sv
             FROM lognorm JOIN placed USING (gene) GROUP BY 1, 2, 3) s USING (sample, cell_id, region)""")


@register("f16_region_mean", sql(
    f"SELECT sample, cell_id, region, {R('x')} FROM means", "lognorm", "genes", "regions", **REGION_MEANS))
def f16(s, d):
    return region_means(s, d).select(*CELL_KEY, "region", r6("x"))


def region_means(s, d):
    v = cut_lineage(normalize.log_normalize(fx.counts(s, d)))
    factors = normalize.normalizing_factor(v, fx.genes(s, d))
    return reg.region_means(v, factors, reg.genes_in_regions(fx.genes(s, d), fx.regions(s, d)))


@register("f17_best_row", sql(
    """SELECT sample, arg_max(n_count, (n_count, -cell_id)) AS n_count, arg_max(cell_id, (n_count, -cell_id)) AS cell_id
       FROM metrics GROUP BY 1""", "metrics"))
def f17(s, d):
    return labels.best_row(metrics(s, d), ["sample"], "n_count", "cell_id", ["cell_id"])


# ---- G: ranking and order

VST = dict(
    mom="""SELECT sample, gene, n, nnz, s1 / n AS mu, greatest(0, (s2 - s1 * s1 / n) / (n - 1)) AS var FROM
        (SELECT sample, gene, CAST(SUM(cnt) AS DOUBLE) AS s1, CAST(SUM(cnt * cnt) AS DOUBLE) AS s2, COUNT(*) AS nnz
         FROM counts GROUP BY 1, 2) JOIN per_sample USING (sample)""",
    logs="""SELECT *, log10(mu) - AVG(log10(mu)) OVER (PARTITION BY sample) AS x, log10(var) AS y FROM mom
         WHERE mu > 0 AND var > 0""",
    sums="""SELECT sample, CAST(COUNT(*) AS DOUBLE) AS a0, SUM(x) AS a1, SUM(x*x) AS a2, SUM(x*x*x) AS a3,
         SUM(x*x*x*x) AS a4, SUM(y) AS b0, SUM(x*y) AS b1, SUM(x*x*y) AS b2 FROM logs GROUP BY 1""",
    dets="""SELECT sample, a0*(a2*a4-a3*a3) - a1*(a1*a4-a2*a3) + a2*(a1*a3-a2*a2) AS det,
         b0*(a2*a4-a3*a3) - a1*(b1*a4-a3*b2) + a2*(b1*a3-a2*b2) AS d0,
         a0*(b1*a4-a3*b2) - b0*(a1*a4-a2*a3) + a2*(a1*b2-b1*a2) AS d1,
         a0*(a2*b2-b1*a3) - a1*(a1*b2-b1*a2) + b0*(a1*a3-a2*a2) AS d2 FROM sums""",
    fit="""SELECT logs.sample, gene, n, nnz, mu, var, sqrt(pow(10, d0/det + d1/det*x + d2/det*x*x)) AS sd_fit
         FROM logs JOIN dets USING (sample)""",
    scored="""SELECT sample, gene, any_value(mu) AS mu, any_value(var) AS var, any_value(sd_fit) AS sd_fit,
         (SUM(pow(least((cnt - mu) / sd_fit, sqrt(n)), 2)) + (any_value(n) - any_value(nnz))
          * pow(any_value(mu) / any_value(sd_fit), 2)) / (any_value(n) - 1) AS score
         FROM counts JOIN fit USING (sample, gene) GROUP BY 1, 2""",
    ranked="""SELECT sample, gene, score, rk FROM (SELECT *, row_number() OVER
         (PARTITION BY sample ORDER BY round(score, 9) DESC, gene) AS rk FROM scored) WHERE rk <= 100""")


@register("g1_top_features", sql(
    f"SELECT sample, gene, {R('score')}, rk FROM ranked", "counts", "per_sample", **VST))
def g1(s, d):
    top = normalize.variable_features(cut_lineage(fx.counts(s, d)), fx.cells(s, d), 100)
    return top.select("sample", "gene", r6("score"), "rk")


@register("g2_consensus_features", sql(
    """SELECT gene, COUNT(*) AS n_samples, median(rk) AS median_rk FROM ranked GROUP BY 1
       ORDER BY 2 DESC, 3, 1 LIMIT 50""", "counts", "per_sample", **VST))
def g2(s, d):
    counts = cut_lineage(fx.counts(s, d))
    return normalize.consensus_features(normalize.variable_features(counts, fx.cells(s, d), 100), 50)


SPREAD = "SELECT i AS pc, stddev_samp(vec[i]) AS sdev FROM vectors, range(1, 65) t(i) GROUP BY 1"
SHARES = """SELECT pc, sdev, 100 * sdev / SUM(sdev) OVER () AS pct, SUM(sdev) OVER (ORDER BY pc) * 100 / SUM(sdev) OVER ()
    AS cumulative, sdev * 100 / SUM(sdev) OVER () - lead(sdev) OVER (ORDER BY pc) * 100 / SUM(sdev) OVER () AS to_next
    FROM spread"""


def spread(s, d):
    return pca.component_sdev(fx.vectors(s, d).select("cell_id", "vec"))


@register("g4_cumulative_share", sql(
    f"SELECT pc, {R('pct')}, {R('cumulative')} FROM shares", "vectors", spread=SPREAD, shares=SHARES))
def g4(s, d):
    return pca.variance_shares(spread(s, d)).select("pc", r6("pct"), r6("cumulative"))


@register("g5_adjacent_difference", sql(
    f"SELECT pc, {R('to_next')} FROM shares", "vectors", spread=SPREAD, shares=SHARES))
def g5(s, d):
    return pca.variance_shares(spread(s, d)).select("pc", r6("to_next"))


@register("g6_elbow", sql(
    """SELECT CAST(COALESCE(least(MIN(CASE WHEN cumulative > 90 AND pct < 5 THEN pc END),
       MAX(CASE WHEN to_next > 0.1 THEN pc + 1 END)), MAX(pc)) AS INTEGER) AS n_pcs FROM shares""",
    "vectors", spread=SPREAD, shares=SHARES))
def g6(s, d):
    return pca.elbow(pca.variance_shares(spread(s, d)))


@register("g7_zscore_groups", sql(
    f"""SELECT gene, grp, {R('z')} FROM (SELECT gene, grp, greatest(-2.5, least(2.5, (ln(1 + total) -
        AVG(ln(1 + total)) OVER w) / nullif(stddev_samp(ln(1 + total)) OVER w, 0))) AS z FROM
        (SELECT gene, grp, CAST(SUM(cnt) AS BIGINT) AS total FROM brand_counts JOIN cells USING (sample, cell_id)
         GROUP BY 1, 2) WINDOW w AS (PARTITION BY gene))""", "brand_counts", "cells"))
def g7(s, d):
    totals = fx.brand_counts(s, d).join(fx.cells(s, d), CELL_KEY).groupBy("gene", "grp").agg(
        F.sum("cnt").alias("total"))
    return markers.across_groups(totals, "gene", "total", "z").select("gene", "grp", r6("z"))


@register("g8_relabel_by_size", sql(
    """SELECT cell_id, id AS cluster FROM cells JOIN (SELECT cluster, CAST(row_number() OVER
       (ORDER BY COUNT(*) DESC, MIN(cell_id)) - 1 AS INTEGER) AS id FROM cells GROUP BY 1) r
       USING (cluster)""", "cells"))
def g8(s, d):
    tagged = fx.cells(s, d).select("cell_id", F.col("cluster").alias("raw"), F.lit(0).alias("resolution"))
    return labels.by_size(tagged, "raw", "cell_id", by=["resolution"]).select("cell_id", "cluster")


@register("g9_nth_level", sql(
    "SELECT sample, cell_id, n_name, CAST(dense_rank() OVER (ORDER BY n_name) AS INTEGER) AS level FROM cells", "cells"))
def g9(s, d):
    return labels.nth_level(fx.cells(s, d), "n_name").select(*CELL_KEY, "n_name", "level")


@register("g10_level_order", sql(
    """SELECT sample, cell_id, CASE WHEN grp IN ('EUROPE', 'ASIA', 'AMERICA') THEN grp END AS grp,
       CASE grp WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'AMERICA' THEN 3 END AS grp_ord FROM cells""", "cells"))
def g10(s, d):
    return labels.as_factor(fx.cells(s, d), "grp", ["EUROPE", "ASIA", "AMERICA"]).select(*CELL_KEY, "grp", "grp_ord")


@register("g11_sort_head", sql(
    "SELECT sample, cell_id, n_count FROM metrics ORDER BY n_count DESC, cell_id LIMIT 20", "metrics"))
def g11(s, d):
    return metrics(s, d).select(*CELL_KEY, "n_count").orderBy(F.desc("n_count"), "cell_id").limit(20)


@register("g12_least_greatest", sql(
    """SELECT sample, cell_id, least(n_count, n_feature * 25) AS low, greatest(1, n_feature - 30) AS high
       FROM metrics""", "metrics"))
def g12(s, d):
    return metrics(s, d).select(
        *CELL_KEY, F.least("n_count", F.col("n_feature") * 25).alias("low"),
        F.greatest(F.lit(1), F.col("n_feature") - 30).alias("high"))


# ---- H: set operations and scalars

@register("h1_union_datasets", sql(
    """SELECT sample, CAST(cell_id AS VARCHAR) AS cell_id, CAST(gene AS VARCHAR) AS gene, cnt, 'parts' AS dataset,
       NULL AS lang FROM counts UNION ALL
       SELECT sample, CAST(cell_id AS VARCHAR), gene, cnt, 'tokens', sample FROM token_counts""",
    "counts", "token_counts"))
def h1(s, d):
    def texts(df):
        return df.withColumn("cell_id", F.col("cell_id").cast("string")).withColumn("gene", F.col("gene").cast("string"))
    return reshape.unite_named({
        "parts": texts(fx.counts(s, d)),
        "tokens": texts(fx.token_counts(s, d)).withColumn("lang", F.col("sample"))})


@register("h2_append_rows", sql(
    """SELECT 'c' AS kind, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS bal FROM customer
       UNION ALL SELECT 's', s_nationkey, s_acctbal FROM supplier"""))
def h2(s, d):
    c = fx.table(s, d, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").cast("bigint").alias("nation"),
                                          F.col("c_acctbal").alias("bal"))
    p = fx.table(s, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").cast("bigint").alias("nation"),
                                          F.col("s_acctbal").alias("bal"))
    return reshape.unite(c, p)


@register("h3_conditional_ladder", sql(
    """SELECT sample, cell_id, CASE WHEN n_count > 1400 THEN 'deep' WHEN n_feature < 30 THEN 'shallow'
       WHEN grp = 'ASIA' THEN 'asia' ELSE 'Others' END AS kind FROM described""", "described"))
def h3(s, d):
    return described(s, d).select(*CELL_KEY, labels.ladder(
        (F.col("n_count") > 1400, "deep"), (F.col("n_feature") < 30, "shallow"), (F.col("grp") == "ASIA", "asia"),
        default="Others").alias("kind"))


@register("h4_remap_identities", sql(
    """SELECT sample, cell_id, CASE WHEN grp IN ('AFRICA', 'ASIA') THEN 'GBM1' WHEN grp = 'AMERICA' THEN 'DIPG'
       ELSE 'GBM2' END AS study FROM cells""", "cells"))
def h4(s, d):
    return labels.remap_levels(fx.cells(s, d), "grp", ["GBM1", "DIPG", "GBM1", "GBM2", "GBM2"], "study").select(
        *CELL_KEY, "study")


@register("h5_regex_replace", sql(
    "SELECT gene, regexp_replace(gene_name, '-.*', '') AS stem, regexp_replace(gene_name, '#.*', '') AS head FROM genes",
    "genes"))
def h5(s, d):
    return fx.genes(s, d).select("gene", text.before_first("gene_name", "-").alias("stem"),
                                 text.before_first("gene_name", "#").alias("head"))


HOLED = "SELECT *, CASE WHEN cluster = 3 THEN NULL ELSE grp END AS grp2 FROM cells"


@register("h6_composite_key", sql(
    "SELECT sample, cell_id, COALESCE(grp2, 'NA') || '_' || n_name AS key FROM holed", "cells", holed=HOLED))
def h6(s, d):
    holed = fx.cells(s, d).withColumn("grp2", F.when(F.col("cluster") != 3, F.col("grp")))
    return holed.select(*CELL_KEY, nulls.paste("grp2", "n_name").alias("key"))


@register("h7_split_key", sql(
    """SELECT cell_id, split_part(key, '_', 1) AS pathology, nullif(split_part(key, '_', 2), '') AS celltype
       FROM (SELECT cell_id, COALESCE(grp2, 'NA') || '_' || n_name AS key FROM holed)""", "cells", holed=HOLED))
def h7(s, d):
    return h6(s, d).select("cell_id", *text.split_key("key", ["pathology", "celltype"]))


@register("h8_math", sql(
    """SELECT sample, cell_id, gene, round(log2(exp(v) - 1 + 1), 6) AS l2, round(exp(v) - 1, 6) AS back,
       CAST(round_even(cnt / 2.0, 0) AS BIGINT) AS half, round(ln(1 + cnt), 6) AS l1 FROM lognorm""", "lognorm"))
def h8(s, d):
    v = normalize.to_log2(normalize.log_normalize(fx.counts(s, d)), name="l2")
    return v.select(*CELL_KEY, "gene", r6("l2"), r6(F.exp("v") - 1, "back"),
                    F.bround(F.col("cnt") / F.lit(2.0), 0).cast("bigint").alias("half"),
                    r6(F.ln(F.lit(1.0) + F.col("cnt")), "l1"))


@register("h9_cast", sql(
    """SELECT gene, TRY_CAST(split_part(gene_name, '-', 2) AS BIGINT) AS num, TRY_CAST(gene_name AS DOUBLE) AS bad,
       CAST(pos AS VARCHAR) AS pos_text FROM genes""", "genes"))
def h9(s, d):
    return fx.genes(s, d).select(
        "gene", F.split_part("gene_name", F.lit("-"), F.lit(2)).try_cast("bigint").alias("num"),
        F.col("gene_name").try_cast("double").alias("bad"), F.col("pos").cast("string").alias("pos_text"))


@register("h10_expected_rate", sql(
    f"SELECT sample, COUNT(*) AS n_cells, round(0.008 * COUNT(*) / 1000, 6) AS doublet_rate FROM metrics GROUP BY 1",
    "metrics"))
def h10(s, d):
    return qc.expected_doublet_rate(metrics(s, d)).withColumn("doublet_rate", F.round("doublet_rate", 6))


@register("h11_expected_doublets", sql(
    """SELECT sample, n, CAST(round_even(rate * n, 0) AS BIGINT) AS n_exp,
       CAST(round_even(round_even(rate * n, 0) * (1 - homotypic), 0) AS BIGINT) AS n_exp_adj FROM
       (SELECT sample, n, CAST(CASE WHEN n <= 500 THEN n / 125000.0 ELSE
        (SELECT max_by(rate, recovered) FROM rates WHERE recovered < n) END AS DOUBLE) AS rate
        FROM per_sample) JOIN (SELECT sample, SUM((n / total) * (n / total)) AS homotypic FROM
        (SELECT sample, cluster, COUNT(*) AS n FROM cells GROUP BY 1, 2)
        JOIN (SELECT sample, COUNT(*) AS total FROM cells GROUP BY 1) USING (sample) GROUP BY 1) USING (sample)""",
    "cells", "per_sample", rates=RATES))
def h11(s, d):
    return doublets.expected_doublets(fx.cells(s, d), "cluster").select("sample", "n", "n_exp", "n_exp_adj")


# ---- J: mapping, folding and chaining

@register("j1_map_over_samples", sql(
    """SELECT sample, COUNT(*) AS n_cells, median(n_feature) AS median_n_feature, CAST(MAX(n_count) AS BIGINT) AS deepest
       FROM metrics GROUP BY 1""", "metrics"))
def j1(s, d):
    """The per-sample closure is a grouping key."""
    return metrics(s, d).groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_cells"), F.median("n_feature").alias("median_n_feature"), F.max("n_count").alias("deepest"))


@register("j4_fold_datasets", sql("SELECT sample, COUNT(*) AS n, CAST(SUM(cnt) AS BIGINT) AS total FROM counts GROUP BY 1", "counts"))
def j4(s, d):
    """A fold over datasets is a grouping key: one scan, whatever datasets there are."""
    return fx.counts(s, d).groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total"))


@register("j7_chained_steps", sql(
    """SELECT sample, cell_id, gene, round(v, 6) AS v FROM lognorm WHERE (sample, cell_id) IN
       (SELECT (sample, cell_id) FROM passing)""", "passing", "lognorm"))
def j7(s, d):
    """Steps chained with ``transform``."""
    return (fx.counts(s, d).transform(reshape.restrict, passing(s, d)).transform(normalize.log_normalize)
            .select(*CELL_KEY, "gene", r6("v")))
