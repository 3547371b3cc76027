"""Hand-computed goldens for the missing-value, rounding and zero rules."""

import math

import pytest
from pyspark.sql import functions as F

from cytolake.functions import nulls, text
from cytolake.operators import doublets, labels, markers, normalize, qc, reshape
from cytolake.runtime import number_rows, salted_join


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_membership_keeps_missing_values_apart(tiny):
    _, cells, _ = tiny
    assert labels.keep_values(cells, "label", ["A"]).count() == 2
    assert labels.drop_values(cells, "label", ["A"]).count() == 4
    assert labels.keep_values(cells, "label", []).count() == 0


def test_factor_and_paste(tiny):
    _, cells, _ = tiny
    got = labels.as_factor(cells, "label", ["B", "A"]).select(
        "label", "label_ord", nulls.paste("sample", "label").alias("k")).orderBy("sample", "cell_id").collect()
    assert [r.label for r in got] == ["A", "A", "B", "B", None, None]
    assert [r.label_ord for r in got] == [2, 2, 1, 1, None, None]
    assert got[4].k == "s2_NA"


def test_label_maps_and_ladders(tiny):
    _, cells, _ = tiny
    keep = labels.map_labels("label", {"A": "one"}, "Others")
    lose = labels.map_labels("label", {"A": "one"}, "Others", "propagate")
    got = cells.select(keep.alias("k"), lose.alias("l"), labels.ladder(
        (F.col("label") == "A", "x"), default="y", null_policy="propagate").alias("m")).orderBy("sample", "cell_id")
    rows = cells.orderBy("sample", "cell_id").select(keep.alias("k"), lose.alias("l")).collect()
    assert rows[4].k == "Others" and rows[4].l is None and rows[0].l == "one"
    assert {r.m for r in got.collect()} == {"x", "y", None}


def test_patterns_are_unanchored_and_first_only(tiny):
    counts, _, genes = tiny
    both = qc.flag_features(genes, {"ribo": ["RPS", "RPL"]})
    first = qc.flag_features(genes, {"ribo": ["RPS", "RPL"]}, first_only=True)
    assert {r.gene for r in both.filter("ribo").collect()} == {"g2", "g3", "g4"}
    assert {r.gene for r in first.filter("ribo").collect()} == {"g2", "g3"}


def test_cell_metrics_and_strict_limits(tiny):
    counts, cells, genes = tiny
    m = qc.cell_metrics(counts, qc.flag_features(genes, {"mt": "^MT-"}), ["mt"])
    got = {(r["sample"], r.cell_id): (r.n_count, r.n_feature, r.pct_mt) for r in m.collect()}
    assert got["s1", "c1"] == (10, 2, 40.0) and got["s2", "c2"] == (4, 3, 25.0)
    assert qc.qc_filter(m, 1, 40, 100).count() == 1       # 40 % is not below 40, one feature not above one
    zero = m.filter("cell_id = 'c2'").withColumn("pct_mt", F.lit(None).cast("double"))
    assert qc.qc_filter(zero, 0, 10, 100).count() == 0


def test_build_object_minimums(tiny):
    counts, cells, _ = tiny
    kept, built = reshape.build_cells(counts, cells, min_cells=2, min_features=2)
    assert {(r["sample"], r.cell_id) for r in built.collect()} == {("s1", "c1"), ("s2", "c2")}
    assert {r.gene for r in kept.collect()} == {"g1", "g2"}


def test_zeros_count_in_moments(tiny):
    counts, cells, _ = tiny
    got = {(r["sample"], r.gene): (r.mu, r["var"]) for r in normalize.gene_moments(counts, cells).collect()}
    # g2 in s1 is 6, 0, 0
    assert got["s1", "g2"] == pytest.approx((2.0, 12.0))
    assert got["s2", "g2"] == pytest.approx((3.0, 19.0))


def test_marker_summary_golden(tiny):
    counts, cells, _ = tiny
    v = normalize.log_normalize(counts, scale=10)
    got = {(r.gene, r.label): r for r in markers.marker_summary(
        v, cells.filter("label in ('A', 'B')"), ["g1", "g5"], "label").collect()}
    # A: c1 has 4 of 10, c2 10 of 10; B: c3 5 of 10 and s2/c1 nothing
    assert got["g1", "A"].avg_exp == pytest.approx(7.0) and got["g1", "A"].pct_exp == 100
    assert got["g1", "B"].avg_exp == pytest.approx(2.5) and got["g1", "B"].pct_exp == 50
    assert got["g1", "A"].avg_exp_scaled == pytest.approx(1 / math.sqrt(2))
    assert got["g5", "A"].avg_exp == 0 and got["g5", "A"].avg_exp_scaled is None
    one = markers.marker_summary(v, cells, ["g1"], "label", groups=["A"]).first()
    assert one.avg_exp_scaled == pytest.approx(math.log(8.0))


def test_multiplet_rate_edges(spark):
    n = [(100,), (500,), (501,), (1000,), (1001,), (20000,)]
    got = spark.createDataFrame(n, "n bigint").select(doublets.multiplet_rate(F.col("n")).alias("r"))
    assert [r.r for r in got.collect()] == pytest.approx([0.0008, 0.004, 0.004, 0.004, 0.008, 0.076])


def test_names(spark):
    df = spark.createDataFrame([("DIPG.1-a_b", "2x-1")], "a string, b string")
    got = df.select(text.before_first("a", "-"), text.before_first("a", "_"), text.before_first("a", "."),
                    text.mangle_name("b"), *text.split_key("a", ["x", "y", "z"])).first()
    assert tuple(got) == ("DIPG.1", "DIPG.1-a", "DIPG", "X2x.1", "DIPG.1-a", "b", None)


def test_resolution_must_have_been_run(spark):
    df = spark.createDataFrame([(0.1, 1)], "resolution double, cluster int")
    with pytest.raises(ValueError):
        reshape.choose_resolution(df, 0.15, [0.1])


def test_numbering_and_salted_join_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("sample"),
                                  (F.col("id") % 7).alias("score"), "id")
    got = number_rows(df, ["sample"], [F.desc("score"), F.asc("id")], "rk")
    exp = df.toPandas().sort_values(["sample", "score", "id"], ascending=[True, False, True])
    exp["rk"] = exp.groupby("sample").cumcount() + 1
    assert (got.toPandas().set_index("id").rk.sort_index() == exp.set_index("id").rk.sort_index()).all()
    side = spark.createDataFrame([("hot", 1), ("cold", 2)], "sample string, v int")
    assert salted_join(df, side, ["sample"], ["id"]).groupBy("v").count().orderBy("v").collect()[0][1] == 2500


def test_exact_quartiles_match_numpy(spark):
    import numpy as np
    df = spark.range(997).select(F.lit("a").alias("s"), F.sqrt((F.col("id") * 7919 % 311).cast("double")).alias("x"))
    got = qc.summary(df, "x", ["s"]).first()
    x = df.toPandas().x
    assert (got.v_q1, got.v_median, got.v_q3) == pytest.approx(tuple(np.quantile(x, [.25, .5, .75])))
    assert got.n == 997 and got.v_mean == pytest.approx(x.mean())


def test_union_keeps_absent_columns_missing(tiny, spark):
    _, cells, _ = tiny
    other = spark.createDataFrame([("s9", "c1", 3)], "sample string, cell_id string, depth int")
    got = reshape.unite_named({"a": cells, "b": other})
    assert got.count() == 7 and got.filter("dataset = 'b' and label is null and depth = 3").count() == 1


def test_best_row_with_text_ids(spark):
    from cytolake.operators import labels
    df = spark.createDataFrame([("s", "b", 3), ("s", "a", 3), ("s", "c", None), ("t", "x", None)], "sample string, cell_id string, v int")
    assert sorted(map(tuple, labels.best_row(df, ["sample"], "v", "cell_id", ["cell_id"]).collect())) == [("s", 3, "a"), ("t", None, "x")]


def test_resolution_tree_with_names_that_repeat(spark):
    from cytolake.operators import graph
    rows = [(s, c, r, k) for s in ("s1", "s2") for c in ("c1", "c2") for r, k in ((0.1, 0), (0.5, 1))]
    edges, _ = graph.resolution_tree(spark.createDataFrame(rows, "sample string, cell string, resolution double, cluster int"), key=("sample", "cell"))
    assert [r.n for r in edges.collect()] == [4]


def test_every_cell_is_a_parent_when_the_step_divides_the_cells(spark):
    from pyspark.sql import functions as F
    from cytolake.operators import doublets
    pairs = doublets.synthetic_pairs(spark.range(310).select(F.lit("s").alias("sample"), F.col("id").alias("cell_id")), 2.0)
    used = [r["count"] for r in pairs.groupBy("parent").count().collect()]
    assert len(used) == 310 and min(used) >= 3 and max(used) <= 6


def test_sample_ids_of_listed_other_and_missing_samples(spark):
    from cytolake.plans import atlas
    lung = spark.createDataFrame([(1, "P1_TI"), (2, "P4_NS"), (3, "P9_TX"), (4, None)], "cell_id int, sample string")
    got = {r.cell_id: (r.ID, r.tumor) for r in atlas.with_ids(lung, "lung").collect()}
    assert got == {1: ("Tumor_Lung1", "Tumor"), 2: ("Normal_Lung8", "Normal"), 3: ("Others", "Normal"), 4: ("Others", None)}
    pa = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "cell_id int, sample string")
    assert {r.cell_id: r.ID for r in atlas.with_ids(pa, "pa").collect()} == {1: "Tumor_Brain2", 2: "Tumor_Brain1", 3: "Tumor_Brain2", 4: None}
    assert atlas.whole_atlas({"lung": lung, "pa": pa}).count() == 5          # the listed tumour sample, and all of pa
    assert atlas.whole_atlas({"lung": lung.limit(0)}).count() == 0


def test_tissue_order_and_pathology_of_unknown_ids(spark):
    from cytolake.plans import atlas
    ids = spark.createDataFrame([("Tumor_Skin3",), ("GBM",), (None,)], "ID string")
    assert [(r.tissue1, r.tissue1_ord) for r in atlas.with_tissue(ids).collect()] == [("Skin", 8), ("Brain", 1), (None, None)]
    cells = spark.createDataFrame([("Astrocytoma", "Oligo"), ("MB", "TAM"), (None, None)], "ID string, celltype_broad string")
    assert [r.Pathology_celltype for r in atlas.with_pathology(cells).collect()] == ["Grade II Astrocytoma_Oligodendrocyte", "NA_TAM", "NA_NA"]
