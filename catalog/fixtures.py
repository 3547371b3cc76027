"""The driver's tables seen as count tables, once as DataFrames and once as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def purchases(spark, sf):
    """Line items with their customer: one read of the three tables, needed columns only."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return (li.join(orders, li.l_orderkey == orders.o_orderkey)
            .join(cust, orders.o_custkey == cust.c_custkey))


def counts(spark, sf):
    """sample = market segment, cell = customer, feature = part."""
    return (purchases(spark, sf)
            .groupBy(F.col("c_mktsegment").alias("sample"), F.col("o_custkey").alias("cell_id"),
                     F.col("l_partkey").alias("gene"))
            .agg(F.sum("l_quantity").cast("bigint").alias("cnt")))


def brand_counts(spark, sf):
    """The same cells with the 25 brands as features."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    bought = purchases(spark, sf)
    return (bought.join(part, bought.l_partkey == part.p_partkey)
            .groupBy(F.col("c_mktsegment").alias("sample"), F.col("o_custkey").alias("cell_id"),
                     F.col("p_brand").alias("gene"))
            .agg(F.sum("l_quantity").cast("bigint").alias("cnt")))


def genes(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("gene"),
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("gene_name"),
        F.col("p_brand").alias("chr"), F.col("p_size").alias("pos"))


def cells(spark, sf):
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return (table(spark, sf, "customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_mktsegment").alias("sample"), F.col("c_custkey").alias("cell_id"),
                    F.col("n_nationkey").alias("cluster"), "n_name", F.col("r_name").alias("grp")))


def regions(spark, sf):
    arms = F.array(F.struct(F.lit("p").alias("arm"), F.lit(1).alias("start"), F.lit(25).alias("end")),
                   F.struct(F.lit("q").alias("arm"), F.lit(26).alias("start"), F.lit(50).alias("end")))
    return (table(spark, sf, "part").select(F.col("p_brand").alias("chr")).distinct()
            .select("chr", F.explode(arms).alias("a"))
            .select(F.concat("chr", "a.arm").alias("region"), "chr", "a.start", "a.end"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.lit("all").alias("sample"), F.col("vec_id").alias("cell_id"),
        F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("batch"))


def token_counts(spark, sf):
    """sample = language, cell = document, feature = token of the whole text."""
    texts = table(spark, sf, "documents").select(F.col("lang").alias("sample"), F.col("doc_id").alias("cell_id"), "text")
    # whole texts are dealt by cell, so tokens are counted and summed where they are; small parts, since words take far more room than their text
    dealt = texts.repartition(16 * texts.rdd.getNumPartitions(), "sample", "cell_id")
    return (dealt.select("sample", "cell_id", F.explode(F.split("text", "[ \n\r\t]+")).alias("gene"))
            .filter(F.col("gene") != "").groupBy("sample", "cell_id", "gene")
            .agg(F.count(F.lit(1)).alias("cnt")))


VIEWS = {
    "counts": """SELECT c_mktsegment AS sample, o_custkey AS cell_id, l_partkey AS gene,
        CAST(SUM(l_quantity) AS BIGINT) AS cnt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY 1, 2, 3""",
    "brand_counts": """SELECT c_mktsegment AS sample, o_custkey AS cell_id, p_brand AS gene,
        CAST(SUM(l_quantity) AS BIGINT) AS cnt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "genes": """SELECT p_partkey AS gene, concat(p_brand, '-', CAST(p_partkey AS VARCHAR)) AS gene_name,
        p_brand AS chr, p_size AS pos FROM part""",
    "cells": """SELECT c_mktsegment AS sample, c_custkey AS cell_id, n_nationkey AS cluster, n_name,
        r_name AS grp FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "regions": """SELECT chr || arm AS region, chr, s AS "start", e AS "end"
        FROM (SELECT DISTINCT p_brand AS chr FROM part)
        CROSS JOIN (VALUES ('p', 1, 25), ('q', 26, 50)) a(arm, s, e)""",
    "vectors": """SELECT 'all' AS sample, vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS vec,
        label AS batch FROM embeddings""",
    "token_counts": """SELECT lang AS sample, doc_id AS cell_id, gene, COUNT(*) AS cnt
        FROM (SELECT lang, doc_id, unnest(regexp_split_to_array(text, '[ \\n\\r\\t]+')) AS gene FROM documents)
        WHERE gene <> '' GROUP BY 1, 2, 3""",
    # derived views, each built on the ones above
    "metrics": """SELECT sample, cell_id, CAST(SUM(cnt) AS BIGINT) AS n_count, COUNT(*) AS n_feature,
        100.0 * SUM(CASE WHEN regexp_matches(gene_name, '^Brand#2-') THEN cnt ELSE 0 END) / SUM(cnt) AS pct_mt,
        100.0 * SUM(CASE WHEN regexp_matches(gene_name, 'Brand#1|Brand#3') THEN cnt ELSE 0 END) / SUM(cnt) AS pct_ribo
        FROM counts JOIN genes USING (gene) GROUP BY 1, 2""",
    "passing": "SELECT * FROM metrics WHERE n_feature > 30 AND pct_mt < 10 AND n_count < 1400",
    "described": "SELECT m.*, c.cluster, c.n_name, c.grp FROM metrics m LEFT JOIN cells c USING (sample, cell_id)",
    "lognorm": """SELECT sample, cell_id, gene, cnt,
        ln(1 + cnt / SUM(cnt) OVER (PARTITION BY sample, cell_id) * 10000) AS v FROM counts""",
    "brand_lognorm": """SELECT sample, cell_id, gene, cnt,
        ln(1 + cnt / SUM(cnt) OVER (PARTITION BY sample, cell_id) * 10000) AS v FROM brand_counts""",
    "per_sample": "SELECT sample, COUNT(*) AS n FROM cells GROUP BY 1",
}

NEEDS = {
    "metrics": ["counts", "genes"], "passing": ["metrics"], "described": ["metrics", "cells"],
    "lognorm": ["counts"], "brand_lognorm": ["brand_counts"], "per_sample": ["cells"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """``WITH`` the named views (and what they need, in order) in front of ``body``."""
    ordered: list[str] = []

    def need(n):
        for m in NEEDS.get(n, []):
            need(m)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        need(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
