"""Readers and writers (sections A and B): the driver's tables are written out, read back and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytolake.operators import normalize, reshape
from cytolake.runtime import cut_lineage, number_rows, stage_path
from cytolake.sources import matrix as mx, tables

from . import fixtures as fx
from .basic import r6
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


def nations(s, d):
    """Columns of the dense table: a name for every nation that has a customer."""
    return [f"n{r[0]}" for r in fx.table(s, d, "customer").select("c_nationkey").distinct().orderBy("c_nationkey").collect()]


DENSE = sql("""SELECT 'parts' AS sample, 'n' || CAST(c_nationkey AS VARCHAR) AS cell_id, CAST(l_partkey AS VARCHAR) AS gene,
    CAST(SUM(l_quantity) AS DOUBLE) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey GROUP BY 2, 3""")


def dense_table(s, d):
    """Parts in rows, the 25 nations in columns, zeros written out."""
    sums = fx.purchases(s, d).groupBy(
        F.col("l_partkey").cast("string").alias("Gene"), F.concat(F.lit("n"), "c_nationkey").alias("nation")).agg(
        F.sum("l_quantity").cast("bigint").alias("cnt"))
    return reshape.to_wide(sums, "Gene", "nation", "cnt", nations(s, d)).na.fill(0)


def written(s, d, name, **how):
    path = stage_path(s, name) + "/parts"
    tables.write_delimited(dense_table(s, d), path, **how)
    return path


@register("a1_dense_csv", DENSE)
def a1(s, d):
    return mx.read_dense(s, written(s, d, "csv", sep=",") + "/*.csv")


@register("a2_dense_tsv_gz", DENSE)
def a2(s, d):
    return mx.read_dense(s, written(s, d, "tsv", sep="\t", compression="gzip") + "/*.csv.gz", sep="\t")


@register("a3_cell_metadata", sql("SELECT sample, cell_id, cluster, n_name, grp FROM cells", "cells"))
def a3(s, d):
    path = stage_path(s, "metadata")
    tables.write_delimited(fx.cells(s, d), path)
    return tables.read_metadata(s, path, "sample string, cell_id bigint, cluster int, n_name string, grp string", "\t")


def triplet_folders(s, d):
    """One folder per market segment: features and barcodes in line order, and the coordinates.

    Every file set is written by many tasks; part files follow each other in name order.
    """
    root = stage_path(s, "triplets")
    segments = [r[0] for r in fx.table(s, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    listed = fx.genes(s, d).select(
        F.explode(F.array(*[F.lit(x) for x in segments])).alias("sample"), "gene", "gene_name")
    genes = cut_lineage(number_rows(listed, ["sample"], [F.asc("gene")], "gi"))
    cells = cut_lineage(number_rows(fx.cells(s, d).select("sample", "cell_id"), ["sample"], [F.asc("cell_id")], "ci"))

    def in_order(df, place, value, name):
        (df.repartitionByRange("sample", place).sortWithinPartitions("sample", place)
         .select("sample", value.alias("value")).write.partitionBy("sample").text(f"{root}/{name}"))

    in_order(genes, "gi", F.concat_ws("\t", F.col("gene").cast("string"), "gene_name"), "features")
    in_order(cells, "ci", F.concat(F.lit("c"), "cell_id"), "barcodes")
    body = (fx.counts(s, d).join(genes.select("sample", "gene", "gi"), ["sample", "gene"])
            .join(cells, ["sample", "cell_id"]).select("sample", "gi", "ci", "cnt"))
    body.write.partitionBy("sample").option("header", True).option("sep", " ").csv(f"{root}/matrix")
    return [f"{root}/{x}/*/*" for x in ("matrix", "features", "barcodes")]


TRIPLETS = sql("""SELECT sample, 'c' || CAST(cell_id AS VARCHAR) AS cell_id, {gene} AS gene, CAST(cnt AS DOUBLE) AS cnt
    FROM counts JOIN genes USING (gene)""", "counts", "genes")
IN_FOLDER = r"sample=([^/]+)/[^/]+$"


@register("a4_triplet_folders", TRIPLETS.replace("{gene}", "gene_name"))
def a4(s, d):
    return mx.read_triplet_files(s, *triplet_folders(s, d), gene_column=2, sample=IN_FOLDER)


@register("a5_triplet_files", TRIPLETS.replace("{gene}", "CAST(gene AS VARCHAR)"))
def a5(s, d):
    return mx.read_triplet_files(s, *triplet_folders(s, d), gene_column=1, sample=IN_FOLDER)


@register("e2_triplet_index_join", sql(
    """SELECT sample, COUNT(*) AS n, COUNT(DISTINCT cell_id) AS n_cells, COUNT(DISTINCT gene) AS n_genes,
       CAST(SUM(cnt) AS DOUBLE) AS total FROM counts GROUP BY 1""", "counts"))
def e2(s, d):
    named = a4(s, d)
    return named.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("n_cells"),
        F.countDistinct("gene").alias("n_genes"), F.sum("cnt").alias("total"))


@register("a6_region_table", sql(
    'SELECT region, chr, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM regions', "regions"))
def a6(s, d):
    path = stage_path(s, "regions")
    tables.write_delimited(fx.regions(s, d), path)
    return tables.read_regions(s, path)


@register("a7_stage_read", sql("SELECT sample, cell_id, gene, cnt FROM counts WHERE sample <> 'BUILDING'", "counts"))
def a7(s, d):
    path = stage_path(s, "counts")
    tables.write_stage(fx.counts(s, d), path, ["sample"])
    return tables.read_stage(s, path).filter(F.col("sample") != "BUILDING").select("sample", "cell_id", "gene", "cnt")


@register("a8_source_discovery", sql(
    "SELECT sample, COUNT(*) AS n_rows FROM counts GROUP BY 1", "counts"))
def a8(s, d):
    path = stage_path(s, "samples")
    fx.counts(s, d).select("sample", F.concat_ws(" ", "cell_id", "gene", "cnt").alias("value")).write.partitionBy(
        "sample").text(path)
    rows = tables.discover_rows(s, f"{path}/*/*.txt", r"sample=([^/]+)/[^/]+$")
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n_rows"))


@register("b1_stage_write", sql("SELECT sample, cell_id, gene, round(v, 6) AS v FROM lognorm", "lognorm"))
def b1(s, d):
    path = stage_path(s, "lognorm")
    tables.write_stage(normalize.log_normalize(fx.counts(s, d)), path, ["sample"])
    return tables.read_stage(s, path).select("sample", "cell_id", "gene", r6("v"))


@register("b2_delimited_export", f"SELECT cell_id, gene, cnt FROM ({DENSE})")
def b2(s, d):
    path = written(s, d, "export", sep="\t")
    names = nations(s, d)
    wide = s.read.schema("Gene string, " + ", ".join(f"{n} double" for n in names)).option("header", True).option(
        "sep", "\t").csv(path)
    return reshape.sparsify(reshape.to_long(wide.withColumnRenamed("Gene", "gene"), ["gene"], names, "cell_id", "cnt"))
