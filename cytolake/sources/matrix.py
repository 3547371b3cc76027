"""Count matrices in text form: dense gene x cell files and coordinate triplets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import mangle_name
from ..runtime import cut_lineage

#: Default sample name: the folder that holds the file.
FOLDER = r"^(?:.*/)?([^/]+)/[^/]+$"


def sample_from_path(pattern: str = FOLDER) -> Column:
    """Sample name taken from the file path."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def _unquoted(c: Column) -> Column:
    return F.when(F.contains(c, F.lit('"')), F.regexp_replace(c, '^"|"$', "")).otherwise(c)


def read_dense(spark: SparkSession, path: str | Sequence[str], sep: str = ",", sample: str | Column = FOLDER,
               drop: Sequence[str] = (), corner: bool = True, mangle_names: bool = False) -> DataFrame:
    """Dense matrix files (plain or gzip): header of cell names, then one gene per line.

    Returns the non-zeros ``(sample, cell_id, gene, cnt)``. ``corner=False`` is for headers without a
    name above the gene column. ``drop`` leaves out columns that hold no cells.

    Lines are split and exploded with their column number, zeros dropped, and only then matched to the
    header's names by (file, number): an ordinary join on sparse rows, whatever the matrix width. A sample
    name taken from the path comes with the header's names, so the path is searched once per cell, not once per value.
    """
    by_path = isinstance(sample, str)
    place = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        place.alias("_at"), "value")
    header = cut_lineage(lines.filter(F.col("_start") == 0).groupBy("_file").agg(F.min_by("value", "_at").alias("value")))
    shift = 0 if corner else 1
    cells = header.select("_file", F.posexplode(F.split("value", _literal(sep))).alias("_p", "_c")).select(
        "_file", (F.col("_p") + shift).alias("_p"), _unquoted(F.col("_c")).alias("cell_id"),
        *([F.regexp_extract("_file", sample, 1).alias("sample")] if by_path else []))
    cells = cells.filter(F.col("_p") > 0).filter(~F.col("cell_id").isin(list(drop)) if drop else F.lit(True))
    if mangle_names:
        cells = cells.withColumn("cell_id", mangle_name("cell_id"))

    # one column per line: the reader itself skips the header line of every file
    body = (spark.read.schema("value STRING").option("header", True).option("sep", "\u0001").option("quote", "")
            .option("maxCharsPerColumn", -1).csv(path))
    quoted = F.regexp_extract("value", '^"([^"]*)"', 1)
    gene = F.when(F.col("value").startswith('"'), quoted).otherwise(F.substring_index("value", sep, 1))
    rest = F.when(F.col("value").startswith('"'), F.regexp_replace("value", '^"[^"]*"', "")).otherwise(
        F.expr("substring(value, length(substring_index(value, '%s', 1)) + 1)" % sep.replace("\t", "\\t")))
    own = [] if by_path else [sample.alias("sample")]
    long = body.select(F.col("_metadata.file_path").alias("_file"), *own, gene.alias("gene"),
                       F.posexplode(F.split(rest, _literal(sep))).alias("_p", "_v"))
    found = long.withColumn("cnt", _unquoted(F.col("_v")).try_cast("double")).drop("_v")
    return found.filter((F.col("_p") > 0) & (F.col("cnt") != 0)).join(cells, ["_file", "_p"]).select(
        "sample", "cell_id", "gene", "cnt")


def _literal(sep: str) -> str:
    return {"|": r"\|", ".": r"\."}.get(sep, sep)


def _numbered_lines(spark: SparkSession, path, sample) -> DataFrame:
    """Lines with their 1-based number within the sample, counted block by block.

    Part files follow each other in name order. The block layout is written down first: it may differ
    between two scans.
    """
    lines = cut_lineage(spark.read.text(path).select(
        sample_from_path(sample).alias("sample"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value"))
    blocks = lines.groupBy("sample", "_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("sample").orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_id") - F.col("_first") + F.col("_before") + 1
    return lines.join(blocks, ["_file", "_start"]).select("sample", number.alias("line"), "value")


def read_triplet_files(spark: SparkSession, matrix: str, features: str, cells: str, gene_column: int = 1,
                       sample: str = FOLDER) -> DataFrame:
    """Coordinate triplets with a features and a cells file; paths may be globs with one folder per sample.

    Returns ``(sample, cell_id, gene, cnt)``. ``gene_column`` picks the column of the features file.
    """
    # comments are skipped and the size line is taken as the header of each file by the reader
    triplets = (spark.read.schema("gene_idx BIGINT, cell_idx BIGINT, cnt DOUBLE").option("sep", " ")
                .option("comment", "%").option("header", True).csv(matrix)
                .select(sample_from_path(sample).alias("sample"), "gene_idx", "cell_idx", "cnt"))
    fields = F.split("value", "\t")
    genes = _numbered_lines(spark, features, sample).select(
        "sample", F.col("line").alias("gene_idx"), F.get(fields, F.lit(gene_column - 1)).alias("gene"))
    names = _numbered_lines(spark, cells, sample).select(
        "sample", F.col("line").alias("cell_idx"), F.get(fields, F.lit(0)).alias("cell_id"))
    return (triplets.join(genes, ["sample", "gene_idx"]).join(names, ["sample", "cell_idx"])
            .filter(F.col("cnt") != 0).select("sample", "cell_id", "gene", "cnt"))


def read_triplet_folders(spark: SparkSession, root: str, gene_column: int = 2) -> DataFrame:
    """One folder per sample under ``root``, each with matrix, features and barcodes (plain or gzip)."""
    return read_triplet_files(spark, f"{root}/*/matrix.mtx*", f"{root}/*/features.tsv*", f"{root}/*/barcodes.tsv*",
                              gene_column)
