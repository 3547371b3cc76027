"""Metadata, region and stage tables; delimited export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import REGIONS
from .matrix import FOLDER, sample_from_path


def read_metadata(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Per-cell attributes from a delimited file with a declared schema."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Chromosome regions: name, chromosome, start, end, tab-separated with a header."""
    return spark.read.schema(REGIONS).option("header", True).option("sep", "\t").csv(path)


def discover(spark: SparkSession, glob: str, pattern: str = FOLDER) -> DataFrame:
    """Input files with the sample each belongs to, without reading their content."""
    files = spark.read.format("binaryFile").load(glob).select("path", "length")
    return files.withColumn("sample", F.regexp_extract("path", pattern, 1))


def discover_rows(spark: SparkSession, glob: str, pattern: str = FOLDER) -> DataFrame:
    """Lines of all matching files, tagged with their sample."""
    return spark.read.text(glob).select(sample_from_path(pattern).alias("sample"), "value")


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Materialise a stage as Parquet, by default unpartitioned; ``['sample']`` prunes later reads."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", compression: str = "none") -> None:
    """Delimited export with a header, one file per partition."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("compression", compression).csv(path)
