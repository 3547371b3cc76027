"""Declared schemas of the long-form tables the operators exchange."""

from pyspark.sql import types as T

COUNTS = T.StructType([
    T.StructField("sample", T.StringType()),
    T.StructField("cell_id", T.StringType()),
    T.StructField("gene", T.StringType()),
    T.StructField("cnt", T.DoubleType()),
])

GENES = T.StructType([
    T.StructField("gene", T.StringType()),
    T.StructField("gene_name", T.StringType()),
    T.StructField("chr", T.StringType()),
    T.StructField("pos", T.LongType()),
])

REGIONS = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("chr", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
])

EDGES = T.StructType([
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("w", T.DoubleType()),
])

#: Key of a cell; cell names alone may repeat across samples.
CELL_KEY = ["sample", "cell_id"]
