"""Lineage cuts and skew-safe building blocks used by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the cluster names, a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            current = tempfile.mkdtemp(prefix="cytolake-")
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Lost executors then never replay the loop that built it, later reads are columnar, and Spark
    knows the true size when it chooses joins. (A reliable ``checkpoint()`` would also do, but it hands
    the plan's inferred constraints on, and those pile up over the rounds of a loop.)
    """
    path = stage_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stage table, beside the checkpoints."""
    return f"{checkpoint_root(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner", salts: int = 16) -> DataFrame:
    """Join on keys that may be hot (a sample, a batch): ``small`` has one row per key.

    Rows of ``big`` spread over ``salts`` sub-keys by a hash of ``spread``; ``small`` is
    repeated per sub-key, so its size grows by the constant ``salts`` only.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def running_total(df: DataFrame, group: Sequence[str], order: Sequence, weight, name: str) -> DataFrame:
    """Running sum of ``weight`` per group in the given order, for groups too large for one task.

    Rows are range-partitioned on (group, order) and summed inside each range; each range then adds
    the sums of the ranges before it. The ranges are materialised first, since their bounds come from
    sampling and must not change between the two uses.
    """
    group = list(group)
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in group], *order)
        .withColumns({"_range": F.spark_partition_id(), "_weight": weight}))
    sizes = ranged.groupBy(*group, "_range").agg(F.sum("_weight").alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (ranged.withColumn("_local", F.sum("_weight").over(inside))
            .join(offsets, [*group, "_range"])
            .withColumn(name, F.col("_local") + F.col("_before"))
            .drop("_range", "_weight", "_local", "_before"))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """``row_number`` (from 1) per group, for groups too large for one task."""
    return running_total(df, group, order, F.lit(1).cast("bigint"), name)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition by ``keys`` into as many parts as shuffles have; adaptive execution would join small parts, though each may be much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def into_chunks(df: DataFrame, group: Sequence[str], sizes: DataFrame, spread: Sequence[str],
                rows: int) -> DataFrame:
    """Add ``_chunk`` so that every (group, _chunk) holds about ``rows`` rows, however hot the group.

    ``sizes`` has one row per group with its row count ``_n``.
    """
    df = salted_join(df, sizes.select(*group, chunk_count(rows).alias("_chunks")), group, spread)
    return (df.withColumn("_chunk", F.pmod(F.xxhash64(*spread), F.col("_chunks")).cast("int"))
            .drop("_chunks"))


def chunk_count(rows: int):
    return F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(rows))).cast("int")


def per_chunk(model: DataFrame, group: Sequence[str], sizes: DataFrame, rows: int) -> DataFrame:
    """Repeat a per-group model table once per chunk of its group, for a cogroup with the data."""
    chunks = sizes.select(*group, chunk_count(rows).alias("_chunks"))
    return (model.join(chunks, list(group)).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
            .drop("_chunks"))


def cogrouped(left: DataFrame, right: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    """Cogroup two tables that may stem from the same one; the right one gets fresh column identities."""
    right = right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fn, schema)
