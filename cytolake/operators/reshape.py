"""Construction, projection, reshaping, unions and joins of count tables and cell metadata."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schema import CELL_KEY


def build_cells(counts: DataFrame, metadata: DataFrame | None = None, min_cells: int = 0,
                min_features: int = 0) -> tuple[DataFrame, DataFrame]:
    """Count table and cell table of one object: totals derived, metadata attached by key.

    ``min_cells`` drops genes seen in fewer cells, then ``min_features`` drops cells with fewer genes.
    """
    counts = sparsify(counts)
    if min_cells > 0:
        counts = counts.join(
            counts.groupBy("gene").count().filter(F.col("count") >= min_cells), "gene", "left_semi")
    cells = counts.groupBy(*CELL_KEY).agg(
        F.sum("cnt").alias("n_count"), F.count(F.lit(1)).alias("n_feature"))
    if min_features > 0:
        cells = cells.filter(F.col("n_feature") >= min_features)
        counts = counts.join(cells, CELL_KEY, "left_semi")
    if metadata is not None:
        cells = attach(cells, metadata, CELL_KEY)
    return counts, cells


def attach(df: DataFrame, metadata: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of attributes on the cell key; cells without attributes stay."""
    return df.join(metadata, list(on), "left")


def restrict(counts: DataFrame, kept: DataFrame, on: Sequence[str] = tuple(CELL_KEY)) -> DataFrame:
    """Rows whose key is in ``kept`` (cells after a filter, or a feature set with ``on=['gene']``)."""
    return counts.join(kept.select(*on), list(on), "left_semi")


def prefix_cells(df: DataFrame, prefix: str = "sample", cell: str = "cell_id", sep: str = "_") -> DataFrame:
    """Make cell names unique across samples."""
    return df.withColumn(cell, F.concat_ws(sep, F.col(prefix), F.col(cell)))


def tag(df: DataFrame, **constants) -> DataFrame:
    """Constant metadata columns (dataset, tissue, sample name)."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def copy_columns(df: DataFrame, **sources: str) -> DataFrame:
    """``copy_columns(df, cluster='res_0.3')``: new column from an existing one."""
    return df.withColumns({new: F.col(f"`{old}`") for new, old in sources.items()})


def choose_resolution(clusters: DataFrame, resolution: float, run: Sequence[float]) -> DataFrame:
    """Cluster column of one resolution out of the long cluster table."""
    if resolution not in run:
        raise ValueError(f"resolution {resolution} was not run, have {list(run)}")
    return clusters.filter(F.col("resolution") == F.lit(float(resolution))).drop("resolution")


def rename_matching(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Rename the column whose generated name matches ``pattern``."""
    hits = [c for c in df.columns if re.search(pattern, c)]
    if len(hits) != 1:
        raise ValueError(f"{pattern!r} matches {hits}")
    return df.withColumnRenamed(hits[0], name)


def sparsify(df: DataFrame, value: str = "cnt") -> DataFrame:
    """Drop explicit zeros."""
    return df.filter(F.col(value) != 0)


def densify(counts: DataFrame, genes: Sequence[str], cells: DataFrame, value: str = "cnt") -> DataFrame:
    """Write out the zeros of a listed feature set for every cell.

    The grid comes from exploding the literal list on the cell table, so no row pairs are joined.
    """
    grid = cells.select(*CELL_KEY).withColumn(
        "gene", F.explode(F.array(*[F.lit(g) for g in genes])))
    return (grid.join(counts.select(*CELL_KEY, "gene", value), [*CELL_KEY, "gene"], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(0).cast(counts.schema[value].dataType))))


def equal_width_chunks(df: DataFrame, index: str, k: int, name: str = "chunk") -> DataFrame:
    """k equal-width intervals of an index, open on the left, numbered from 1.

    The two ends are scalar subqueries; the lowest value belongs to the first interval.
    """
    low, high = df.agg(F.min(index)).scalar(), df.agg(F.max(index)).scalar()
    place = F.ceil(F.try_divide((F.col(index) - low) * F.lit(k), high - low))
    return df.withColumn(
        name, F.least(F.lit(k), F.greatest(F.lit(1), F.coalesce(place, F.lit(1)))).cast("int"))


def unite(*tables: DataFrame) -> DataFrame:
    """Append datasets by column name; columns one side lacks are NULL, absent genes stay absent."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def unite_named(tables: Mapping[str, DataFrame], key: str = "dataset") -> DataFrame:
    """Append datasets, each tagged with its name."""
    return unite(*[t.withColumn(key, F.lit(name)) for name, t in tables.items()])


def to_wide(df: DataFrame, key: str, columns: str, value: str, names: Sequence) -> DataFrame:
    """Long to wide for a listed, narrow set of columns."""
    return df.groupBy(key).pivot(columns, list(names)).agg(F.first(value))


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)
