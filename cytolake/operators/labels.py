"""Label maps, conditional ladders, factors, frequencies and consensus labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.nulls import as_col, factor, is_in, level_ordinal, not_in
from ..runtime import salted_join


def keep_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is in the set."""
    return df.filter(is_in(column, values))


def drop_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is not in the set; rows with a missing value stay."""
    return df.filter(not_in(column, values))


def map_labels(c, mapping: Mapping, default=None, null_policy: str = "default") -> Column:
    """Value to label through a literal map, first entry wins.

    ``null_policy='default'`` gives a missing value the default (membership ladders);
    ``'propagate'`` keeps it missing (equality ladders).
    """
    if null_policy not in ("default", "propagate"):
        raise ValueError(null_policy)
    c = as_col(c)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    label = F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default)) if pairs else F.lit(default)
    if null_policy == "propagate":
        return F.when(c.isNotNull(), label)
    return F.when(c.isNull(), F.lit(default)).otherwise(label)


def ladder(*arms: tuple[Column, object], default=None, null_policy: str = "default") -> Column:
    """First true condition wins. With ``'propagate'`` an unknown condition ends the ladder with NULL."""
    if null_policy == "default":
        out = None
        for condition, label in arms:
            out = F.when(condition, label) if out is None else out.when(condition, label)
        return out.otherwise(F.lit(default))
    out = F.lit(default)
    for condition, label in reversed(arms):
        out = F.when(condition.isNull(), F.lit(None)).when(condition, F.lit(label)).otherwise(out)
    return out


def join_labels(df: DataFrame, column: str, labels: DataFrame, name: str, default=None) -> DataFrame:
    """Label through a ``labels(value, label)`` table; Spark picks the join by its measured size."""
    renamed = labels.select(F.col("value").alias(column), F.col("label").alias(name))
    joined = df.join(renamed, column, "left")
    return joined if default is None else joined.withColumn(name, F.coalesce(name, F.lit(default)))


def nth_level(df: DataFrame, column: str, name: str = "level") -> DataFrame:
    """Ordinal of each distinct value in sorted order, from the distinct values only."""
    levels = df.select(column).distinct().filter(F.col(column).isNotNull())
    ranked = levels.withColumn(name, F.dense_rank().over(W.orderBy(column)))
    return df.join(ranked, column, "left")


def remap_levels(df: DataFrame, column: str, labels: Sequence, name: str) -> DataFrame:
    """Positional relabelling: the k-th sorted level takes the k-th label."""
    place = F.array(*[F.lit(x) for x in labels])
    return nth_level(df, column, "_level").withColumn(
        name, F.get(place, F.col("_level") - 1)).drop("_level")


def as_factor(df: DataFrame, column: str, levels: Sequence) -> DataFrame:
    """Explicit level order: unlisted values become NULL, ``<column>_ord`` sorts by the list."""
    return df.withColumns({column: factor(column, levels), f"{column}_ord": level_ordinal(column, levels)})


def frequency(df: DataFrame, *columns: str) -> DataFrame:
    """One- or more-way contingency in long form."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence) -> DataFrame:
    """Two-way contingency in wide form over listed column levels, with zeros written out."""
    return df.groupBy(row).pivot(column, list(levels)).agg(F.count(F.lit(1))).na.fill(0)


def consensus(df: DataFrame, group: str, label: str, name: str) -> DataFrame:
    """Most frequent label per group; the smallest label wins a tie."""
    counted = frequency(df.filter(F.col(label).isNotNull()), group, label)
    best = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), label))
    return (counted.withColumn("_r", best).filter(F.col("_r") == 1)
            .select(group, F.col(label).alias(name), F.col("n").alias("n_votes")))


def best_row(df: DataFrame, by: Sequence[str], score: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The row with the highest score per group; the smallest ``tie``, of any ordered type, wins equals. Null scores come last."""
    row = F.struct(F.col(score), *[c for c in columns if c != score])
    key = F.struct(F.col(score).isNull(), -F.col(score), F.col(tie))
    return df.groupBy(*by).agg(F.min_by(row, key).alias("_r")).select(*by, "_r.*")


def by_size(df: DataFrame, cluster: str, cell: str, name: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """Number clusters from 0 by falling size; the smallest member breaks ties."""
    sizes = df.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("_n"), F.min(cell).alias("_m"))
    order = W.partitionBy(*by).orderBy(F.desc("_n"), "_m")
    ranked = sizes.select(*by, cluster, (F.row_number().over(order) - 1).cast("int").alias("_id"))
    return (salted_join(df, ranked, [*by, cluster], [cell])
            .drop(cluster).withColumnRenamed("_id", name))
