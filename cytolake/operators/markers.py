"""Per-group marker expression summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.nulls import is_in
from ..schema import CELL_KEY


def marker_summary(values: DataFrame, cells: DataFrame, features: Sequence, group: str,
                   groups: Sequence | None = None, clip: float = 2.5, value: str = "v") -> DataFrame:
    """Mean expression, share of expressing cells and z-score across groups, per feature and group.

    ``values`` holds non-zero normalised expression; group sizes come from ``cells``, so cells
    without a row count as zeros. ``groups`` keeps only these groups before the summary.
    """
    if groups is not None:
        cells = cells.filter(is_in(group, groups))
    members = cells.select(*CELL_KEY, group)
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells"))
    grid = sizes.withColumn("gene", F.explode(F.array(*[F.lit(f) for f in features])))
    v = F.col(value)
    found = (values.filter(is_in("gene", features)).select(*CELL_KEY, "gene", value)
             .join(members, CELL_KEY).groupBy("gene", group)
             .agg(F.sum(F.exp(v) - F.lit(1.0)).alias("_s"), F.count_if(v > 0).alias("_p")))
    table = grid.join(found, ["gene", group], "left").select(
        "gene", group, "n_cells",
        (F.coalesce("_s", F.lit(0.0)) / F.col("n_cells")).alias("avg_exp"),
        (100.0 * F.coalesce("_p", F.lit(0)) / F.col("n_cells")).alias("pct_exp"))
    return across_groups(table, "gene", "avg_exp", "avg_exp_scaled", clip)


def across_groups(df: DataFrame, key: str, value: str, name: str, clip: float = 2.5) -> DataFrame:
    """z-score of ``ln(1 + value)`` over the groups of each key, clipped; a lone group is not scaled."""
    w = W.partitionBy(key)
    y = F.ln(F.lit(1.0) + F.col(value))
    z = F.try_divide(F.col("_y") - F.avg("_y").over(w), F.stddev_samp("_y").over(w))
    # equal values in all groups have no score (least and greatest would skip the NULL)
    clipped = F.when(F.col("_z").isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("_z"))))
    return (df.withColumn("_y", y).withColumn("_z", z)
            .withColumn(name, F.when(F.count(F.lit(1)).over(w) == 1, F.col("_y")).otherwise(clipped))
            .drop("_y", "_z"))
