"""Per-cell quality metrics, filters on them, and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import name_matches
from ..runtime import cut_lineage, running_total, salted_join
from ..schema import CELL_KEY


def flag_features(genes: DataFrame, sets: Mapping[str, str | Sequence[str]],
                  first_only: bool = False) -> DataFrame:
    """``genes(gene, gene_name)`` with one boolean column per named pattern set."""
    return genes.select("gene", *[
        name_matches("gene_name", p, first_only).alias(n) for n, p in sets.items()])


def cell_metrics(counts: DataFrame, flagged: DataFrame | None = None, sets: Sequence[str] = ()) -> DataFrame:
    """Total, detected features and percentage of each flagged set, in one aggregation per cell."""
    if flagged is not None:
        counts = counts.join(flagged, "gene", "left")
    total = F.sum("cnt")
    shares = [
        F.try_divide(100.0 * F.sum(F.when(F.col(s), F.col("cnt")).otherwise(F.lit(0))), total).alias(f"pct_{s}")
        for s in sets]
    return counts.groupBy(*CELL_KEY).agg(
        total.alias("n_count"), F.count_if(F.col("cnt") != 0).alias("n_feature"), *shares)


def qc_filter(cells: DataFrame, min_features: int | None = 500, max_pct: float | None = 10,
              max_count: float | None = 50000, pct: str = "pct_mt") -> DataFrame:
    """Strict limits; a cell whose percentage is undefined is dropped. ``None`` skips a limit."""
    conditions = []
    if min_features is not None:
        conditions.append(F.col("n_feature") > min_features)
    if max_pct is not None:
        conditions.append(F.col(pct) < max_pct)
    if max_count is not None:
        conditions.append(F.col("n_count") < max_count)
    for c in conditions:
        cells = cells.filter(c)
    return cells


def gene_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gene").agg(
        F.sum("cnt").alias("total"), F.count_if(F.col("cnt") != 0).alias("n_cells"))


def expressed_genes(counts: DataFrame) -> DataFrame:
    """Rows of genes with any count."""
    kept = gene_totals(counts).filter(F.col("total") > 0)
    return counts.join(kept, "gene", "left_semi")


def supported_genes(counts: DataFrame, listed: DataFrame, min_cells: int = 5) -> DataFrame:
    """Rows of genes that are listed and expressed in at least ``min_cells`` cells."""
    kept = gene_totals(counts.join(listed.select("gene"), "gene", "left_semi"))
    return counts.join(kept.filter(F.col("n_cells") >= min_cells), "gene", "left_semi")


def deep_cells(counts: DataFrame, above: float = 25500) -> DataFrame:
    """Rows of cells whose total exceeds ``above``."""
    kept = counts.groupBy(*CELL_KEY).agg(F.sum("cnt").alias("_t")).filter(F.col("_t") > above)
    return counts.join(kept, CELL_KEY, "left_semi")


def drop_shallow_clusters(cells: DataFrame, cluster: str, min_median: float,
                          feature: str = "n_feature") -> DataFrame:
    """Remove whole clusters whose median detected features is below a limit."""
    kept = median_by(cells, cluster, feature, "_m").filter(F.col("_m") >= min_median)
    return cells.join(kept, cluster, "left_semi")


def median_by(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Exact median of an integer metric.

    The aggregate keeps one count per distinct value, which the feature universe bounds.
    """
    return df.groupBy(group).agg(F.median(value).alias(name))


def cells_per_sample(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"))


def expected_doublet_rate(cells: DataFrame, per_thousand: float = 0.008) -> DataFrame:
    """Rate per sample from the number of cells given (those before quality filtering)."""
    return cells_per_sample(cells).withColumn(
        "doublet_rate", F.lit(per_thousand) * F.col("n_cells") / F.lit(1000))


def with_rate(cells: DataFrame, rates: DataFrame) -> DataFrame:
    """Pair each sample's cells with its rate."""
    return salted_join(cells, rates, ["sample"], ["cell_id"], how="left")


def summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, minimum, quartiles, mean and maximum per group."""
    return _five_numbers(df.select(*by, F.col(value).cast("double").alias("value")), by)


def distribution(cells: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Distribution of each quality metric per group (and class)."""
    long = cells.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(by), list(metrics), "metric", "value")
    return _five_numbers(long, ["metric", *by])


def _five_numbers(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact interpolated quartiles without holding a group's values in one task.

    Equal values are counted first; running counts over ranges of (group, value) then say which
    values cover the two places each quartile lies between.
    """
    by = list(by)
    counted = df.filter(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_c"))
    placed = cut_lineage(running_total(counted, by, [F.asc("value")], F.col("_c"), "_upto"))
    whole = placed.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.min("value").alias("v_min"), F.max("value").alias("v_max"),
        (F.sum(F.col("value") * F.col("_c")) / F.sum("_c")).alias("v_mean"))
    at = salted_join(placed, whole.select(*by, "n"), by, ["value"])

    def covering(place: Column) -> Column:
        inside = (F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto"))
        return F.max(F.when(inside, F.col("value")))

    picks, out = [], {}
    for name, p in (("v_q1", 0.25), ("v_median", 0.5), ("v_q3", 0.75)):
        h = (F.col("n") - 1) * F.lit(p)
        picks += [covering(F.floor(h)).alias(f"_{name}_lo"), covering(F.ceil(h)).alias(f"_{name}_hi")]
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out[name] = low + (high - low) * (h - F.floor(h))
    quartiles = at.groupBy(*by).agg(*picks)
    return whole.join(quartiles, by).withColumns(out).select(
        *by, "n", "v_min", "v_q1", "v_median", "v_mean", "v_q3", "v_max")


def histogram(df: DataFrame, value: Column, width: float, by: Sequence[str] = (), low: float = 0.0) -> DataFrame:
    """Counts in fixed-width bins ``[low + i*width, low + (i+1)*width)``."""
    return (df.withColumn("bin", F.floor((value - F.lit(low)) / F.lit(width)).cast("int"))
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_low", F.lit(low) + F.col("bin") * F.lit(width)))
