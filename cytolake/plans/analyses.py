"""The three end-to-end analyses, each a chain of operators over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.nulls import paste
from ..operators import batch, doublets, graph, labels, markers, normalize, pca, qc, regions, reshape
from ..runtime import cut_lineage
from ..schema import CELL_KEY
from .presets import HUMAN, Preset


def clean_cells(counts: DataFrame, genes: DataFrame, metadata: DataFrame | None = None,
                preset: Preset = HUMAN) -> tuple[DataFrame, DataFrame]:
    """Quality metrics, filter, doublet scores and their filter: ``(counts, cells)`` that remain.

    The expected doublet rate comes from the cells before the quality filter.
    """
    flagged = qc.flag_features(genes, {"mt": preset.mt_pattern, "ribo": preset.ribo_patterns})
    everything = cut_lineage(qc.cell_metrics(counts, flagged, ["mt", "ribo"]))
    rates = qc.expected_doublet_rate(everything)
    cells = cut_lineage(qc.qc_filter(everything, preset.min_features, preset.max_pct_mt, preset.max_count))
    scored = doublets.doublet_scores(reshape.restrict(counts, cells), cells, rates, n_features=preset.n_features)
    cells = doublets.keep_low_scores(scored, preset.max_doublet_score)
    if metadata is not None:
        cells = reshape.attach(cells, metadata, CELL_KEY)
    cells = cut_lineage(cells)
    return cut_lineage(reshape.restrict(counts, cells)), cells


def choose_features(counts: DataFrame, cells: DataFrame, preset: Preset = HUMAN) -> DataFrame:
    """Consensus over the groups of ``features_by`` (columns of the cells) of each group's most variable features.

    Cells where such a column is missing belong to no group and have no vote.
    """
    by = list(preset.features_by)
    extra = [c for c in by if c not in counts.columns]
    if extra:
        counts = cut_lineage(reshape.attach(counts, cells.select(*CELL_KEY, *extra), CELL_KEY))
    ranked = normalize.variable_features(counts, cells, preset.n_features, preset.trend, by)
    return normalize.consensus_features(ranked, preset.n_features)


def cluster_cells(counts: DataFrame, cells: DataFrame, preset: Preset = HUMAN) -> tuple[DataFrame, DataFrame]:
    """Features, components, batch correction, graph, communities: ``(clusters, embedding)``.

    ``clusters(sample, cell_id, resolution, cluster)`` for every resolution of the preset.
    """
    chosen = cut_lineage(choose_features(counts, cells, preset))
    values = normalize.log_normalize(counts, cells)
    scaled, genes = normalize.scale(values, cells, chosen)
    embedding, _, _ = pca.fit(scaled, genes, cells, preset.n_pcs)
    embedding = embedding.withColumn("vec", F.slice("vec", 1, preset.dims))
    if preset.batches:
        extra = [b for b in preset.batches if b not in CELL_KEY]
        with_batch = reshape.attach(embedding, cells.select(*CELL_KEY, *extra), CELL_KEY) if extra else embedding
        embedding = batch.harmony(with_batch, preset.batches, preset.lam).select(*CELL_KEY, "vec")
    embedding = cut_lineage(embedding)
    # cell names may repeat across samples, so the graph runs on joint names
    named = embedding.select(F.lit("all").alias("g"), paste("sample", "cell_id", sep="\u0001").alias("id"), "vec")
    near, copies = graph.knn(named, preset.k, ["g"], "id", spell=False)
    members, edges = graph.snn(near, preset.k, by=["g"], copies=copies)
    found = graph.communities(members, edges, list(preset.resolutions), ["g"])
    keys = embedding.select(*CELL_KEY, paste("sample", "cell_id", sep="\u0001").alias("cell"))
    return found.join(keys, "cell").select(*CELL_KEY, "resolution", "cluster"), embedding


def annotate(counts: DataFrame, genes: DataFrame, metadata: DataFrame | None = None, preset: Preset = HUMAN,
             cell_types: Mapping[str, Sequence[int]] | None = None, default: str | None = "Others",
             tissue: str | None = None) -> DataFrame:
    """Raw counts to labelled cells of one dataset."""
    counts, cells = clean_cells(counts, genes, metadata, preset)
    clusters, _ = cluster_cells(counts, cells, preset)
    chosen = reshape.choose_resolution(clusters, preset.resolution, preset.resolutions)
    cells = reshape.attach(cells, chosen, CELL_KEY)
    if preset.min_median_features is not None:
        cells = qc.drop_shallow_clusters(cells, "cluster", preset.min_median_features)
    if cell_types is not None:
        by_cluster = {c: name for name, cs in cell_types.items() for c in cs}
        cells = cells.withColumn("celltype_broad", labels.map_labels("cluster", by_cluster, default))
    return cells if tissue is None else reshape.tag(cells, tissue=tissue)


def marker_figure(datasets: Mapping[str, tuple[DataFrame, DataFrame]], features: Sequence[str], group: Sequence[str],
                  levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Marker summary across datasets ``{name: (counts, cells)}`` by a composite key, split again.

    ``group`` names the one or two columns of the key; ``levels`` orders them and empties unlisted values.
    """
    counts = reshape.unite(*[reshape.prefix_cells(c.withColumn("dataset", F.lit(n)), "dataset")
                             for n, (c, _) in datasets.items()])
    cells = reshape.unite(*[reshape.prefix_cells(c.withColumn("dataset", F.lit(n)), "dataset")
                            for n, (_, c) in datasets.items()])
    for column, order in (levels or {}).items():
        cells = labels.as_factor(cells, column, order)
    cells = cells.withColumn("_key", paste(*group))
    found = markers.marker_summary(normalize.log_normalize(counts), cells, features, "_key")
    parts = cells.select("_key", *[F.coalesce(F.col(g).cast("string"), F.lit("NA")).alias(g) for g in group]).distinct()
    return found.join(parts, "_key")          # not split from the key: labels may hold its separator


def malignant_cells(counts: DataFrame, genes: DataFrame, region_table: DataFrame, watched: Sequence[str],
                    min_cells: int = 5, clusters: int = 4, rounds: int | None = None) -> DataFrame:
    """Copy-number call per cell: log2 expression, region means, mixtures, profile clusters, label."""
    values = normalize.to_log2(normalize.log_normalize(counts, scale=1e6), name="v2").drop("v")
    kept = cut_lineage(qc.supported_genes(values, genes, min_cells))
    used = genes.join(kept.select("gene").distinct(), "gene", "left_semi")
    factors = normalize.normalizing_factor(kept, used, "v2")
    means = regions.region_means(kept, factors, regions.genes_in_regions(used, region_table), value="v2")
    _, posteriors = regions.region_mixture(regions.region_zscores(means), rounds)
    profiles = regions.profile_scores(posteriors, watched)
    return regions.malignant_call(regions.profile_clusters(profiles, watched, clusters))
