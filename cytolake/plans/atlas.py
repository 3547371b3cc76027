"""Annotated datasets under common sample IDs, tissues, pathologies and labels, and their union.

Every step is a column over a short literal map or a union by name, so nothing is joined or shuffled; only the sample levels of the
dataset that numbers its samples by sorted name are found first, from its distinct names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.nulls import paste
from ..operators import labels, reshape
from . import label_maps

# What the names of tumour samples hold, per dataset that also has normal samples.
TUMOR_NAMES = {"thyroid": "AT|PT", "lung": "TI|TM|TS", "ovary": "HGSOC"}
# Datasets of which the union takes tumour cells only.
TUMOR_ONLY = ("thyroid", "lung", "colon", "ovary")


def with_ids(cells: DataFrame, dataset: str) -> DataFrame:
    """``ID`` by sample and ``tumor`` (Tumor or Normal) of one dataset. A sample that is not listed, or missing, has the ID Others,
    unless the dataset gives all others one ID; where names are numbered in sorted order, or tell tumour from normal, a missing one leaves
    that column missing. ``colon`` tells normal cells by its column ``condition``."""
    if dataset == "pa":
        numbered = labels.nth_level(cells, "sample", "_level")
        return numbered.withColumns({"ID": F.concat(F.lit("Tumor_Brain"), "_level"), "tumor": F.lit("Tumor")}).drop("_level")
    if dataset == "hgg":
        kind = labels.map_labels("tumor", {"GBM": "GBM", "DIPG": "DIPG"}, "Others")
        return cells.withColumns({"ID": kind, "tumor": F.lit("Tumors")})
    named, others = label_maps.SAMPLE_IDS[dataset] if dataset in label_maps.SAMPLE_IDS else (label_maps.sample_ids(dataset), "Others")
    normal = F.lit(False)
    if dataset == "colon":
        normal = F.col("condition") == "Normal"
    elif dataset == "mouse_colon":
        normal = F.col("sample") == "WT"
    elif dataset in TUMOR_NAMES:
        normal = ~F.col("sample").rlike(TUMOR_NAMES[dataset])
    return cells.withColumns({"ID": labels.map_labels("sample", named, others), "tumor": F.when(normal, "Normal").when(~normal, "Tumor")})


def with_tissue(cells: DataFrame, name: str = "tissue1") -> DataFrame:
    """Tissue by the name in the ID, Brain where it holds none, as a factor in the order of the axis."""
    arms = [(F.contains("ID", F.lit(t)), t) for t in sorted(label_maps.TISSUE_ORDER) if t != "Brain"]
    return labels.as_factor(cells.withColumn(name, labels.ladder(*arms, default="Brain", null_policy="propagate")), name, label_maps.TISSUE_ORDER)


def whole_atlas(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Union ``{name: cells}`` of annotated datasets: IDs, tumour cells only where a dataset has both, cells of no kind left out, tissue."""
    parts = {}
    for name, cells in datasets.items():
        cells = with_ids(cells, name)
        if name in TUMOR_ONLY:
            cells = labels.keep_values(cells, "tumor", ["Tumor"])
        if name == "hgg":
            cells = reshape.tag(labels.drop_values(cells, "ID", ["Others"]), tissue="Brain").withColumn("celltype_broad", F.col("celltype"))
        parts[name] = cells
    return with_tissue(reshape.unite_named(parts))


def with_pathology(cells: DataFrame) -> DataFrame:
    """``Pathology`` by ID as a factor, one name for equal cell types, and their joint key."""
    renamed = labels.map_labels("ID", {"Astrocytoma": "Grade II Astrocytoma"})
    cells = cells.withColumns({"Pathology": F.coalesce(renamed, F.col("ID")), "celltype_broad1": F.coalesce(
        labels.map_labels("celltype_broad", {"Oligo": "Oligodendrocyte"}), F.col("celltype_broad"))})
    cells = labels.as_factor(cells, "Pathology", label_maps.PATHOLOGIES)
    return cells.withColumn("Pathology_celltype", paste("Pathology", "celltype_broad1"))


def mouse_tumors(cells: DataFrame) -> DataFrame:
    """Tumour tissue by ID and its label; cells of other tissues are left out. In the brain, high and low grade apart."""
    tissue = labels.map_labels("ID", label_maps.inverted(label_maps.MOUSE_TISSUES), "Others")
    cells = cells.withColumn("tumor_tissue", tissue)
    cells = cells.withColumn("new_label", labels.map_labels("tumor_tissue", label_maps.inverted(label_maps.MOUSE_LABELS), "Others"))
    grade = F.when(F.col("new_label") == "Brain", F.when(F.col("tumor_tissue").isin("GBM", "MB"), "HGG").otherwise("LGG"))
    return labels.drop_values(cells, "new_label", ["Others"]).withColumn("HGG", grade)
