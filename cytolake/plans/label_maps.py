"""Label maps of the annotation analyses (fixed values), as small tables to join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Cell type of every cluster number; clusters not listed take the default.
CELL_TYPES = {
    "colon": {"T/NK cell": [0, 1, 3, 4], "TAM": [7], "Epithelial cell": [5, 12], "Endothelial cell": [9],
              "B/Plasma cell": [2, 6, 11], "Fibroblast": [10], "Proliferating Immune cell": [8], "Mast cell": [14]},
    "gbm_astrocytoma": {"TAM": [5], "Oligodendrocyte": [6], "Tumor": [2, 3, 4]},
    "lung": {"T/NK cell": [0, 2], "TAM": [3, 4], "Epithelial cell": [1, 7, 9, 15, 16], "Endothelial cell": [8],
             "B/Plasma cell": [5, 11], "Fibroblast": [12], "Proliferating Immune cell": [10], "Mast cell": [6]},
    "mpnst": {"T/NK cell": [0, 1, 7], "TAM": [4, 9], "MPNST": [2, 3, 11], "Endothelial cell": [6, 13],
              "B/Plasma cell": [5], "Schwann cell": [12], "Pericyte": [10]},
    "ovary": {"T/NK cell": [1, 2], "TAM": [3], "Epithelial cell": [5], "Endothelial cell": [6],
              "B/Plasma cell": [8, 12], "Fibroblast": [0, 4, 9, 11], "Proliferating Immune cell": [7], "SMC": [10]},
    "pa": {"T/NK cell": [2, 12], "TAM": [0, 1, 4, 7, 9], "Tumor": [3, 5], "B/Plasma cell": [11], "Fibroblast": [13],
           "Proliferating Immune cell": [10], "Neuron": [6]},
    "pancreas": {"T/NK cell": [1], "TAM": [5], "Ductal cell": [0, 3, 8], "Endothelial cell": [4], "B/Plasma cell": [9],
                 "Fibroblast": [2], "Pericyte": [6], "Mast cell": [7], "Acinar cell": [10], "Schwann cell": [11],
                 "β-cells": [12]},
    "skin": {"T/NK cell": [1, 4, 15, 18], "TAM": [17, 19], "Tumor": [0, 2, 3, 5, 6, 8, 9, 10, 12, 16],
             "Endothelial cell": [7], "B/Plasma cell": [14], "Fibroblast": [11, 13]},
    "thyroid": {"T/NK cell": [0, 1], "TAM": [2], "Thyroid cell": [3, 11], "Endothelial cell": [4],
                "B/Plasma cell": [5, 8, 9], "Fibroblast": [6, 7], "Mast cell": [10]},
    "mouse_colon": {"T/NK cell": [4, 5, 6, 10], "TAM": [3, 7, 8, 13], "Neutrophil": [1, 2], "B/Plasma cell": [0, 9, 12],
                    "Mast cell": [11]},
    "mouse_medulloblastoma": {"T/NK cell": [13], "TAM": [9], "Tumor": [0, 1, 4, 7, 8], "Astrocyte": [11, 12],
                              "Neuron": [2, 3]},
    "mouse_optic_glioma": {"TAM": [3, 4, 11, 15, 24], "T/NK cell": [1, 18], "proliferating cell": [20],
                           "Oligodendrocyte": [0, 2, 5, 10], "Neuron": [14, 16], "Astrocyte": [22], "B cell": [9, 17],
                           "Stromal cell": [13], "Neutrophil": [21], "OPC": [6], "Tumor cell": [12],
                           "Epithelial cell": [23]},
    "mouse_pancreas1": {"T/NK cell": [3], "TAM": [4], "Mesothelial": [8], "Neutrophil": [9], "Fibroblast": [0, 1, 2, 6],
                        "Endothelial cell": [7], "Mast cell": [10]},
    "mouse_pancreas3": {"T/NK cell": [3, 4, 5, 7, 9], "TAM": [0, 1, 2, 12], "Neutrophil": [6], "B/Plasma cell": [11],
                        "Eosinophil": [8], "Proliferating Immune cell": [10], "Smooth muscle cell": [13]},
    "mouse_skin": {"T/NK cell": [1, 2, 4, 5], "TAM": [0, 3, 6, 7, 8, 9, 10]},
    "tam": {"Monocytes": [6, 8], "DCs": [5], "Microglia": [0, 1, 3, 4, 10, 15], "Macrophages": [2]},
    "mouse_optic_glioma_tam": {"Microglia": [0, 1, 5, 6, 9, 12, 14], "Macrophages": [2, 3, 4, 8, 10], "DCs": [7, 13]},
    "mouse_tam": {"Microglia": [1], "Macrophages": [0, 2, 5, 6, 7, 11, 12], "Monocytes": [3, 4], "DCs": [8, 9]},
    "hgg": {"Tumor1": [0, 4, 7], "TAM": [1, 6, 10, 11, 12], "Tumor2": [2, 5, 8, 9], "Tumor3": [3], "Oligo": [13],
            "EC": [14], "Unknown": [15]},
}

# The label of clusters that are not listed ("Others" unless given here).
DEFAULT_TYPES = {"mouse_medulloblastoma": "Undefined", "mouse_optic_glioma": None, "mouse_pancreas1": "Acinar",
                 "mouse_optic_glioma_tam": None, "hgg": None}

# Cell type of the labels a pre-annotated dataset came with.
SOURCE_TYPES = {
    "mouse_pancreas2": {
        "B/Plasma cell": ["B"], "Tumor": ["cancer"], "Endothelial cell": ["endothelial"],
        "T/NK cell": ["cycling_CD8_T", "cytotoxic_CD8_T", "effector_CD4_T", "exhausted_CD8_T", "naive_CD8_T",
                      "natural_killer", "regulatory_CD4_T"],
        "TAM": ["dendritic_cell", "monocyte", "myeloid_derived_supressor", "tumor_associated_macrophage"]},
    # other labels of this dataset stay as they are
    "mouse_glioblastoma": {"TAM": ["pDCs", "cDC1", "cDC2", "Macrophages", "Microglial", "Monocytes"]},
}

# Samples in the order in which they are numbered, per dataset and kind.
SAMPLE_ORDER = {
    "colon": {"Tumor_Colon": [f"T_cac{i}" for i in range(1, 17)],
              "Normal_Colon": [f"B_cac{i}" for i in (4, 6, 7, 10, 11, 14, 15)]},
    "lung": {"Tumor_Lung": ["P1_TI", "P1_TM", "P2_TI", "P2_TM", "P3_TI1", "P3_TI2", "P3_TM1", "P3_TM2", "P4_TI",
                            "P4_TS1", "P4_TS2"],
             "Normal_Lung": ["P1_NI", "P1_NM", "P2_NI", "P2_NM", "P3_NI", "P3_NM", "P4_NI", "P4_NS"]},
    "mpnst": {"Tumor_MPNST": ["biopsy1", "biopsy2", "resection1", "resection2", "resection3", "resection4"]},
    "ovary": {"Tumor_Ovary": [f"HGSOC{i}" for i in range(1, 8)], "Normal_Ovary": [f"Normal{i}" for i in range(1, 6)]},
    "pancreas": {"Tumor_Pancreas": ["Primary001", "Primary002", "Primary003"]},
    "skin": {"Tumor_Skin": [f"Acral{i}" for i in range(1, 7)] + [f"Cutaneous{i}" for i in range(1, 4)]},
    "thyroid": {"Tumor_Thyroid": ["PT3", "PT5", "PT7", "PT8", "PT9", "PT10", "PT12", "AT9", "AT13", "AT16", "AT17", "AT20"],
                "Normal_Thyroid": ["Thy05", "Thy06", "N3-GEX"]},
}

# Sample to ID where the names are not numbered; the last entry is for every other sample.
SAMPLE_IDS = {
    "gbm_astrocytoma": ({"Astrocytoma": "Tumor_Brain_LGG_Astrocytoma"}, "Tumor_Brain_HGG_GBM"),
    "mouse_colon": ({"Tumor": "Tumor_Colon"}, "WT_Colon"),
    "mouse_medulloblastoma": ({"Tumor_1": "Tumor1_MB", "Tumor_2": "Tumor2_MB"}, "Tumor3_MB"),
    "mouse_pancreas3": ({"Tumor1": "Tumor1_Pancreas3"}, "Tumor2_Pancreas3"),
    "mouse_skin": ({"Tumor_1": "Tumor1_Skin"}, "Tumor2_Skin"),
}

# Tissue by name in the ID (Brain otherwise), in the order of the axis.
TISSUE_ORDER = ["Brain", "Thyroid", "Lung", "Pancreas", "Colon", "Ovary", "MPNST", "Skin"]

# ID of the mouse myeloid cells to their tumour tissue, and that to the shown label.
MOUSE_TISSUES = {"Normal_ON": ["Het_PA", "Normal_PA"], "Tumor_Colon": ["Tumor_Colon"], "GBM": ["Tumor_GBM"],
                 "Tumor_ON": ["Tumor_PA"],
                 "Tumor_Pancreas": ["Tumor_Pancreas1", "Tumor_Pancreas2", "Tumor1_Pancreas3", "Tumor2_Pancreas3"],
                 "MB": ["Tumor1_MB", "Tumor2_MB", "Tumor3_MB"], "Tumor_Skin": ["Tumor1_Skin", "Tumor2_Skin"],
                 "Normal_Colon": ["WT_Colon"]}
MOUSE_LABELS = {"Brain": ["Tumor_ON", "GBM", "MB"], "Pancreas": ["Tumor_Pancreas"], "Colon": ["Tumor_Colon"],
                "Skin": ["Tumor_Skin"]}

# Order of the pathologies; studies by position of the sorted samples.
PATHOLOGIES = ["PA", "DIPG", "Grade II Astrocytoma", "GBM"]
STUDIES = ["DIPG"] * 6 + ["GBM1"] * 3 + ["GBM2"] * 4


def inverted(labels: dict) -> dict:
    """``{label: values}`` to ``{value: label}``."""
    return {v: label for label, values in labels.items() for v in values}


def sample_ids(dataset: str) -> dict[str, str]:
    """Sample name to numbered ID."""
    return {s: f"{stem}{i}" for stem, samples in SAMPLE_ORDER[dataset].items() for i, s in enumerate(samples, 1)}


def label_table(spark: SparkSession, labels: dict) -> DataFrame:
    """A label map as ``(value, label)``; integers for clusters, text for names."""
    pairs = list(inverted(labels).items())
    kind = "int" if isinstance(pairs[0][0], int) else "string"
    return spark.createDataFrame(pairs, f"value {kind}, label string")
