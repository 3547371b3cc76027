"""Parameter presets of the annotation analyses (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Preset:
    """Everything an annotation run needs besides its data."""

    min_features: int | None = 500
    max_pct_mt: float = 10
    max_count: float | None = 50000
    mt_pattern: str = "^MT-"
    ribo_patterns: tuple[str, ...] = ("RPS", "RPL")
    max_doublet_score: float = 0.20
    n_features: int = 2000
    trend: str = "loess"
    features_by: tuple[str, ...] = ("sample",)
    n_pcs: int = 50
    dims: int = 20
    batches: tuple[str, ...] = ("sample",)
    lam: float = 10
    k: int = 20
    resolutions: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5, 0.8)
    resolution: float = 0.2
    min_median_features: float | None = None


HUMAN = Preset()
MOUSE = Preset(max_count=25000, max_doublet_score=0.30, resolution=0.3, mt_pattern="^mt-", ribo_patterns=("Rps", "Rpl"))

# Fixed values, one line per dataset.
PRESETS = {
    "colon": replace(HUMAN, resolution=0.3, min_median_features=750),
    "gbm_astrocytoma": replace(HUMAN, min_median_features=300),
    "lung": replace(HUMAN, min_median_features=750),
    "mpnst": replace(HUMAN, min_median_features=750),
    "ovary": HUMAN,
    "pa": replace(HUMAN, min_median_features=750),
    "pancreas": HUMAN,
    "skin": replace(HUMAN, resolution=0.8),
    # the resolution chosen for this dataset (0.15) is not among those run, so it is run as well
    "thyroid": replace(HUMAN, resolutions=(0.1, 0.15, 0.2, 0.3, 0.5, 0.8), resolution=0.15),
    "mouse_colon": MOUSE,
    "mouse_medulloblastoma": MOUSE,
    "mouse_pancreas1": replace(MOUSE, batches=()),
    "mouse_pancreas3": MOUSE,
    "mouse_skin": MOUSE,
    "mouse_optic_glioma": replace(
        MOUSE, min_features=300, max_pct_mt=5, max_count=30000, ribo_patterns=("rps", "rpl"), max_doublet_score=0.25,
        resolutions=(0.2, 0.3, 0.5), resolution=0.5, min_median_features=850),
    "hgg": replace(HUMAN, min_features=None, max_count=None, ribo_patterns=("RP[SL]",), batches=("sample", "tumor"),
                   resolutions=(0.2, 0.3, 0.5, 0.6, 0.7, 0.8), resolution=0.3),
    "tam": replace(HUMAN, dims=10, batches=("Pathology",), lam=0.01, resolutions=(0.3, 0.5, 0.8, 1.0), resolution=0.3,
                   min_median_features=1000),
    "mouse_optic_glioma_tam": replace(
        MOUSE, dims=10, lam=1, k=30, resolutions=(0.3, 0.35, 0.4, 0.45, 0.5, 0.8, 1.0), resolution=1.0,
        min_median_features=1000),
    "mouse_tam": replace(MOUSE, batches=("ID",), resolutions=(0.2, 0.3, 0.5, 0.8, 1.0, 1.2), resolution=0.2),
}
