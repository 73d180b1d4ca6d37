"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

ALGORITHMS = ("DBSCAN", "DBSCANCorr", "MeanShift")
WINDOWS = ("hanning", "tukey")


@dataclass(frozen=True, kw_only=True)
class Settings:
    """Defaults are the production values. strict: reproduce known quirks of the older engine
    (vetting scores that never reach the table, southern zones read as northern)."""

    gas: str = "methane"
    scale: float = 60.0
    tile_size: int = 256
    stride: int = 64
    plume_threshold: float = 0.5
    origin_threshold: float = 0.4
    min_slot_pixels: int = 1
    clustering: str = "DBSCANCorr"
    clustering_kw: dict[str, Any] = field(default_factory=lambda: {"eps_dist": 25.0, "eps_corr": 0.955, "min_samples": 6, "patch_size": 65})
    regularizer: float = 0.01
    cc_min_size: int = 10
    keep_origin_component: bool = True
    border: int = 0
    simplify: float = 1e-3
    keep_holes: bool = False
    vetting_patch: int = 200
    strict: bool = False
    window: str = "hanning"
    cluster_cap: int | None = None

    def __post_init__(self) -> None:
        if self.clustering not in ALGORITHMS:
            raise ValueError(f"no clustering algorithm is named {self.clustering}")
        if self.gas not in ("methane", "co2"):
            raise ValueError(f"gas {self.gas} is not supported")
        if self.window not in WINDOWS:
            raise ValueError(f"no window is named {self.window}")
        if self.vetting_patch % 2:
            raise ValueError("vetting_patch must be even")
        patch = self.clustering_kw.get("patch_size")
        if self.clustering == "DBSCANCorr" and not patch:
            raise ValueError("DBSCANCorr needs patch_size")
        if self.clustering == "DBSCAN" and patch:
            raise ValueError("DBSCAN takes no patch_size")
        if patch and patch % 2 == 0:
            raise ValueError("patch_size must be odd")

    @property
    def most_in_cluster(self) -> int:
        """How many candidates of a cluster are merged: as many as tiles can cover one place, unless given."""
        return self.cluster_cap if self.cluster_cap is not None else int((self.tile_size / self.stride) ** 2)
