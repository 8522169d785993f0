"""Configuration: nested dictionaries from YAML, dotted lookups, and hashes of what a stage uses."""

from __future__ import annotations

import copy
import hashlib
import json
from typing import Any

# Default parameters.
DEFAULTS: dict[str, Any] = {
    "segmentation": {"prompts": ["foreground object"], "enabled": True, "multi_instance": True},
    "crop": {"reference_id": None, "align_PCA": True, "angle_candidates": [0, 180], "offset_rotation": 0, "scale": 1.0},
    "transformer": {"patch_size": 14, "map_resolution": [48, 48]},
    "memory_bank": {"max_gb": 6, "selection_method": "k_center"},
    "refine": {"method": "gaussian", "gaussian_sigma": 5},
    "score": {"method": "mean", "min_percentile": 99.9, "max_percentile": 99.999},
}

STAGES = ["segment", "crop", "embed", "bank", "heatmap", "refine"]

# Parameters that each stage depends on.
STAGE_PARAMETERS: dict[str, list[str]] = {
    "segment": ["segmentation.prompts", "segmentation.enabled", "segmentation.multi_instance"],
    "crop": ["crop.reference_id", "crop.align_PCA", "crop.angle_candidates", "crop.offset_rotation", "crop.scale", "transformer.map_resolution", "transformer.patch_size"],
    "embed": [],
    "bank": ["memory_bank.max_gb", "memory_bank.selection_method"],
    "heatmap": [],
    "refine": ["refine.method", "refine.gaussian_sigma", "refine.bilateral_d", "refine.bilateral_sigma_color", "refine.bilateral_sigma_space", "refine.guided_radius", "refine.guided_eps", "refine.morph_threshold_pct", "refine.morph_open_size", "refine.morph_close_size"],
}
#: compat: parameters that count instead of the above, though no stage uses some of them and others are missing.
COMPAT_PARAMETERS = STAGE_PARAMETERS | {
    "segment": ["segmentation.description", "segmentation.enabled", "segmentation.multi_instance"],
    "crop": ["crop.reference_id", "crop.apply_mask", *STAGE_PARAMETERS["crop"][1:]],
    "bank": ["memory_bank.max_tokens", "memory_bank.selection_method"],
}


def load(path: str) -> dict[str, Any]:
    import yaml

    with open(path) as f:
        return merged(DEFAULTS, yaml.safe_load(f) or {})


def save(config: dict[str, Any], path: str) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(config, f, sort_keys=False)


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def value(config: dict[str, Any], path: str) -> Any:
    """The value at a dotted path, None where there is none."""
    at: Any = config
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            return None
        at = at[part]
    return at


def parameters(stage: str, compat: bool = False) -> list[str]:
    table = COMPAT_PARAMETERS if compat else STAGE_PARAMETERS
    if stage not in table:
        raise ValueError(f"unknown stage {stage!r}; one of {', '.join(STAGES)}")
    return table[stage]


def stage_hash(config: dict[str, Any], stage: str, compat: bool = False) -> str:
    """First 16 hex digits of the SHA-256 of the stage's parameters as JSON with sorted keys."""
    used = {p: value(config, p) for p in parameters(stage, compat)}
    return hashlib.sha256(json.dumps(used, sort_keys=True).encode()).hexdigest()[:16]


def map_area(resolution: Any) -> float:
    """Product of a two-element list, NaN for anything else."""
    if isinstance(resolution, (list, tuple)) and len(resolution) == 2:
        return float(int(resolution[0]) * int(resolution[1]))
    return float("nan")
