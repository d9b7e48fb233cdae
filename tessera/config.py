"""Run profiles: defaults, a profile's overrides, explicit settings; in that order of strength."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Settings; the defaults are fixed values."""

    profile: str = "balanced"
    review: bool = False
    review_threshold: float = 0.75
    auto_threshold: float = 0.82
    suggest_threshold: float = 0.74
    max_seconds: int = 60
    sample_every: float = 2.0
    retry_step: int = 5
    stabilization: float = 8.0
    scene_threshold: float = 15.0
    confirmation_frames: int = 2
    confirmation_window: float = 2.5
    least_conf: float = 0.65
    least_ratio: float = 0.62
    least_area: float = 0.018
    min_stable: int = 3
    min_votes: int = 3
    max_detections: int = 4
    detection_conf: float = 0.90
    same_threshold: float = 0.72
    repeat_threshold: float = 0.985
    eps: float = 0.35
    min_samples: int = 1
    merge_threshold: float = 0.78
    learning: bool = True
    recursive: bool = True
    include_generated: bool = False
    prefetch: bool = False
    scene_aware: bool = True
    scene_scan_step: float = 1.0
    scene_dense_window: float = 1.0
    scene_dense_step: float = 0.5
    scene_static_deviation: float = 8.0
    scene_static_edges: float = 20.0
    stabilization_step: float = 1.0
    reid: bool = False
    reid_least: float = 0.55
    reid_weight: float = 0.35
    reid_low: float = 0.08
    reid_high: float = 0.06
    subject_appearance: float = 0.35
    subject_frames: int = 3
    subject_consistency: float = 0.50
    subject_size_floor: float = 0.02
    subject_size_ceil: float = 0.12
    gate_side: int = 80
    gate_sharpness: float = 60.0
    gate_yaw: float = 45.0
    gate_pitch: float = 45.0
    gate_landmark: float = 0.45

    def __post_init__(self) -> None:
        for name in ("review_threshold", "auto_threshold", "suggest_threshold", "same_threshold", "reid_least", "reid_weight"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.confirmation_frames < 2:
            raise ValueError("confirmation_frames must be 2 or more")


#: Fixed values of the profiles. (The fast one asks for two confirmation frames: with one nothing could be verified.)
PROFILES: dict[str, dict] = {
    "fast": {"max_seconds": 40, "sample_every": 2.5, "stabilization": 6.0, "confirmation_frames": 2, "least_ratio": 0.58, "min_stable": 2, "min_votes": 2, "same_threshold": 0.70, "merge_threshold": 0.76},
    "balanced": {},
    "high_accuracy": {"max_seconds": 90, "sample_every": 1.0, "stabilization": 10.0, "confirmation_frames": 3, "least_ratio": 0.66, "min_stable": 4, "min_votes": 4, "same_threshold": 0.74, "merge_threshold": 0.82},
}
#: Fixed values for embeddings whose scores run lower.
TUNED = {"detection_conf": 0.60, "same_threshold": 0.45, "repeat_threshold": 0.95, "eps": 0.40, "merge_threshold": 0.68}


def resolve(profile: str | None, explicit: dict | None = None, reprocess: bool = False, tuned: bool = False) -> Config:
    """A profile's name may have any case, spaces or dashes; an unknown one is `balanced`. Reprocessing takes the most
    accurate profile. Tuned values win over the profile, explicit settings over all."""
    key = (profile or "balanced").strip().lower().replace("-", "_").replace(" ", "_")
    key = "high_accuracy" if reprocess else key if key in PROFILES else "balanced"
    known = {f.name for f in fields(Config)}
    if bad := set(explicit or ()) - known:
        raise ValueError(f"unknown settings: {sorted(bad)}")
    return replace(Config(), **({"profile": key} | PROFILES[key] | (TUNED if tuned else {}) | (explicit or {})))


def from_settings(path: str | Path) -> Config:
    """The settings of a JSON file: its profile, then what it sets. Values may be strings; keys that are no setting and
    values of the wrong kind are passed over, and a file that is missing or broken gives the defaults."""
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return Config()
    if not isinstance(given, dict):
        return Config()
    explicit = {}
    for f in fields(Config):
        value, kind = given.get(f.name), type(f.default)
        if f.name == "profile" or value is None:
            continue
        if kind is bool:
            explicit[f.name] = bool(value)
            continue
        try:
            explicit[f.name] = kind(value)
        except (TypeError, ValueError):
            pass
    return resolve(str(given.get("profile") or ""), explicit)
