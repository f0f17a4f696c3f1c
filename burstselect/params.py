"""Selection parameters: one frozen value handed to every operator."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, replace

# The centred half-frame used when no subject is known.
CENTER_BOX = (0.25, 0.25, 0.5, 0.5)

# Bits in the default perceptual hash and the top of the luma scale.
PHASH_BITS = 64
LUMA_MAX = 255


def _half_away(x: float) -> int:
    """Round half away from zero, for non-negative input."""
    return int(x + 0.5)


@dataclass(frozen=True)
class SelectionParams:
    """Thresholds of a selection run. The defaults are fixed values."""

    group_method: str = "time"
    gap_seconds: float = 2.0
    sim_max_distance: int = 10
    sim_time_ceiling: float = 30.0
    phash_size: int = 8
    keep_per_burst: int = 1
    downscale_long_edge: int = 1280
    min_confidence: float = 0.6
    max_faces: int = 6
    min_face_frac: float = 0.005
    foreground_ratio: float = 0.6
    eye_open_min: float = 0.50
    open_gate: float = 0.50
    blown_value: int = 250
    blown_frac: float = 0.10
    crushed_value: int = 5
    crushed_frac: float = 0.20
    reject_sharpness_ratio: float = 0.30
    single_sharpness_floor: float = 50.0
    subject_mode: str = "auto"

    def with_(self, **changes) -> "SelectionParams":
        return replace(self, **changes)

    @classmethod
    def interactive(cls, likeness: float = 72.0, highlight_limit: float = 0.94) -> "SelectionParams":
        """The defaults of the interactive front end, from its likeness and highlight sliders."""
        return cls(
            group_method="similarity",
            sim_max_distance=sim_distance(likeness),
            eye_open_min=0.45,
            open_gate=0.45,
            blown_value=blown_value(highlight_limit),
            crushed_frac=0.04,
            reject_sharpness_ratio=0.78,
        )

    def grouping_tag(self) -> str:
        """Cache discriminator of the grouping: the gap for time, a constant for similarity."""
        return "sim" if self.group_method == "similarity" else str(float(self.gap_seconds))

    def measure_tag(self) -> str:
        """Cache discriminator over every parameter that changes a stored measurement."""
        skip = {"keep_per_burst", "open_gate", "reject_sharpness_ratio", "single_sharpness_floor"}
        if self.group_method == "similarity":
            skip |= {"gap_seconds", "sim_max_distance", "sim_time_ceiling"}
        used = sorted((k, v) for k, v in asdict(self).items() if k not in skip)
        return hashlib.sha1(repr(used).encode()).hexdigest()[:16]


def sim_distance(likeness: float) -> int:
    """Likeness percent -> largest Hamming distance still in a group."""
    return _half_away(max(0.0, min(1.0, (100 - likeness) / 100)) * PHASH_BITS)


def likeness(distance: int) -> float:
    return (1 - max(0.0, min(1.0, distance / PHASH_BITS))) * 100


def blown_value(limit: float) -> int:
    """Highlight limit 0..1 -> luma at which a pixel counts as blown."""
    return _half_away(max(0.0, min(1.0, limit)) * LUMA_MAX)


def blown_limit(value: int) -> float:
    return value / LUMA_MAX
