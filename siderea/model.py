"""Data-quality bits and policies. The relations:

samples(px..., frame, v, w, dq)  one row per measured value; v is a BIGINT in scaled units (exact sums), px may be several columns
images(frame, y, x, v, filt)     samples whose pixel is a place in an image
frames(frame_id, ...)            one row per frame header
"""

from __future__ import annotations

from dataclasses import dataclass

# Data-quality bits, in order.
DQ_FLAGS = {
    "no_data": 1,
    "saturated": 2,
    "hot_pixel": 4,
    "cold_pixel": 8,
    "dead_pixel": 16,
    "cosmetic_corrected": 32,
    "warp_edge": 64,
    "local_normalization_excluded": 128,
    "low_rejected": 256,
    "high_rejected": 512,
}


@dataclass(frozen=True)
class Rejection:
    """How outliers of a pixel are found, and the guard: nothing is rejected unless min_samples stay and at most max_fraction go."""

    method: str = "none"
    low: float = 3.0
    high: float = 3.0
    min_samples: int = 3
    max_fraction: float = 0.5
    iterations: int = 1


@dataclass(frozen=True)
class QualityGate:
    min_stars: int = 8
    adaptive: bool = True
    reference_side: float = 64.0
    require_fwhm: bool = False
    max_saturation: float = 0.05
    min_score: float = 0.0
