"""Parameters of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Limits and thresholds; ``from_env`` reads overrides from the environment."""

    max_upload_mb: float = 12.0
    max_pages: int = 2
    min_focus: float = 80.0
    max_glare: float = 0.08
    reject_if_bad_quality: bool = True
    min_edge: int = 1600
    min_focus_pdf: float = 50.0
    max_glare_pdf: float = 0.12
    min_edge_pdf: int = 1400
    min_field_confidence: float = 0.7
    min_line_confidence: float = 0.6
    handwriting_threshold: float = 0.6
    row_tolerance: float = 16.0
    column_margin: float = 12.0
    least_column_width: float = 60.0

    @classmethod
    def from_env(cls) -> Config:
        cast = {"bool": lambda v: v.strip().lower() in ("1", "true", "yes"), "int": int, "float": float}
        return cls(**{f.name: cast[str(f.type)](os.environ[f.name.upper()]) for f in fields(cls) if f.name.upper() in os.environ})
