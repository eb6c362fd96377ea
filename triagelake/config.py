"""Thresholds of the engine."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Settings:
    """Fixed values that results depend on."""

    unverified_confidence_cap: Decimal = Decimal("0.40")
    conflict_confidence_cap: Decimal = Decimal("0.50")
    evidence_fuzzy_threshold: float = 90.0
    scanned_min_chars: int = 100
    scanned_image_area_ratio: float = 0.80
    scanned_printable_ratio: float = 0.75
    image_min_area_ratio: float = 0.03
    image_full_page_ratio: float = 0.80
    image_min_stddev: float = 12.0
    lang_min_chars: int = 25
    lang_min_confidence: float = 0.60
    cjk_content_weight: float = 2.5
    heading_max_chars: int = 90
    heading_font_ratio: float = 1.12
    translate_min_chars: int = 120
    summary_chunk_chars: int = 60_000
    mostly_quoted_chars: int = 40
    attachment_max_bytes: int = 25 * 1024 * 1024
    dedupe_id_max_chars: int = 190
    job_lease_seconds: int = 600
    job_max_attempts: int = 3
    poll_seconds: int = 10
    poll_batch: int = 50
    page_size: int = 50


SETTINGS = Settings()
