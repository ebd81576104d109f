"""Defaults of every tunable, in one object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_target: int = 15_000
    page_limit: int = 20_000
    page_min: int = 30
    runt_min: int = 400
    tables_per_page: int = 6
    similarity: float = 0.58
    top_k: int = 5
    batch: int = 12
    tolerance: float = 0.005
    close: float = 0.05
    pair_budget: int = 420
    fuzzy_threshold: float = 0.82
    max_pages: int = 600
    max_document_chars: int = 12_000_000
    max_upload_mb: int = 25
    daily_budget: int = 200
    limiter_per_minute: int = 120
    rpm_per_key: int = 10
    breaker_keys: int = 2
    breaker_seconds: int = 900
    cooldown_seconds: int = 35
    fiscal_start_month: int = 4
    #: True replicates every quirk of the original rules; False fixes those that contradict their own intent.
    compat: bool = False


DEFAULT = Config()
