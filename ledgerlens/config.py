"""Detection thresholds and environment settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    """Fixed default values of the detectors; every operator takes them as arguments."""

    reporting: float = 10_000.0
    cycle_window_hours: float = 72
    cycle_max_len: int = 6
    cycle_min_retention: float = 0.85
    cycle_growth: float = 1.02
    chain_max_delay_min: float = 120
    chain_min_forward: float = 0.85
    chain_min_length: int = 3
    smurf_min_deposits: int = 10
    smurf_window_days: float = 7
    smurf_just_below_min: float = 0.80
    smurf_just_below: float = 0.995
    benign_min_txns: int = 5


@dataclass(frozen=True)
class Settings:
    banks: tuple[str, ...] = ("BankA", "BankB", "BankC")
    salt: str = field(default_factory=lambda: os.environ.get("FEDERATION_SALT", "ledgerlens-demo-salt"))


DEFAULTS = Thresholds()
