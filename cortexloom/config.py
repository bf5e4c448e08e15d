"""Options of the analyses with their defaults and checks (O-092, O-093)."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields


@dataclass
class VariantFilter:
    """Variant filters; a None is inactive. `wgs` fills in what rare-variant work starts from."""

    variant_type: str | None = None
    maf_min: float | None = None
    maf_max: float | None = None
    mac_min: int | None = None
    mac_max: int | None = None
    call_rate: float | None = None
    hwe: float | None = None
    genome: str = "GRCh38"

    def __post_init__(self):
        if self.variant_type not in (None, "snv", "indel", "variant"):
            raise ValueError("variant_type is snv, indel or variant")
        check_range("maf_min", self.maf_min, 0, 0.5, closed="left")
        check_range("maf_max", self.maf_max, 0, 0.5, closed="right")
        check_range("call_rate", self.call_rate, 0, 1, closed="both")
        check_range("hwe", self.hwe, 0, 1, closed="both")
        if self.genome not in ("GRCh37", "GRCh38"):
            raise ValueError("genome is GRCh37 or GRCh38")
        if (self.maf_min is None) != (self.maf_max is None):
            self.maf_min, self.maf_max = self.maf_min or 0.0, 0.5 if self.maf_max is None else self.maf_max
        if (self.mac_min is None) != (self.mac_max is None):
            self.mac_min = self.mac_min or 0
        if None not in (self.maf_min, self.maf_max) and self.maf_min >= self.maf_max:
            raise ValueError("maf_min is below maf_max")

    @classmethod
    def wgs(cls, **options) -> "VariantFilter":
        return cls(**{"variant_type": "snv", "maf_max": 0.01} | options)


@dataclass
class SetTest:
    """Variant-set tests."""

    tests: tuple = ("burden",)
    mac_thresh: int = 10
    cmac_min: int = 2
    cmac_max: int | None = None
    sig_thresh: float | None = None

    def __post_init__(self):
        if unknown := set(self.tests) - {"burden", "skat", "staar"}:
            raise ValueError(f"unknown tests {sorted(unknown)}")
        if self.cmac_min <= 1:
            raise ValueError("cmac_min is above 1")
        if self.cmac_max is not None and self.cmac_max < self.cmac_min:
            raise ValueError("cmac_max is at least cmac_min")
        check_range("sig_thresh", self.sig_thresh, 0, 1, closed="none")


@dataclass
class Defaults:
    """Numbers that the analyses start from."""

    bandwidth: int = 3_000_000
    block_size: int = 5000
    bootstraps: dict = field(default_factory=lambda: {"cluster": 50, "rv_cluster": 100, "permute": 50_000_000})
    sig_thresh: dict = field(default_factory=lambda: {"cluster": 1e-5, "rv_cluster": 2.5e-6, "tfce": 2.5e-6, "rv_single": 5e-8})
    cmac_min: dict = field(default_factory=lambda: {"coding": 2, "rv_cluster": 2, "noncoding": 25, "sets": 25})
    mac_thresh: dict = field(default_factory=lambda: {"coding": 10, "rv_cluster": 30})
    maf_min: float = 0.01
    info_min: float = 0.9
    single_mac_min: int = 5


def check_range(name: str, value: float | None, low: float, high: float, closed: str) -> None:
    if value is None:
        return
    if value < low or value > high or (value == low and closed not in ("left", "both")) or (value == high and closed not in ("right", "both")):
        raise ValueError(f"{name} is between {low} and {high}")


def accepted(kind: type, options: dict) -> dict:
    """Options that a config class knows; the others are dropped with a warning."""
    known = {f.name for f in fields(kind)}
    for name in sorted(set(options) - known):
        if options[name] is not None:
            warnings.warn(f"{name} is not used by {kind.__name__}", stacklevel=2)
    return {k: v for k, v in options.items() if k in known}


def zero_based(voxels: list[int]) -> list[int]:
    """One-based voxels to zero-based."""
    if any(v < 1 for v in voxels):
        raise ValueError("voxels are one-based")
    return [v - 1 for v in voxels]
