"""Parameters with their defaults, as frozen dataclasses."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, dataclass, fields


@dataclass(frozen=True)
class EventConfig:
    """How event flags come about. season: "all" or "local-warm<n>" (the n warmest months of each node)."""

    kind: str = "hot"
    percentile: float = 0.95
    baseline: tuple[int, int] = (2001, 2020)
    smoothing_rows: int = 15
    season: str = "all"
    min_run: int = 2
    run_mode: str = "row"

    @classmethod
    def cold(cls, **kw) -> EventConfig:
        return cls(**{"kind": "cold", "percentile": 0.05} | kw)

    @property
    def season_months(self) -> int | None:
        if self.season == "all":
            return None
        if not self.season.startswith("local-warm"):
            raise ValueError(f"unknown season: {self.season}")
        return int(self.season.removeprefix("local-warm"))


@dataclass(frozen=True)
class PairConfig:
    k_days: int = 3
    alpha: float = 0.005
    min_events: int = 5
    min_overlap: int = 200
    long_range_km: float = 2500.0
    fdr_q: float = 0.05


@dataclass(frozen=True)
class BundleConfig:
    clusters: int = 5
    top_n: int = 3
    threshold: float = 0.05


@dataclass(frozen=True)
class RunConfig:
    k_days: int = 3
    min_duration: int = 2
    lock_mode: str = "sweep"
    n_boot: int = 2000


@dataclass(frozen=True)
class PanelConfig:
    tau: float = 0.15
    years: tuple[int, int] = (2000, 2024)


@dataclass(frozen=True)
class SpectralConfig:
    low: int = 4
    high: int = 8
    max_shift: int = 20
    class_m: float = 45.0


@dataclass(frozen=True)
class SurrogateConfig:
    draws: int = 1000
    seed: int = 20260603
    threshold: float = 0.05


def parser(config: type) -> argparse.ArgumentParser:
    """A command line for any of these classes: --name for each field, with its default and type."""
    out = argparse.ArgumentParser(config.__name__)
    for f in fields(config):
        default = None if f.default is MISSING else f.default
        kind = type(default)
        if kind is tuple:
            out.add_argument(f"--{f.name.replace('_', '-')}", nargs=len(default), type=type(default[0]), default=default)
        else:
            out.add_argument(f"--{f.name.replace('_', '-')}", type=kind, default=default)
    return out


def from_args(config: type, args: list[str]):
    got = vars(parser(config).parse_args(args))
    return config(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})
