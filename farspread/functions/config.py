"""Validated settings. Names and defaults are fixed values: they are part of a query's meaning."""

from __future__ import annotations

from dataclasses import dataclass


def _one_of(name: str, value: str, *allowed: str) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


def _at_least(name: str, value: float | None, least: float) -> None:
    if value is not None and value < least:
        raise ValueError(f"{name} must be at least {least}, not {value}")


@dataclass(frozen=True)
class Sampling:
    stride: int = 1
    shuffle: bool = True
    seed: int = 0
    max_frames: int | None = None
    scan: bool = True

    def __post_init__(self):
        _at_least("stride", self.stride, 1)
        _at_least("max_frames", self.max_frames, 1)
        if self.shuffle and not self.scan:
            raise ValueError("a global shuffle needs the scan")


@dataclass(frozen=True)
class Box:
    mode: str = "auto"
    vacuum: float = 15.0
    shape: str = "orthorhombic"
    min_length: float = 1e-6

    def __post_init__(self):
        _one_of("cell mode", self.mode, "auto", "native", "box")
        _one_of("box shape", self.shape, "orthorhombic", "cubic")
        _at_least("vacuum", self.vacuum, 0)

    def vacuum_is_sufficient(self, cutoff: float | None) -> bool:
        return cutoff is None or self.mode == "native" or 2 * self.vacuum >= cutoff


@dataclass(frozen=True)
class Stream:
    batch_size: int = 2000
    pool_alpha: int = 4
    pool_cap: int | None = None
    pool_stage: str = "fps"

    def __post_init__(self):
        _at_least("batch_size", self.batch_size, 0)
        _at_least("pool_alpha", self.pool_alpha, 1)
        _one_of("pool_stage", self.pool_stage, "fps", "random")

    def target(self, n_select: int, n: int) -> int:
        return min(self.pool_alpha * n_select, n)

    def cap(self, n_select: int) -> int:
        return max(n_select, self.pool_cap or min(20 * n_select, 20_000))


@dataclass(frozen=True)
class Selection:
    n_select: int
    method: str = "kmeans"
    normalize: str = "l2"
    random_state: int = 0
    min_dist2: float | None = None
    fps_init: str = "farthest_from_mean"
    k: int | None = None
    per_cluster: int = 1
    second_pick: str = "farthest"
    fill: str = "fps"
    trim: str = "population"
    n_init: int = 10
    minibatch_threshold: int = 20_000
    strict_determinism: bool = False

    def __post_init__(self):
        _at_least("n_select", self.n_select, 1)
        _at_least("k", self.k, 1)
        _at_least("n_init", self.n_init, 1)
        _at_least("minibatch_threshold", self.minibatch_threshold, 1)
        _one_of("method", self.method, "kmeans", "fps")
        _one_of("normalize", self.normalize, "l2", "none")
        _at_least("per_cluster", self.per_cluster, 1)
        _one_of("second_pick", self.second_pick, "farthest", "nearest")
        _one_of("fill", self.fill, "fps", "none")
        _one_of("trim", self.trim, "population", "fps")
        parse_init(self.fps_init)

    def options(self) -> dict:
        """Arguments of select_diverse."""
        return {"method": self.method, "min_dist2": self.min_dist2, "init": self.fps_init, "k": self.k, "per_cluster": self.per_cluster, "second_pick": self.second_pick, "fill": self.fill,
                "trim": self.trim, "random_state": self.random_state, "n_init": self.n_init, "minibatch_threshold": self.minibatch_threshold}


def parse_init(init: str | None) -> tuple[str, int | None]:
    text = init or "farthest_from_mean"
    if text in ("farthest_from_mean", "random"):
        return text, None
    kind, _, number = text.partition(":")
    if kind == "index" and number.lstrip("-").isdigit():
        return "index", int(number)
    raise ValueError(f"unknown start {init!r}: farthest_from_mean, random or index:J")
