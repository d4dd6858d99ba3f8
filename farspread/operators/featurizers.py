"""Featurizers by name: what turns a structure into a vector, and what says which vectors may be compared."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .soap import PowerSpectrum


class Featurizer(ABC):
    """Settings that travel to the executors; ``vectors`` is called there, a batch at a time."""

    name: str
    #: None, or the radius within which a cell must keep images apart.
    cutoff: float | None = None
    species: tuple[int, ...] | None = None

    @property
    @abstractmethod
    def width(self) -> int: ...

    @abstractmethod
    def identity(self) -> dict[str, Any]: ...

    @abstractmethod
    def vectors(self, pdf: pd.DataFrame) -> Iterator[np.ndarray]: ...

    def featurize(self, frames: DataFrame) -> DataFrame:
        """frames (numbers, positions, cell, pbc and others) with features; null where ``status`` isn't ok."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)

        def run(parts):
            for pdf in parts:
                ok = pdf["status"] == "ok"
                made = iter(self.vectors(pdf[ok]))
                yield pdf.assign(features=pd.Series([next(made).tolist() if good else None for good in ok], index=pdf.index, dtype=object))

        return frames.mapInPandas(run, f"{fields}, features array<double>")


class Soap(Featurizer):
    name = "soap"

    def __init__(self, species: tuple[int, ...], r_cut: float = 6.0, n_max: int = 9, l_max: int = 3, sigma: float = 1.0, rbf: str = "gto"):
        if not species:
            raise ValueError("the featurizer needs species")
        if min(r_cut, n_max, sigma) <= 0 or l_max < 0 or rbf not in ("gto", "polynomial"):
            raise ValueError("r_cut, n_max and sigma must be positive, l_max at least 0, rbf gto or polynomial")
        self.settings = {"r_cut": float(r_cut), "n_max": n_max, "l_max": l_max, "sigma": float(sigma), "rbf": rbf}
        self.species, self.cutoff = tuple(sorted(species)), r_cut

    @property
    def width(self) -> int:
        return PowerSpectrum(self.species, **self.settings).width

    def identity(self) -> dict[str, Any]:
        return {"featurizer": self.name, "species": list(self.species), **self.settings}

    def vectors(self, pdf: pd.DataFrame) -> Iterator[np.ndarray]:
        kernel = PowerSpectrum(self.species, **self.settings)
        for row in pdf[["numbers", "positions", "cell", "pbc"]].itertuples(index=False):
            yield kernel.vector(row.numbers, [list(p) for p in row.positions], [list(v) for v in row.cell], list(row.pbc))


def _later(name: str):
    def make(*_, **__):
        raise NotImplementedError(f"the {name} featurizer is a name kept for later")

    return make


REGISTRY = {"soap": Soap, "uma": _later("uma"), "mace": _later("mace")}
IMPLEMENTED = ("soap",)


def get_featurizer(name: str, **settings) -> Featurizer:
    if name not in REGISTRY:
        raise ValueError(f"unknown featurizer {name!r}: {', '.join(REGISTRY)}")
    return REGISTRY[name](**settings)


def species_of(frames: DataFrame) -> tuple[int, ...]:
    """The union of all frames' species; at most the periodic table comes to the driver."""
    return tuple(sorted(r[0] for r in frames.select(F.explode("numbers")).distinct().collect()))
