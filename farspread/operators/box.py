"""Cells for structures that lack one: per-row linear algebra in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import Box
from ..functions.errors import BoxError, VacuumTooSmallError


def needed_axes(pbc: Column, cell: Column, box: Box) -> Column:
    """Which lattice directions must be built: none, all, or those that aren't periodic or have no length."""
    if box.mode != "auto":
        return F.array(*[F.lit(box.mode == "box")] * 3)
    length = F.transform(cell, lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)))
    return F.zip_with(pbc, length, lambda p, n: ~p | (n < box.min_length))


def needs_cell(cell, pbc, box: Box) -> bool:
    """Whether a direction of this structure must be built."""
    if box.mode != "auto":
        return box.mode == "box"
    return bool((~np.asarray(pbc, bool) | (np.linalg.norm(np.array(cell, float).reshape(3, 3), axis=1) < box.min_length)).any())


def padding_directions(fixed: list[np.ndarray], n: int) -> list[np.ndarray]:
    """n unit vectors orthogonal to the fixed ones and each other, each from the Cartesian axis with most left of it."""
    basis: list[np.ndarray] = []

    def rest(v):
        for b in basis:
            v = v - (v @ b) * b
        return v

    for v in fixed:
        if (size := np.linalg.norm(w := rest(np.asarray(v, float)))) > 1e-9:
            basis.append(w / size)
    out = []
    for _ in range(n):
        left = [rest(e) for e in np.eye(3)]
        sizes = [np.linalg.norm(v) for v in left]
        best = int(np.argmax(np.round(sizes, 12)))
        if sizes[best] < 1e-9:
            raise BoxError("no direction is left to pad")
        out.append(left[best] / sizes[best])
        basis.append(out[-1])
    return out


def build_cell(positions, cell, pbc, box: Box, cutoff: float | None = None, where: str | None = None):
    """(positions, cell, pbc, cell_mode) of one structure: native, padded or boxed."""
    p, c, periodic = np.asarray(positions, float).reshape(-1, 3), np.array(cell, float).reshape(3, 3), np.asarray(pbc, bool)
    if box.mode == "native":
        need = np.zeros(3, bool)
    elif box.mode == "box":
        need = np.ones(3, bool)
    else:
        need = ~periodic | (np.linalg.norm(c, axis=1) < box.min_length)
    if not need.any():
        return p, c, periodic, "native"
    if not box.vacuum_is_sufficient(cutoff):
        raise VacuumTooSmallError(f"{where or 'a structure'} needs a cell, but twice the vacuum ({2 * box.vacuum:g}) is less than the cutoff ({cutoff:g})")
    axes = np.flatnonzero(need)
    directions = padding_directions([c[a] for a in np.flatnonzero(~need)], len(axes))
    extents = [float(np.ptp(p @ d)) if len(p) else 0.0 for d in directions]
    if box.shape == "cubic" and len(axes) == 3:
        extents = [max(extents)] * 3
    for a, d, e in zip(axes, directions, extents, strict=True):
        c[a] = (e + 2 * box.vacuum) * d
    if not abs(np.linalg.det(c)) > 0:
        raise BoxError(f"{where or 'a structure'}: the cell has no volume")
    for a, d in zip(axes, directions, strict=True):
        if len(p):
            along = p @ d
            p = p + np.outer(np.full(len(p), (np.linalg.norm(c[a]) - along.max() - along.min()) / 2), d)
    return p, c, np.ones(3, bool), "boxed" if need.all() else "padded"


def with_cells(frames: DataFrame, box: Box, cutoff: float | None = None, on_small_vacuum: str = "error") -> DataFrame:
    """frames with cells, cell_mode, and box_error or small_vacuum where none could be built."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)

    def run(parts):
        for pdf in parts:
            modes, errors, small = [], [], []
            positions, cells, periodic = [], [], []
            for p, c, b, name in zip(pdf["positions"], pdf["cell"], pdf["pbc"], pdf["source_file"], strict=True):
                q, d, e, mode, error, tight = [list(x) for x in p], [list(x) for x in c], list(b), None, None, False
                try:
                    new = build_cell([list(x) for x in p], [list(x) for x in c], b, box, cutoff, name)
                    q, d, e, mode = new[0].tolist(), new[1].tolist(), new[2].tolist(), new[3]
                except VacuumTooSmallError:
                    if on_small_vacuum == "error":
                        raise
                    tight = True
                except BoxError as x:
                    error = str(x)
                positions.append(q), cells.append(d), periodic.append(e), modes.append(mode), errors.append(error), small.append(tight)
            yield pdf.assign(positions=pd.Series(positions, index=pdf.index), cell=pd.Series(cells, index=pdf.index), pbc=pd.Series(periodic, index=pdf.index), cell_mode=modes, box_error=errors, small_vacuum=small)

    return frames.mapInPandas(run, f"{fields}, cell_mode string, box_error string, small_vacuum boolean")
