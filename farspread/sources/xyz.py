"""Extended XYZ text as a Spark data source: one row per frame, files split at frame boundaries.

Registered as ``extxyz``. Rows hold source_file, frame_index, offset, length, natoms, numbers, positions, cell, pbc, info.
A reader first scans each file for frame offsets (header lines only), then every task reads its byte range.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.errors import ScanError
from ..functions.species import NUMBER

SCHEMA = "source_file string, frame_index long, offset long, length long, natoms int, numbers array<int>, positions array<array<double>>, cell array<array<double>>, pbc array<boolean>, info map<string,string>"
_FIELD = re.compile(r"""([A-Za-z_][\w-]*)=("((?:[^"\\]|\\.)*)"|\S+)""")
_ESCAPED = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}


def _quoted(value: str) -> str:
    return '"' + "".join(_ESCAPED.get(c, c) for c in value) + '"'


def _unquoted(value: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), value)


def species_number(token: str) -> int:
    """The atomic number of a line's first word: digits, or a symbol in any case."""
    if token.isdigit():
        return int(token)
    z = NUMBER.get(token.capitalize()) if token.isalpha() else None
    if z is None:
        raise ScanError(f"unknown species {token!r}")
    return z


def scan(path: str) -> list[tuple[int, int, int]]:
    """(offset, length, natoms) of each frame; blank lines between frames are skipped."""
    found: list[tuple[int, int]] = []
    with open(path, "rb") as f:
        while True:
            offset = f.tell()
            line = f.readline()
            if not line:
                break
            if not line.strip():
                continue
            try:
                natoms = int(line)
            except ValueError:
                raise ScanError(f"{path}: a frame's first line must be its number of atoms, not {line[:40]!r}") from None
            for _ in range(natoms + 1):
                if not f.readline():
                    raise ScanError(f"{path}: truncated frame at byte {offset}")
            found.append((offset, natoms))
        end = f.tell()
    return [(o, (found[i + 1][0] if i + 1 < len(found) else end) - o, n) for i, (o, n) in enumerate(found)]


def parse(text: str) -> tuple:
    """numbers, positions, cell, pbc, info of one frame."""
    lines = text.split("\n")
    n = int(lines[0])
    info = {m[1]: _unquoted(m[3]) if m[3] is not None else m[2] for m in _FIELD.finditer(lines[1])}
    lattice = [float(v) for v in info.pop("Lattice").split()] if "Lattice" in info else [0.0] * 9
    pbc = [v in ("T", "True", "1") for v in info.pop("pbc").replace('"', "").split()] if "pbc" in info else [any(lattice)] * 3
    info.pop("Properties", None)
    atoms = [line.split() for line in lines[2 : 2 + n]]
    return [species_number(a[0]) for a in atoms], [[float(v) for v in a[1:4]] for a in atoms], [lattice[i : i + 3] for i in (0, 3, 6)], pbc, info


class FrameRange(InputPartition):
    def __init__(self, path: str, first: int, frames: list[tuple[int, int, int]]):
        self.path, self.first, self.frames = path, first, frames


class ExtXyzReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.frames_per_task = int(options.get("framesPerTask", 10_000))

    def partitions(self) -> list[FrameRange]:
        out = []
        for path in self.paths:
            if not os.path.exists(path):
                raise ScanError(f"no such file: {path}")
            frames = scan(path)
            out += [FrameRange(path, i, frames[i : i + self.frames_per_task]) for i in range(0, len(frames), self.frames_per_task)]
        return out

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for i, (offset, length, natoms) in enumerate(partition.frames):
                f.seek(offset)
                yield (partition.path, partition.first + i, offset, length, natoms, *parse(f.read(length).decode()))


class ExtXyzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "extxyz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExtXyzReader:
        return ExtXyzReader(self.options)


def write(rows, path: str) -> int:
    """Writes frames (numbers, positions, cell, pbc, info) and returns how many."""
    from ..functions.species import SYMBOLS

    n = 0
    with open(path, "w") as f:
        for numbers, positions, cell, pbc, info in rows:
            lattice = " ".join(repr(float(v)) for row in cell for v in row)
            extra = " ".join(f"{k}={_quoted(str(v))}" for k, v in sorted((info or {}).items()))
            f.write(f'{len(numbers)}\nLattice="{lattice}" Properties=species:S:1:pos:R:3 pbc="{" ".join("T" if p else "F" for p in pbc)}" {extra}\n')
            f.writelines(f"{SYMBOLS[z]} {p[0]!r} {p[1]!r} {p[2]!r}\n" for z, p in zip(numbers, positions, strict=True))
            n += 1
    return n
