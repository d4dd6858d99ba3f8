"""Binary trajectories (the public ULM container) and, where ASE is installed, any format that it reads, as Spark data
sources: one row per frame with the columns of ``extxyz``.

Registered as ``traj`` and ``structures``. A container holds a list of item offsets; an item is JSON whose arrays name a
shape, a type and a byte offset. What the first item alone has (numbers, periodicity) holds for all frames.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.errors import ScanError
from .xyz import SCHEMA

# Fixed values of the container: magic, and places of the item count and of the place of the offsets.
MAGIC, COUNT_AT, OFFSETS_AT, HEADER = b"- of Ulm", 32, 40, 48


def offsets(path: str) -> list[int]:
    """Byte offsets of a container's items."""
    with open(path, "rb") as f:
        head = f.read(HEADER)
        if len(head) < HEADER or not head.startswith(MAGIC):
            raise ScanError(f"{path} is not a trajectory container")
        n, at = (int(np.frombuffer(head, "<i8", 1, place)[0]) for place in (COUNT_AT, OFFSETS_AT))
        f.seek(at)
        data = f.read(8 * n)
    if n < 0 or len(data) < 8 * n:
        raise ScanError(f"{path}: truncated list of frames")
    return np.frombuffer(data, "<i8").tolist()


def _item(f, offset: int) -> dict:
    f.seek(offset)
    size = int(np.frombuffer(f.read(8), "<i8")[0])
    doc = json.loads(f.read(size))
    order = "<" if doc.get("_little_endian", True) else ">"
    for key in [k for k in doc if k.endswith(".") and isinstance(doc[k], dict) and "ndarray" in doc[k]]:
        shape, kind, at = doc[key]["ndarray"]
        f.seek(at)
        data = f.read(int(np.prod(shape)) * np.dtype(kind).itemsize)
        doc[key[:-1]] = np.frombuffer(data, np.dtype(kind).newbyteorder(order)).reshape(shape)
    return doc


def frames(path: str, first: int, places: list[int]) -> Iterator[tuple]:
    """(numbers, positions, cell, pbc, info) of frames at these offsets; first is the offset of the file's first frame."""
    with open(path, "rb") as f:
        try:
            base = _item(f, first)
            for place in places:
                doc = base if place == first else {**{k: base[k] for k in ("numbers", "pbc", "cell") if k in base}, **_item(f, place)}
                info = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (doc.get("info") or {}).items()}
                cell = np.asarray(doc.get("cell", np.zeros((3, 3))), float).reshape(3, 3)
                pbc = np.broadcast_to(np.asarray(doc.get("pbc", False), bool), 3)
                yield np.asarray(doc["numbers"]).astype(int).tolist(), np.asarray(doc["positions"], float).tolist(), cell.tolist(), pbc.tolist(), info
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise ScanError(f"{path}: not a frame of a trajectory ({e})") from None


def write(rows, path: str) -> int:
    """Writes frames (numbers, positions, cell, pbc, info) as a container and returns how many."""
    places = []
    with open(path, "wb") as f:
        f.write(MAGIC + b"ASE-Trajectory".ljust(16) + np.array([3, 0, HEADER], "<i8").tobytes())
        for numbers, positions, cell, pbc, info in rows:
            doc = {"version": 1, "pbc": [bool(p) for p in pbc], "cell": np.asarray(cell, float).tolist(), "info": dict(info or {})}
            for key, value in (("numbers.", np.asarray(numbers, "<i8")), ("positions.", np.asarray(positions, "<f8").reshape(-1, 3))):
                f.seek(-(-f.tell() // 8) * 8)
                doc[key] = {"ndarray": [list(value.shape), value.dtype.name, f.tell()]}
                f.write(value.tobytes())
            data = json.dumps(doc).encode()
            places.append(f.tell())
            f.write(np.array([len(data)], "<i8").tobytes() + data)
        f.seek(-(-f.tell() // 8) * 8)
        end = f.tell()
        f.write(np.array(places, "<i8").tobytes())
        f.seek(COUNT_AT)
        f.write(np.array([len(places), end], "<i8").tobytes())
    return len(places)


def read_any(path: str) -> list[tuple]:
    """All frames of a file in a format of ASE's, if it is installed."""
    try:
        from ase.io import read
    except ImportError:
        raise ScanError(f"{path}: only .xyz, .extxyz and .traj files are read without ASE") from None
    images = read(path, index=":")
    out = []
    for a in images if isinstance(images, list) else [images]:
        out.append((a.numbers.tolist(), a.positions.tolist(), a.cell[:].tolist(), a.pbc.tolist(), {k: str(v) for k, v in a.info.items()}))
    return out


class Range(InputPartition):
    def __init__(self, path: str, number: int, first: int, places: list[int]):
        self.path, self.number, self.first, self.places = path, number, first, places


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.frames_per_task = int(options.get("framesPerTask", 10_000))

    def existing(self) -> list[str]:
        for path in self.paths:
            if not os.path.exists(path):
                raise ScanError(f"no such file: {path}")
        return self.paths


class TrajectoryReader(_Reader):
    def partitions(self) -> list[Range]:
        out = []
        for path in self.existing():
            places = offsets(path)
            out += [Range(path, i, places[0], places[i : i + self.frames_per_task]) for i in range(0, len(places), self.frames_per_task)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        p = partition
        for i, (place, frame) in enumerate(zip(p.places, frames(p.path, p.first, p.places), strict=True)):
            yield (p.path, p.number + i, place, None, len(frame[0]), *frame)


class AnyReader(_Reader):
    def partitions(self) -> list[Range]:
        return [Range(path, 0, 0, []) for path in self.existing()]

    def read(self, partition: Range) -> Iterator[tuple]:
        for i, frame in enumerate(read_any(partition.path)):
            yield (partition.path, i, None, None, len(frame[0]), *frame)


class TrajectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "traj"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TrajectoryReader:
        return TrajectoryReader(self.options)


class AnySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "structures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnyReader:
        return AnyReader(self.options)
