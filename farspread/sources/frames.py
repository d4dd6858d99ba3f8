"""Frames of files of any kind: the first one, some in a row, all as a DataFrame, and one or a few by their keys."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import ScanError
from . import files, trajectory, xyz

#: Data source of each kind of file.
FORMATS = {"xyz": xyz.ExtXyzSource, "traj": trajectory.TrajectorySource, "generic": trajectory.AnySource}


def kind(path: str) -> str:
    """traj, xyz or generic, by the file's suffix in any case."""
    low = path.lower()
    return "traj" if low.endswith(".traj") else "xyz" if low.endswith((".xyz", ".extxyz")) else "generic"


def load(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """All frames of the files, whatever their kinds."""
    out = None
    for k, source in FORMATS.items():
        own = [p for p in paths if kind(p) == k]
        if own:
            spark.dataSource.register(source)
            frames = spark.read.format(source.name()).option("paths", ",".join(own)).options(**options).load()
            out = frames if out is None else out.unionByName(frames)
    return out


def one_by_one(path: str) -> Iterator[tuple]:
    """(numbers, positions, cell, pbc, info) of a file's frames, read as they are asked for."""
    if kind(path) == "traj":
        places = trajectory.offsets(path)
        yield from trajectory.frames(path, places[0], places) if places else ()
    elif kind(path) == "xyz":
        with open(path, encoding="utf-8") as f:
            while line := f.readline():
                if not line.strip():
                    continue
                if not line.strip().isdigit():
                    raise ScanError(f"{path}: a frame's first line must be its number of atoms, not {line[:40]!r}")
                rest = [f.readline() for _ in range(int(line) + 1)]
                if not rest[-1]:
                    raise ScanError(f"{path}: truncated frame")
                yield xyz.parse(line + "".join(rest))
    else:
        yield from trajectory.read_any(path)


def in_a_row(patterns: list[str], *, stride: int = 1, max_frames: int | None = None) -> Iterator[tuple]:
    """(source_file, frame_index, frame) without a scan: the stride counts over all files, the limit what is left."""
    seen = given = 0
    for path in files.expand_patterns(patterns):
        for i, frame in enumerate(one_by_one(path)):
            if seen % stride == 0:
                if max_frames is not None and given >= max_frames:
                    return
                yield path, i, frame
                given += 1
            seen += 1


def first_frame(path: str) -> tuple | None:
    """A file's first frame, or None if there is none or it can't be read: a probe breaks no run."""
    try:
        return next(one_by_one(path), None)
    except (ScanError, OSError, ValueError, LookupError):
        return None


def read_frames(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """Frames of refs (source_file, frame_index): only the files named are opened."""
    paths = [r[0] for r in refs.select("source_file").distinct().orderBy("source_file").collect()]
    frames = load(spark, paths) if paths else spark.createDataFrame([], xyz.SCHEMA)
    return frames.join(F.broadcast(refs.select("source_file", "frame_index").distinct()) if len(paths) == 1 else refs.select("source_file", "frame_index").distinct(), ["source_file", "frame_index"], "left_semi")


def with_file_facts(summary: DataFrame) -> DataFrame:
    """(source_file, n_frames, size_bytes, mtime) of a summary; a row a file."""
    rows = [(r.source_file, r.n_frames, os.stat(r.source_file).st_size, os.stat(r.source_file).st_mtime) for r in summary.collect()]
    return summary.sparkSession.createDataFrame(rows, "source_file string, n_frames long, size_bytes long, mtime double")
