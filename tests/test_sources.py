"""Files of all kinds: trajectories, first frames, frames in a row, tables that are written and read again."""

import json

import numpy as np
import pytest

from farspread.functions.config import Box
from farspread.functions.errors import FeatureTableError, ScanError, VacuumTooSmallError
from farspread.plans.run import probe_boxes, scan
from farspread.sources import files, frames, trajectory, xyz


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    return [([6, 1, 1][: 1 + i % 3], rng.normal(size=(1 + i % 3, 3)).tolist(), (np.eye(3) * (i % 2)).tolist(), [bool(i % 2)] * 3, {"tag": str(i)}) for i in range(n)]


def test_trajectories(spark, tmp_path):
    a, b, c = (str(tmp_path / name) for name in ("a.traj", "b.extxyz", "empty.TRAJ"))
    rows = made(7)
    assert trajectory.write(rows, a) == 7 and xyz.write(made(4, 1), b) == 4 and trajectory.write([], c) == 0
    got = frames.load(spark, [a, b, c], framesPerTask=2).orderBy("source_file", "frame_index").collect()
    assert [(r.numbers, r.positions, r.cell, r.pbc, r.info) for r in got if r.source_file == a] == rows
    assert [r.frame_index for r in got] == [*range(7), *range(4)] and len({r.offset for r in got[:7]}) == 7
    assert scan(spark, [a, b]).count() == 11
    some = spark.createDataFrame([(a, 5), (a, 99)], "source_file string, frame_index long")
    assert [(r.frame_index, r.info["tag"]) for r in frames.read_frames(spark, some).collect()] == [(5, "5")]
    bad = tmp_path / "d.traj"
    bad.write_bytes(b"- of Ulm" + b"x" * 20)
    with pytest.raises(ScanError):
        trajectory.offsets(str(bad))


def test_what_a_first_item_says_holds_for_all(tmp_path):
    path = str(tmp_path / "a.traj")
    trajectory.write(made(1), path)
    one = trajectory.offsets(path)[0]
    with open(path, "r+b") as f:
        f.seek(0, 2)
        at = -(-f.tell() // 8) * 8
        f.seek(at)
        f.write(np.arange(3.0).tobytes())
        later = json.dumps({"positions.": {"ndarray": [[1, 3], "float64", at]}}).encode()
        f.write(np.array([len(later)], "<i8").tobytes() + later)
    assert [g[:2] for g in trajectory.frames(path, one, [one, at + 24])][1] == ([6], [[0.0, 1.0, 2.0]])


def test_first_frames_and_frames_in_a_row(tmp_path):
    a, b = str(tmp_path / "a.xyz"), str(tmp_path / "b.traj")
    xyz.write(made(5), a), trajectory.write(made(5, 1), b)
    assert frames.first_frame(a) == frames.first_frame(a) and frames.first_frame(a)[0] == [6] and frames.first_frame(b)[4] == {"tag": "0"}
    other = tmp_path / "c.cif"
    other.write_text("no structure")
    assert frames.first_frame(str(other)) is None and frames.first_frame(str(tmp_path / "none.xyz")) is None
    got = [(p[-6:], i) for p, i, _ in frames.in_a_row([a, b], stride=3, max_frames=3)]
    assert got == [("/a.xyz", 0), ("/a.xyz", 3), ("b.traj", 1)]
    cut = tmp_path / "d.xyz"
    cut.write_text("3\n\nC 0 0 0\n")
    with pytest.raises(ScanError):
        list(frames.in_a_row([str(cut)]))


def test_boxes_are_probed_before_a_run(tmp_path):
    free, solid = str(tmp_path / "a.xyz"), str(tmp_path / "b.xyz")
    xyz.write([([1], [[0.0, 0, 0]], np.zeros((3, 3)).tolist(), [False] * 3, {})], free)
    xyz.write([([1], [[0.0, 0, 0]], np.eye(3).tolist(), [True] * 3, {})], solid)
    with pytest.raises(VacuumTooSmallError):
        probe_boxes([solid, free], Box(vacuum=2), 6.0)
    probe_boxes([solid], Box(vacuum=2), 6.0)
    probe_boxes([free], Box(vacuum=3), 6.0)
    probe_boxes([free], Box(vacuum=2), 6.0, "skip")
    with pytest.raises(VacuumTooSmallError):
        probe_boxes([solid], Box(vacuum=2, mode="box"), 6.0)


def test_numpy_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "NUMPY_STEP", 3)
    x = np.random.default_rng(0).normal(size=(8, 4)).astype(np.float32)
    np.savez(tmp_path / "t.npz", features=x, valid=np.arange(8) % 4 != 3)
    prefix = str(tmp_path / "t")
    with pytest.raises(FeatureTableError):
        files.read_numpy_table(spark, prefix)
    (tmp_path / "t.index.csv").write_text("row,structure_id,valid\n" + "".join(f"{i},in/a.xyz:{i},x\n" for i in reversed(range(8))))
    got = {r.key: r for r in files.read_numpy_table(spark, prefix).collect()}
    assert sorted(got) == [f"a.xyz:{i}" for i in range(8)] and [got[f"a.xyz:{i}"].valid for i in range(8)] == [i % 4 != 3 for i in range(8)]
    assert all(np.array_equal(np.float32(got[f"a.xyz:{i}"].features), x[i]) for i in range(8))
    assert files.resolve(prefix) == "numpy" and files.table_identity(spark, prefix) == {}
    (tmp_path / "t.index.csv").write_text("row,structure_id\n0,a:0\n")
    with pytest.raises(FeatureTableError):
        files.read_numpy_table(spark, prefix)


def test_an_exported_table_is_read_again(spark, tmp_path):
    rows = [(0, "x/a.xyz", 0, [1.0, 0.0]), (None, "x/a.xyz", 1, None), (1, "x/a.xyz", 2, [0.0, 1.0])]
    described = spark.createDataFrame(rows, "row long, source_file string, frame_index long, features array<double>")
    out = str(tmp_path / "t")
    files.export_table(described, out, {"featurizer": "f", "n": 3})
    assert files.resolve(out) == "table" and files.table_identity(spark, out) == {"featurizer": "f", "n": 3}
    got = files.read_table(spark, out).orderBy("key").collect()
    assert [(r.key, r.valid, r.features) for r in got] == [("a.xyz:0", True, [1.0, 0.0]), ("a.xyz:2", True, [0.0, 1.0])]
    with pytest.raises(FeatureTableError):
        files.resolve(str(tmp_path))
