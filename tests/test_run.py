"""Whole runs over a few structures: describe, select, seeds, reuse of a run, gather, figures."""

import json

import numpy as np
import pytest

from farspread.__main__ import main
from farspread.operators.featurizers import Soap, get_featurizer
from farspread.operators.soap import PowerSpectrum
from farspread.plans.run import scan
from farspread.sources import xyz

SMALL = ["--r_cut", "3", "--n_max", "2", "--l_max", "2"]


@pytest.fixture(scope="module")
def structures(tmp_path_factory):
    rng, path = np.random.default_rng(3), tmp_path_factory.mktemp("in") / "a.extxyz"
    rows = [([6, 1, 1], (rng.normal(size=(3, 3)) + [[0, 0, 0], [1, 0, 0], [0, 1.5, 0]]).tolist(), np.zeros((3, 3)).tolist(), [False] * 3, {"note": 'say "x\\y"'}) for _ in range(24)]
    rows.append(([26], [[0.0, 0, 0]], (np.eye(3) * 2.8).tolist(), [True] * 3, {}))
    xyz.write(rows, str(path))
    return str(path)


def test_power_spectrum_is_invariant():
    rng = np.random.default_rng(0)
    kernel = PowerSpectrum((1, 6), r_cut=4, n_max=3, l_max=3)
    x, z, free = rng.normal(size=(5, 3)) * 1.5, np.array([6, 1, 1, 6, 1]), np.zeros((3, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    order = rng.permutation(5)
    v = kernel.vector(z, x, free, [False] * 3)
    assert len(v) == kernel.width == 6 * 7 // 2 * 4 and np.isfinite(v).all()
    assert np.allclose(v, kernel.vector(z[order], x[order] @ turn + 7, free, [False] * 3))
    wide = kernel.vector(z, x, np.eye(3) * 60, [True] * 3)
    assert np.allclose(v, wide)
    # a crystal's vector doesn't depend on the size of the cell that repeats
    one = kernel.vector([6], [[0, 0, 0]], np.eye(3) * 2.5, [True] * 3)
    two = kernel.vector([6, 6], [[0, 0, 0], [2.5, 0, 0]], np.diag([5, 2.5, 2.5]), [True] * 3)
    assert np.allclose(one, two)


def test_registry():
    assert isinstance(get_featurizer("soap", species=(1,)), Soap)
    with pytest.raises(ValueError):
        get_featurizer("none")
    with pytest.raises(NotImplementedError):
        get_featurizer("mace")


def test_run_and_seeded_round(spark, structures, tmp_path):
    out, again = str(tmp_path / "r1"), str(tmp_path / "r2")
    args = ["--traj", structures, "--species", "C", "H", "--on_unknown_species", "skip", *SMALL]
    assert main(["select", *args, "--out", out, "--n_select", "5", "--method", "fps"], spark) == 0
    manifest = json.load(open(f"{out}/run_manifest.json"))
    assert manifest["status"] == {"ok": 24, "skipped_species:Fe(26)": 1} and manifest["results"]["n_selected"] == 5
    rows = spark.read.parquet(f"{out}/selected.parquet").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [0, 1, 2, 3, 4] and {r.formula for r in rows} == {"CH2"}
    frames = scan(spark, [f"{out}/selected.extxyz"]).orderBy("frame_index").collect()
    assert [int(f.info["original_index"]) for f in frames] == [r.frame_index for r in rows]
    assert frames[0].info["note"] == 'say "x\\y"' and json.loads(frames[0].info["spread_descriptor_fields"])["n_max"] == 2
    seeded = ["--selected_images", f"{out}/selected.extxyz", "--cache_root", str(tmp_path / "cache"), "--n_select", "4"]
    for _ in range(2):  # the second time from the cache
        assert main(["select", *args, "--out", again, *seeded, "--method", "fps"], spark) == 0
        second = {r.frame_index for r in spark.read.parquet(f"{again}/selected.parquet").collect()}
        assert len(second) == 4 and not second & {r.frame_index for r in rows}
    assert main(["select", "--traj", structures, "--species", "C", "H", "--on_unknown_species", "skip", "--out", again, *seeded, "--r_cut", "4", "--n_max", "2"], spark) == 2
    assert main(["select", "--traj", structures, "--input_features", out, "--out", again, "--n_select", "5", "--method", "fps"], spark) == 0
    assert [r.frame_index for r in spark.read.parquet(f"{again}/selected.parquet").orderBy("rank").collect()] == [r.frame_index for r in rows]
    # seeds by the vectors of an earlier run
    reused = ["select", "--traj", structures, "--input_features", out, "--out", again, "--n_select", "4", "--selected_images", f"{out}/selected.extxyz"]
    for method in ("fps", "kmeans"):
        assert main([*reused, "--method", method], spark) == 0
        manifest = json.load(open(f"{again}/run_manifest.json"))
        assert manifest["seed_set"]["rows"] == 5 and list(manifest["seed_set"]["rows_per_file"].values()) == [5] and manifest["inputs"][0]["size_bytes"] > 0
        third = {r.frame_index for r in spark.read.parquet(f"{again}/selected.parquet").collect()}
        assert len(third) == 4 and not third & {r.frame_index for r in rows}
    assert main([*reused, "--method", "fps", "--normalize", "none"], spark) in (0, 2)
    for method in ("fps", "kmeans"):
        assert main(["select", *args, "--out", again, "--n_select", "5", "--method", method, "--batch_size", "10", "--pool_stage", "random", "--kmeans_n_init", "2"], spark) == 0
        assert spark.read.parquet(f"{again}/selected.parquet").select("frame_index").distinct().count() == 5
    exported = str(tmp_path / "table")
    assert main(["describe", *args, "--out", again, "--save_features", exported], spark) == 0
    assert main(["select", "--traj", structures, "--input_features", exported, "--out", str(tmp_path / "r3"), "--n_select", "3", "--on_invalid_features", "skip"], spark) == 2  # the table lacks the frame that was skipped
    assert main(["select", *args, "--no_scan", "--out", again, "--n_select", "5"], spark) == 2  # a shuffle needs the scan
    assert main(["describe", *args, "--out", again, "--vacuum", "1"], spark) == 2  # twice the vacuum is less than the cutoff
    assert main(["select", *args, "--out", again, "--n_select", "5", "--method", "fps", "--batch_size", "10"], spark) == 0
    assert spark.read.parquet(f"{again}/selected.parquet").select("frame_index").distinct().count() == 5
    assert main(["plot", "--out", out, "--embed_max_points", "10"], spark) == 0
    assert spark.read.parquet(f"{out}/embedding.parquet").where("selected").count() == 5
    assert 0 < json.load(open(f"{out}/embedding.json"))["trustworthiness"] <= 1
    assert {r.panel for r in spark.read.parquet(f"{out}/diagnostics.parquet").select("panel").distinct().collect()} == {"distances", "scree", "coverage", "cdf"}


def test_gather_command(spark, structures, tmp_path):
    csv, got = tmp_path / "s.csv", str(tmp_path / "g.extxyz")
    csv.write_text("original_index, cluster\n3, 1\nx, 2\n7, 0\n3, 1\n99, 0\n")
    assert main(["gather", "--csv", str(csv), "--out_traj", got], spark) == 2
    assert main(["gather", "--csv", str(csv), "--out_traj", got, "--traj", structures], spark) == 0
    assert [(f.info["original_index"], f.info["cluster"]) for f in scan(spark, [got]).orderBy("frame_index").collect()] == [("3", "1"), ("7", "0")]
    assert main(["describe", "--traj", str(tmp_path / "none"), "--species", "C"], spark) == 2


def test_unknown_species_stop_a_run(spark, structures, tmp_path):
    assert main(["describe", "--traj", structures, "--species", "C", "H", "--out", str(tmp_path / "x"), *SMALL], spark) == 2
