"""The command line: describe, select, gather, plot (data of the figures)."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.config import Box, Sampling, Selection, Stream
from .functions.errors import SpreadError
from .functions.species import parse_species

log = logging.getLogger(__name__)
LEVELS = {"quiet": logging.WARNING, "normal": logging.INFO, "high": logging.DEBUG}
GENERATED_ONLY = ("--species", "--r_cut", "--n_max", "--l_max", "--sigma", "--rbf")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="farspread", description="Diversity selection of structures on Spark.")
    p.add_argument("--version", action="version", version=f"farspread {__version__}")
    commands = p.add_subparsers(dest="command", required=True)
    # Flags, choices and defaults are fixed values.
    for name in ("describe", "select"):
        c = commands.add_parser(name)
        c.add_argument("--traj", nargs="+", required=True, help="extended XYZ files or patterns")
        c.add_argument("--out", default="farspread_out")
        c.add_argument("--featurizer", default="soap", choices=("soap", "uma", "mace"))
        c.add_argument("--input_features", help="a feature table or the folder of an earlier run")
        c.add_argument("--feature_group")
        c.add_argument("--save_features")
        c.add_argument("--species", nargs="*")
        for flag, kind, default in (("--r_cut", float, 6.0), ("--n_max", int, 9), ("--l_max", int, 3), ("--sigma", float, 1.0), ("--vacuum", float, 15.0), ("--stride", int, 1), ("--seed", int, 0), ("--max_frames", int, None)):
            c.add_argument(flag, type=kind, default=default)
        c.add_argument("--rbf", default="gto", choices=("gto", "polynomial"))
        for flag in ("--on_invalid_features", "--on_unknown_species", "--on_small_vacuum"):
            c.add_argument(flag, default="error", choices=("error", "skip"))
        c.add_argument("--cell_mode", default="auto", choices=("auto", "native", "box"))
        c.add_argument("--box_shape", default="orthorhombic", choices=("orthorhombic", "cubic"))
        c.add_argument("--no_shuffle", dest="shuffle", action="store_false")
        c.add_argument("--no_scan", action="store_true", help="the frames' number isn't known in advance; needs --no_shuffle and --species")
        c.add_argument("--soap_average", default="outer", choices=("outer", "inner", "off"))
        c.add_argument("--n_procs", type=int, help="accepted for older scripts; Spark's settings say how many tasks run")
        c.add_argument("--batch_size", type=int, default=2000, help="frames of a batch; 0 for the exact answer at once")
        c.add_argument("--pool_alpha", type=int, default=4)
        c.add_argument("--pool_cap", type=int)
        c.add_argument("--pool_stage", default="fps", choices=("fps", "random"))
        c.add_argument("--normalize", default="l2", choices=("l2", "none"))
        if name == "select":
            c.add_argument("--n_select", type=int, required=True)
            c.add_argument("--method", default="kmeans", choices=("kmeans", "fps"))
            c.add_argument("--selected_images", nargs="*", default=[])
            c.add_argument("--cache_root", default=".farspread_cache")
            c.add_argument("--min_dist2", type=float)
            c.add_argument("--fps_init", default="farthest_from_mean")
            c.add_argument("--kmeans_k", default="auto")
            c.add_argument("--kmeans_per_cluster", type=int, default=1)
            c.add_argument("--kmeans_fill", default="fps", choices=("fps", "none"))
            c.add_argument("--kmeans_trim", default="population", choices=("population", "fps"))
            c.add_argument("--kmeans_n_init", type=int, default=10)
            c.add_argument("--minibatch_threshold", type=int, default=20_000)
            c.add_argument("--strict_determinism", action="store_true", help="one thread for linear algebra")
            c.add_argument("--plot", action="store_true", help="also write the data of the figures")
            c.add_argument("--embed", default="pca", choices=("pca", "mds", "tsne"))
            c.add_argument("--embed_max_points", type=int, default=3000)
    c = commands.add_parser("gather")
    c.add_argument("--csv", required=True)
    c.add_argument("--out_traj", required=True)
    c.add_argument("--traj", help="the source of a table without source_file")
    c = commands.add_parser("plot")
    c.add_argument("--out", required=True, help="the folder of a finished run")
    c.add_argument("--embed", default="pca", choices=("pca", "mds", "tsne"))
    c.add_argument("--embed_max_points", type=int, default=3000)
    c.add_argument("--no_diagnostics", dest="diagnostics", action="store_false")
    c.add_argument("--formats", nargs="+", default=["png"], choices=("png", "pdf", "svg"), help="pictures, where matplotlib is installed")
    c.add_argument("--seed", type=int, default=0)
    for c in commands.choices.values():
        c.add_argument("--verbose", default="normal", choices=tuple(LEVELS))
    return p


def figures(spark: SparkSession, out: str, method: str, max_points: int, seed: int, diagnostics: bool = True, formats: tuple[str, ...] = ()) -> DataFrame:
    """Writes out/embedding.parquet (row, selected, x, y) of all selected rows and a sample of the others, with how far it
    distorts distances in out/embedding.json, and out/diagnostics.parquet (panel, series, x, y)."""
    from .operators.diagnostics import embed, faithfulness, figure_data
    from .operators.fps import as_matrix
    from .operators.ordering import sample

    rows = spark.read.parquet(f"{out}/frames.parquet").where("row is not null").select("row", "features")
    found = os.path.isdir(f"{out}/selected.parquet")
    picks = spark.read.parquet(f"{out}/selected.parquet").select("row", "rank") if found else spark.createDataFrame([], "row long, rank long")
    chosen = picks.select("row")
    some = rows.join(chosen, "row", "left_semi").withColumn("selected", F.lit(True))
    left = max(0, max_points - some.count())
    shown = some.unionByName(sample(rows.join(chosen, "row", "left_anti"), left, F.col("row"), seed).withColumn("selected", F.lit(False))).orderBy("row").collect()
    if not shown:
        raise SpreadError(f"{out} has no described rows")
    x = as_matrix([r.features for r in shown])
    xy, caption = embed(x, method)
    data = spark.createDataFrame([(r.row, r.selected, float(p[0]), float(p[1]) if len(p) > 1 else 0.0) for r, p in zip(shown, xy, strict=True)], "row long, selected boolean, x double, y double")
    data.write.mode("overwrite").parquet(f"{out}/embedding.parquet")
    with open(f"{out}/embedding.json", "w") as f:
        json.dump({"method": method, "caption": caption, **faithfulness(x, xy, seed=seed)}, f)
    panels = None
    if diagnostics:
        panels = figure_data(rows.withColumnRenamed("row", "pos"), picks.withColumnRenamed("row", "pos"), seed=seed)
        panels.write.mode("overwrite").parquet(f"{out}/diagnostics.parquet")
    log.info("%s of %d rows", caption, len(shown))
    draw(out, data, spark.read.parquet(f"{out}/diagnostics.parquet") if diagnostics else None, caption, formats)
    return data


def draw(out: str, data: DataFrame, panels: DataFrame | None, caption: str, formats: tuple[str, ...]) -> None:
    """Pictures of the figures' data, where matplotlib is installed."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        log.warning("matplotlib isn't installed: %s holds the figures' data only", out)
        return
    figure, axes = pyplot.subplots()
    for r, colour in ((data.where("not selected"), "silver"), (data.where("selected"), "crimson")):
        points = r.select("x", "y").collect()
        axes.scatter([p.x for p in points], [p.y for p in points], s=8, color=colour)
    axes.set_title(caption)
    made = {"embedding": figure}
    if panels is not None:
        made["diagnostics"], grid = pyplot.subplots(2, 2)
        for axes, name in zip(grid.flat, ("distances", "scree", "coverage", "cdf"), strict=True):
            rows = panels.where(F.col("panel") == name).orderBy("series", "x").collect()
            for series in sorted({r.series for r in rows}):
                axes.plot([r.x for r in rows if r.series == series], [r.y for r in rows if r.series == series], label=series)
            axes.set_title(name)
    for name, figure in made.items():
        for kind in formats:
            figure.savefig(f"{out}/{name}.{kind}", dpi=300, bbox_inches="tight")
        pyplot.close(figure)


def execute(spark: SparkSession, a: argparse.Namespace, argv: list[str]) -> None:
    from .operators.featurizers import get_featurizer, species_of
    from .plans.run import run, scan
    from .sources import gather

    if a.command == "plot":
        figures(spark, a.out, a.embed, a.embed_max_points, a.seed, a.diagnostics, tuple(a.formats))
        return
    if a.command == "gather":
        chosen = gather.read_selection(spark, a.csv, a.traj)
        frames = scan(spark, [r[0] for r in chosen.select("source_file").distinct().orderBy("source_file").collect()])
        gather.gather(chosen, frames.drop("pos", "file_id"), a.out_traj)
        return
    featurizer = None
    if a.no_scan and not parse_species(a.species) and a.input_features is None:
        raise ValueError("without a scan the species must be given")
    if a.soap_average != "outer":
        raise ValueError(f"--soap_average {a.soap_average}: only outer, the mean of the atoms' vectors, is made here")
    if a.input_features is None:
        species = parse_species(a.species) or species_of(scan(spark, [*a.traj, *getattr(a, "selected_images", [])]))
        featurizer = get_featurizer(a.featurizer, species=species, r_cut=a.r_cut, n_max=a.n_max, l_max=a.l_max, sigma=a.sigma, rbf=a.rbf)
    elif ignored := [f for f in GENERATED_ONLY if any(t == f or t.startswith(f + "=") for t in argv)]:
        log.warning("%s: not used with precomputed features", ", ".join(ignored))
    options = {"featurizer": featurizer, "features": a.input_features, "group": a.feature_group, "normalize": a.normalize, "save_features": a.save_features, "on_invalid": a.on_invalid_features, "on_unknown": a.on_unknown_species, "on_small_vacuum": a.on_small_vacuum, "sampling": Sampling(stride=a.stride, shuffle=a.shuffle, seed=a.seed, max_frames=a.max_frames, scan=not a.no_scan), "box": Box(mode=a.cell_mode, vacuum=a.vacuum, shape=a.box_shape)}
    if a.command == "select":
        k = None if a.kmeans_k == "auto" else int(a.kmeans_k)
        if a.strict_determinism:
            os.environ |= dict.fromkeys(("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"), "1")
        options["selection"] = Selection(a.n_select, n_init=a.kmeans_n_init, minibatch_threshold=a.minibatch_threshold, strict_determinism=a.strict_determinism, method=a.method, normalize=a.normalize, random_state=a.seed, min_dist2=a.min_dist2, fps_init=a.fps_init, k=k, per_cluster=a.kmeans_per_cluster, fill=a.kmeans_fill, trim=a.kmeans_trim)
        options |= {"seeds": a.selected_images, "cache": a.cache_root, "stream": Stream(a.batch_size, a.pool_alpha, a.pool_cap, a.pool_stage) if a.batch_size else None}
    run(spark, a.traj, a.out, **options)
    if a.command == "select" and a.plot:
        figures(spark, a.out, a.embed, a.embed_max_points, a.seed)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 when done, 2 for an error that the user can mend, 3 for a featurizer that isn't there, 130 when interrupted."""
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    logging.basicConfig(level=LEVELS[a.verbose])
    try:
        execute(spark or SparkSession.builder.appName("farspread").getOrCreate(), a, argv)
    except (SpreadError, ValueError) as e:
        print(f"farspread: {e}", file=sys.stderr)
        return 2
    except NotImplementedError as e:
        print(f"farspread: {e}", file=sys.stderr)
        return 3
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
