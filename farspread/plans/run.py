"""Whole runs: frames in processing order, described, selected, gathered, and recorded in a manifest."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import Box, Sampling, Selection, Stream
from ..functions.errors import DescriptorMismatchError, FeatureTableError, SpeciesError, VacuumTooSmallError
from ..functions.identity import cache_key, descriptor_id, require_compatible
from ..functions.provenance import provenance_key, split_source
from ..functions.species import SYMBOLS, hill_formula, unsupported
from ..functions.vectors import l2_normalize
from ..operators.box import needs_cell, with_cells
from ..operators.checkpoints import checkpointed
from ..operators.describe import basename_collisions, check_coverage, lookup, missing, numbered, select_group, status
from ..operators.featurizers import Featurizer
from ..operators.ordering import shuffle_key, stride, with_position
from ..operators.select import finite_range, select_diverse, shortfall
from ..sources import files, gather
from ..sources.frames import first_frame, load, with_file_facts
from ..streaming.pool import select_streamed

log = logging.getLogger(__name__)


def scan(spark: SparkSession, patterns: list[str], sampling: Sampling | None = None) -> DataFrame:
    """Frames of all files with pos, their place in processing order: enumerated, thinned, cut, then shuffled."""
    sampling = sampling or Sampling(shuffle=False)
    paths = files.expand_patterns(patterns)
    order = spark.createDataFrame(list(enumerate(paths)), "file_id int, source_file string")
    frames = load(spark, paths).join(F.broadcast(order), "source_file")
    kept = stride(with_position(frames, "file_id", "frame_index"), sampling.stride)
    if sampling.max_frames is not None:
        kept = kept.where(F.col("pos") < sampling.max_frames * sampling.stride)
    key = F.concat_ws(":", F.col("file_id").cast("string"), F.col("frame_index").cast("string"))
    return with_position(kept.drop("pos"), *([shuffle_key(sampling.seed, key)] if sampling.shuffle else []), "file_id", "frame_index")


def probe_boxes(patterns: list[str], box: Box, cutoff: float | None, on_small_vacuum: str = "error") -> None:
    """Fails before a run if the vacuum is too small and a file's first frame needs a cell; later frames are checked one by one."""
    if cutoff is None or box.vacuum_is_sufficient(cutoff):
        return
    short = f"twice the vacuum ({2 * box.vacuum:g}) is less than the cutoff ({cutoff:g})"
    if on_small_vacuum == "skip":
        log.warning("%s; structures that need a cell will be skipped as small_vacuum", short)
        return
    if box.mode == "box":
        raise VacuumTooSmallError(f"every structure gets a cell, but {short}")
    for path in files.expand_patterns(patterns):
        frame = first_frame(path)
        if frame is not None and needs_cell(frame[2], frame[3], box):
            raise VacuumTooSmallError(f"the first frame of {path} needs a cell, but {short}")


def features_of(spark: SparkSession, path: str, group: str | None = None) -> tuple[DataFrame, DataFrame | None, dict]:
    """(key, valid, features), the records that a store skipped with their status, and the identity of the vectors."""
    if (kind := files.resolve(path)) != "store":
        table = select_group(files.read_table(spark, path) if kind == "table" else files.read_numpy_table(spark, path), group)
        return table.select("key", "valid", "features"), None, {"featurizer": "table", "source": os.path.basename(path), **files.table_identity(spark, path)}
    rows, skipped, meta = files.read_store(spark, path)
    key = provenance_key(F.col("source_file"), F.col("frame_index")).alias("key")
    return rows.select(key, F.lit(True).alias("valid"), "features"), skipped.select(key, F.col("status").alias("inherited")), {"descriptor_id": meta["descriptor_id"]}


def describe(frames: DataFrame, *, featurizer: Featurizer | None = None, table: DataFrame | None = None, skipped: DataFrame | None = None, box: Box | None = None, normalize: str = "l2", on_invalid: str = "error", on_unknown: str = "error", on_small_vacuum: str = "error") -> DataFrame:
    """One row for every frame: provenance, formula, cell_mode, status, row (null unless ok) and features.

    Vectors come from a table (key, valid, features) or are made by the featurizer.
    """
    if (featurizer is None) == (table is None):
        raise ValueError("give a featurizer or a table")
    box = box or Box()
    if table is not None:
        if bad := basename_collisions(frames.select("source_file").distinct()).limit(5).collect():
            raise FeatureTableError(f"several files are called {[r.name for r in bad]}")
        frames = frames.withColumn("key", provenance_key(F.col("source_file"), F.col("frame_index")))
        needed = frames if skipped is None else frames.join(skipped, "key", "left_anti")
        check_coverage(needed, table, on_invalid=on_invalid)
        frames = lookup(frames, table).withColumns({"cell_mode": F.lit("native"), "box_error": F.lit(None).cast("string"), "small_vacuum": F.lit(False)})
        frames = frames.withColumn("inherited", F.lit(None).cast("string")) if skipped is None else frames.join(skipped, "key", "left")
        unknown = F.array().cast("array<string>")
    else:
        frames = with_cells(frames, box, featurizer.cutoff, on_small_vacuum).withColumns({"valid": F.lit(True), "inherited": F.lit(None).cast("string")})
        symbols = F.array(*map(F.lit, SYMBOLS))
        unknown = F.transform(unsupported(F.col("numbers"), featurizer.species or ()), lambda z: F.concat(F.element_at(symbols, z + 1), F.lit("("), z.cast("string"), F.lit(")")))
        if on_unknown == "error" and (bad := frames.where(F.size(unknown) > 0).select("source_file", "frame_index", unknown.alias("u")).limit(5).collect()):
            raise SpeciesError(f"species that weren't asked for: {[tuple(r) for r in bad]}")
    frames = frames.withColumn("status", status(small_vacuum=F.col("small_vacuum"), vacuum=F.lit(box.vacuum), cutoff=F.lit(featurizer.cutoff if featurizer else None), box_error=F.col("box_error"), unknown=unknown, inherited_status=F.col("inherited"), valid=F.col("valid")))
    if featurizer is not None:
        frames = featurizer.featurize(frames)
    frames = frames.withColumn("features", F.when(F.col("status") == "ok", l2_normalize(F.col("features").cast("array<double>"), normalize)))
    out = frames.select("pos", "source_file", "frame_index", F.size("numbers").alias("natoms"), hill_formula(F.col("numbers")).alias("formula"), "cell_mode", "status", "features")
    return checkpointed(numbered(checkpointed(out)))


def seed_vectors(spark: SparkSession, paths: list[str], identity: dict, featurizer: Featurizer, box: Box, normalize: str, cache: str | None = None) -> DataFrame:
    """(features, source_file) of earlier selections, described as this run is. Files stamped by another descriptor are refused, unstamped ones trusted.

    With a cache folder a file's vectors are kept as Parquet under its identity, path, size and time.
    """
    out = None
    for path in files.expand_patterns(paths):
        stat = os.stat(path)
        kept = cache and f"{cache}/{descriptor_id(identity)}/{cache_key(os.path.realpath(path), stat.st_size, stat.st_mtime_ns, asdict(box))}"
        frames = scan(spark, [path])
        stamps = {r.i: r.f for r in frames.select(F.col("info")["spread_descriptor_id"].alias("i"), F.col("info")["spread_descriptor_fields"].alias("f")).where("i is not null").distinct().orderBy("i").limit(5).collect()}
        if len(stamps) > 1:
            raise DescriptorMismatchError(f"{path} holds frames of several descriptors: {sorted(stamps)[:2]}")
        for found, fields in stamps.items():
            if found != descriptor_id(identity):
                if fields:
                    require_compatible(identity, json.loads(fields), path)
                raise DescriptorMismatchError(f"{path} was described as {found}, this run as {descriptor_id(identity)}")
        if not stamps:
            log.warning("%s has no stamp; its descriptor can't be checked", path)
        if kept and os.path.isdir(kept):
            vectors = spark.read.parquet(kept)
        else:
            rows = describe(frames, featurizer=featurizer, box=box, normalize=normalize, on_unknown="skip").where("row is not null")
            vectors = rows.select("features", F.lit(path).alias("source_file"))
            if kept and rows.count():
                vectors.write.mode("overwrite").parquet(kept)
        out = vectors if out is None else out.unionByName(vectors)
    return out


def seed_lookup(spark: SparkSession, paths: list[str], table: DataFrame, own_id: str, normalize: str) -> DataFrame:
    """(features, source_file) of earlier selections from the run's own table of vectors, found by the frame that a stamp names.

    A file without stamps is looked up by its own name. Files stamped by another descriptor, and frames that the table
    lacks, are refused.
    """
    paths = files.expand_patterns(paths)
    frames = load(spark, paths)
    found = {r[0] for r in frames.select(F.col("info")["spread_descriptor_id"]).distinct().limit(5).collect()} - {None}
    if found - {own_id}:
        raise DescriptorMismatchError(f"the seeds were described as {sorted(found)}, this run as {own_id}")
    src = split_source(F.col("info")["spread_src"])
    key = F.when(F.col("info")["spread_src"].isNotNull(), provenance_key(src["source_file"], src["frame"])).otherwise(provenance_key(F.col("source_file"), F.col("frame_index")))
    rows = frames.select("source_file", key.alias("key"))
    if lost := missing(rows, table.where("valid")).select("key").limit(5).collect():
        raise FeatureTableError(f"the table has no vectors of the seeds {[r.key for r in lost]}")
    return rows.join(table, "key").select(l2_normalize(F.col("features"), normalize).alias("features"), "source_file")


def run(spark: SparkSession, patterns: list[str], out: str, *, selection: Selection | None = None, featurizer: Featurizer | None = None, features: str | None = None, group: str | None = None, sampling: Sampling | None = None, box: Box | None = None, stream: Stream | None = None, seeds: list[str] | None = None, cache: str | None = None, normalize: str = "l2", save_features: str | None = None, on_invalid: str = "error", on_unknown: str = "error", on_small_vacuum: str = "error") -> dict:
    """Describes the frames into out/frames.parquet and, given a selection, writes out/selected.parquet, selected.extxyz and the manifest, which is returned.

    ``stream`` bounds what a selection holds at a time, by either method; without it, and with precomputed vectors, a
    selection is exact.
    """
    sampling, box = sampling or Sampling(), box or Box()
    if featurizer is not None and features is None:
        probe_boxes(patterns, box, featurizer.cutoff, on_small_vacuum)
    frames = checkpointed(scan(spark, patterns, sampling))
    table = skipped = None
    if features is not None:
        table, skipped, identity = features_of(spark, features, group)
    else:
        identity = featurizer.identity()
    identity = {"normalize": normalize, **identity}
    own_id = identity["descriptor_id"] if "descriptor_id" in identity else descriptor_id(identity)
    described = describe(frames, featurizer=None if features else featurizer, table=table, skipped=skipped, box=box, normalize=normalize, on_invalid=on_invalid, on_unknown=on_unknown, on_small_vacuum=on_small_vacuum)
    good = described.where("row is not null")
    first = good.select(F.size("features").alias("d")).first()
    files.write_store(described, out, own_id, first.d if first else 0)
    if save_features:
        files.export_table(described, save_features, {**identity, "descriptor_id": own_id})
    counts = {r.status: r["count"] for r in described.groupBy("status").count().collect()}
    modes = {str(r.cell_mode): r["count"] for r in described.groupBy("cell_mode").count().collect()}
    parts = {"descriptor": {**identity, "descriptor_id": own_id}, "box": asdict(box), "inputs": [r.asDict() for r in with_file_facts(files.source_summary(frames)).orderBy("source_file").collect()], "sampling": asdict(sampling), "status": counts, "cell_modes": modes}
    record = files.manifest(spark, **parts)
    if selection is not None:
        cand = good.select(F.col("row").alias("pos"), "features")
        seed = None
        if seeds:
            seed = seed_lookup(spark, seeds, table, own_id, normalize) if features is not None else seed_vectors(spark, seeds, identity, featurizer, box, normalize, cache)
        s = selection
        seed = None if seed is None else checkpointed(seed)
        if stream is not None and features is None:
            picked = select_streamed(cand, s, stream, None if seed is None else seed.select("features"))
        else:
            picked = select_diverse(cand, s.n_select, None if seed is None else seed.select("features"), **s.options())
        chosen = checkpointed(picked.withColumnRenamed("pos", "row").join(good.select("row", "source_file", "frame_index", "natoms", "formula"), "row"))
        chosen.select("rank", "row", "source_file", "frame_index", "natoms", "formula", "pick_stage", "cluster", "score", "center_d2").orderBy("rank").write.mode("overwrite").parquet(f"{out}/selected.parquet")
        per_file = {} if seed is None else {r.source_file: r["count"] for r in seed.groupBy("source_file").count().collect()}
        stamps = {"descriptor_id": own_id, "run_id": record["run"]["run_id"], "extra_info": {"spread_descriptor_fields": json.dumps(identity)}}
        n = gather.gather(chosen, frames.drop("pos", "file_id"), f"{out}/selected.extxyz", **stamps)
        low, high = finite_range([r.score for r in chosen.select("score").collect()])  # n_select rows
        record |= {"selection": asdict(s), "seed_set": {"files": list(seeds or ()), "rows": sum(per_file.values()), "rows_per_file": per_file}, "results": {"n_selected": n, "shortfall_reason": shortfall(n, s.n_select, cand.count(), fill=s.fill, method=s.method, min_dist2=s.min_dist2), "score_min": low, "score_max": high}}
    files.write_manifest(f"{out}/run_manifest.json", record)
    return record
