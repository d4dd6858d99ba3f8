"""Gathering: the frames that a selection names, in its order, stamped with where they came from."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.describe import gather_unique, legacy_index, out_of_range
from . import xyz

log = logging.getLogger(__name__)


def stamped(selection: DataFrame, frames: DataFrame, *, descriptor_id: str | None = None, run_id: str | None = None, extra_info: Mapping[str, Any] | None = None) -> DataFrame:
    """frames of the selection (rank, source_file, frame_index[, cluster, score]) with rank, and stamps in info.

    A frame named twice comes once, at its best rank. Stamps replace entries of the same name; those without a value are left out.
    """
    once = gather_unique(selection)
    text = lambda c: F.col(c).cast("string")
    values = {"spread_src": F.concat_ws(":", "source_file", text("frame_index")), "spread_rank": text("rank"), "original_index": text("frame_index")}
    values |= {k: F.lit(str(v)) for k, v in {"spread_descriptor_id": descriptor_id, "spread_run_id": run_id, **(extra_info or {})}.items() if v is not None}
    values |= {k: text(c) for k, c in (("cluster", "cluster"), ("spread_score", "score")) if c in selection.columns}
    names = [c for c in ("rank", "cluster", "score") if c in selection.columns]
    joined = frames.drop(*names).join(once.select("source_file", "frame_index", *names), ["source_file", "frame_index"])
    stamps = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    own = F.map_filter(F.coalesce("info", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*values))
    return joined.withColumn("info", F.map_concat(own, stamps))


def gather(selection: DataFrame, frames: DataFrame, path: str, **stamps) -> int:
    """Writes the stamped frames by rank: Parquet, or extended XYZ row by row if the path ends so. Returns how many."""
    lost = out_of_range(gather_unique(selection), frames.select("source_file", "frame_index")).select("source_file", "frame_index")
    if n := lost.count():
        log.warning("%d selected frames are not in their sources, such as %s", n, [tuple(r) for r in lost.limit(5).collect()])
    out = stamped(selection, frames, **stamps)
    if path.endswith((".xyz", ".extxyz")):
        rows = out.orderBy("rank").select("numbers", "positions", "cell", "pbc", "info")
        return xyz.write(rows.toLocalIterator(), path)
    out.orderBy("rank").write.mode("overwrite").parquet(path)
    return frames.sparkSession.read.parquet(path).count()


def read_selection(spark: SparkSession, path: str, fallback_source: str | None = None) -> DataFrame:
    """(rank, source_file, frame_index[, cluster, score]) of a selection CSV; an older one names original_index alone."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True)
    if not {"source_file", "frame_index"} <= {*rows.columns}:
        if "original_index" not in rows.columns:
            raise ValueError(f"{path} has neither source_file and frame_index nor original_index")
        if fallback_source is None:
            raise ValueError(f"{path} has no source_file; name the source")
        rows = legacy_index(rows, fallback_source)
    types = {"rank": "long", "frame_index": "long", "cluster": "long", "score": "double"}
    if "rank" not in rows.columns:
        rows = rows.withColumn("rank", F.monotonically_increasing_id())
    return rows.select("source_file", *[F.expr(f"try_cast({c} AS {t})").alias(c) for c, t in types.items() if c in rows.columns])
