"""Patterns, descriptor stores, feature tables and manifests."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import logging
import platform
import uuid
import zipfile
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import FeatureTableError, ScanError
from ..operators.checkpoints import shared_folder

log = logging.getLogger(__name__)
#: Rows of a numpy file that the driver holds at a time.
NUMPY_STEP = 50_000


def expand_patterns(patterns: list[str]) -> list[str]:
    """Files of all patterns in order, each resolved path once, as first spelt."""
    out, seen = [], set()
    for p in patterns:
        found = sorted(glob.glob(p)) or ([p] if os.path.exists(p) else [])
        if not found:
            raise ScanError(f"nothing matches {p!r}")
        for f in found:
            real = os.path.realpath(f)
            if real not in seen:
                seen.add(real)
                out.append(f)
    return out


def source_summary(frames: DataFrame) -> DataFrame:
    """(source_file, n_frames) of scanned frames."""
    return frames.groupBy("source_file").agg(F.count("*").alias("n_frames"))


def write_store(frames: DataFrame, path: str, identity: str, width: int) -> None:
    """The descriptor store: one Parquet table of status, provenance and features, and its identity beside it."""
    frames.write.mode("overwrite").parquet(f"{path}/frames.parquet")
    meta = frames.sparkSession.createDataFrame([(identity, width, "float32")], "descriptor_id string, feature_dim long, dtype string")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/store.json")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(described rows, skipped rows with their status, identity)."""
    frames = spark.read.parquet(f"{path}/frames.parquet")
    return frames.where(F.col("row").isNotNull()), frames.where(F.col("row").isNull()).select("source_file", "frame_index", "status"), spark.read.json(f"{path}/store.json").first().asDict()


def export_table(frames: DataFrame, path: str, identity: dict | None = None) -> DataFrame:
    """The interchange columns of described rows, by row, and the vectors' identity beside them, as read_table reads them."""
    key = F.concat(F.regexp_extract("source_file", r"([^/]*)$", 1), F.lit(":"), F.col("frame_index").cast("string"))
    out = frames.where("row is not null").select("row", key.alias("structure_id"), F.lit(True).alias("valid"), F.regexp_extract("source_file", r"([^/]*)$", 1).alias("source_file"), "frame_index", "features").orderBy("row")
    out.write.mode("overwrite").parquet(f"{path}/table.parquet")
    frames.sparkSession.createDataFrame([(json.dumps(identity or {}),)], "identity string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata.json")
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, group_label, valid, features) of an exported table."""
    rows = spark.read.parquet(f"{path}/table.parquet")
    key = F.concat(F.regexp_extract("source_file", r"([^/]*)$", 1), F.lit(":"), F.col("frame_index").cast("long").cast("string"))
    group = F.col("group_label") if "group_label" in rows.columns else F.lit(None)
    return rows.select(key.alias("key"), group.cast("string").alias("group_label"), "valid", F.col("features").cast("array<double>").alias("features"))


def table_identity(spark: SparkSession, path: str) -> dict:
    """What the metadata beside a table says of its vectors; empty, with a warning, where there is none."""
    if os.path.isdir(f"{path}/metadata.json"):
        return json.loads(spark.read.json(f"{path}/metadata.json").first().identity)
    beside = f"{path.removesuffix('.npz')}.metadata.json"
    if os.path.exists(beside):
        with open(beside) as f:
            return json.load(f)
    log.warning("%s has no metadata; what made its vectors isn't known", path)
    return {}


def _array_chunks(path: str, name: str):
    """(first row, rows) of an array of an npz file, some rows at a time, without reading it whole."""
    with zipfile.ZipFile(path) as z, z.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran and len(shape) > 1:
            raise FeatureTableError(f"{path}: {name} must be stored row by row")
        width = int(np.prod(shape[1:])) * kind.itemsize
        for at in range(0, shape[0], NUMPY_STEP):
            n = min(NUMPY_STEP, shape[0] - at)
            yield at, np.frombuffer(f.read(n * width), kind).reshape((n, *shape[1:]))


def read_numpy_table(spark: SparkSession, prefix: str) -> DataFrame:
    """(key, group_label, valid, features) of <prefix>.npz with <prefix>.index.csv.

    The vectors go to a table in the shared folder, NUMPY_STEP rows at a time, and are joined with the index by row.
    """
    prefix = prefix.removesuffix(".npz")
    index_path = f"{prefix}.index.csv"
    if not os.path.exists(index_path):
        raise FeatureTableError(f"{index_path} is missing")
    with np.load(f"{prefix}.npz") as data:
        marked = "valid" in data.files
    shared = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    n, flags = 0, _array_chunks(f"{prefix}.npz", "valid") if marked else None
    for at, x in _array_chunks(f"{prefix}.npz", "features"):
        if x.ndim != 2:
            raise FeatureTableError(f"{prefix}.npz: features must be two-dimensional")
        valid = next(flags)[1].astype(bool) if flags else np.ones(len(x), bool)
        part = pa.table({"row": np.arange(at, at + len(x)), "valid": valid, "features": pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))})
        spark.createDataFrame(part).write.mode("append").parquet(shared)
        n += len(x)
    index = spark.read.csv(index_path, header=True, ignoreLeadingWhiteSpace=True)
    if (rows := index.count()) != n:
        raise FeatureTableError(f"{index_path} has {rows} rows for {n} vectors")
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    if {"source_file", "frame_index"} <= {*index.columns}:
        key = F.concat(base(F.col("source_file")), F.lit(":"), F.col("frame_index").cast("long").cast("string"))
    elif "structure_id" in index.columns:
        key = F.concat(base(F.regexp_extract("structure_id", "^(.*):([^:]*)$", 1)), F.lit(":"), F.regexp_extract("structure_id", "^(.*):([^:]*)$", 2).cast("long").cast("string"))
    else:
        raise FeatureTableError(f"{index_path} has neither source_file and frame_index nor structure_id")
    if "row" not in index.columns:
        raise FeatureTableError(f"{index_path} has no column row")
    group = F.col("group_label") if "group_label" in index.columns else F.lit(None)
    index = index.select(F.col("row").cast("long").alias("row"), key.alias("key"), group.cast("string").alias("group_label"))
    vectors = spark.read.parquet(shared) if n else spark.createDataFrame([], "row long, valid boolean, features array<float>")
    return index.join(vectors, "row").select("key", "group_label", "valid", F.col("features").cast("array<double>").alias("features"))


def resolve(path: str) -> str:
    """What a features path is: 'store', 'table' (Parquet) or 'numpy'."""
    if os.path.isdir(os.path.join(path, "frames.parquet")):
        return "store"
    if os.path.isdir(os.path.join(path, "table.parquet")):
        return "table"
    if path.endswith(".npz") or os.path.exists(f"{path}.npz"):
        return "numpy"
    raise FeatureTableError(f"{path} is neither a descriptor store nor a feature table")


def file_fingerprint(path: str) -> str:
    s = os.stat(path)
    return hashlib.sha256(f"{os.path.realpath(path)}|{s.st_size}|{s.st_mtime_ns}".encode()).hexdigest()[:24]


def manifest(spark: SparkSession, **parts) -> dict:
    """A run's record: identity, environment, settings and results."""
    return {"schema_version": 1, "run": {"run_id": uuid.uuid4().hex[:12], "timestamp_utc": datetime.now(UTC).isoformat(timespec="seconds")}, "env": {"python": platform.python_version(), "spark": spark.version, "numpy": np.__version__}, **parts}


def write_manifest(path: str, doc: dict) -> None:
    with open(path, "w") as f:
        json.dump(doc, f, indent=2, default=str)


def read_manifest(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
