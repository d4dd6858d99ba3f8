"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Bytes of rows of a few numbers that may be broadcast.
BROADCAST_BYTES = 24_000_000
#: Rows of two numbers that one task of a round of connected components handles, at least.
TASK_ROWS = 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % n).cast("int")


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir; only a local master may go without."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def small_or_plain(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df (of numbers, checkpointed) with a broadcast hint if its rows, 8 bytes a column and 16 more, take few enough bytes;
    else as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * (8 * len(df.columns) + 16) <= BROADCAST_BYTES else df


def byte_slices(texts: list[str | None], limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about limit characters; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what a function holds for each row of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and after it free memory goes back to the system: Python workers live on and would keep their largest task's."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidy


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the component's smallest node.

    Labels take the least label around them and then jump to their label's label, until none changes. Each round
    aggregates before it shuffles and is checkpointed, so a lost executor costs one round at most.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = checkpointed(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parts = -(-both.count() // TASK_ROWS) or 1
    kept = lambda df: checkpointed(df.coalesce(parts))  # noqa: E731  no more tasks a round than its rows need
    both = both.coalesce(parts)
    labels = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:
        near = small_or_plain(labels.select(F.col("node").alias("v"), "root"))
        around = both.join(near, "v").groupBy("u").agg(F.min("root").alias("m"))
        hooked = kept(labels.join(around, F.col("node") == F.col("u")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root")))
        # Labels of the roots alone, one row each: a component of any size is not gathered at its root.
        roots = hooked.select("root").distinct().withColumnRenamed("root", "node")
        target = kept(hooked.join(roots, "node").select(F.col("node").alias("root"), F.col("root").alias("next")))
        jumped = kept(hooked.join(small_or_plain(target), "root").select("node", "was", F.col("next").alias("root")))
        changed = jumped.where("root <> was").limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels
