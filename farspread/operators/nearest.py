"""Distances to the nearest of a set, column means, and pairwise statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpointed
from .fps import least_squared_distances

#: Vectors of one broadcast block, and blocks that are met in one pass before lineage is cut.
BLOCK, CHAIN = 8192, 8
#: Parts that partial sums are added up in before they come to the driver.
PARTS = 32


def rows_of(batch: pa.RecordBatch, column: str = "features") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def column_means(df: DataFrame) -> list[float]:
    """The mean of each dimension: partial sums per task, added up in PARTS rows for the driver."""
    schema = "n long, total array<double>"

    def part(batches):
        n, total = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + rows_of(batch).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "total"])

    def added(batches):
        n, total = 0, 0.0
        for batch in batches:
            for own, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, total = n + own, total + np.array(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "total"])

    parts = df.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(part, schema)
    rows = parts.repartition(PARTS).mapInArrow(added, schema).collect()
    return (np.sum([r.total for r in rows], axis=0) / sum(r.n for r in rows)).tolist() if rows else []


def min_squared_distance(cand: DataFrame, seed: DataFrame) -> DataFrame:
    """cand with d2, the squared distance to the nearest seed vector (inf without any).

    Equal seeds count once. The seed set goes out in blocks of bounded size, one pass over the candidates each, with a
    checkpoint every CHAIN passes; no pair becomes a row.
    """
    n = seed.count()
    blocks = max(1, -(-n // BLOCK))
    if blocks > 1:
        seed = checkpointed(seed.select("features").distinct())
        blocks = max(1, -(-seed.count() // BLOCK))
    out = cand.withColumn("d2", F.lit(float("inf")))
    schema = out.schema
    names = cand.columns
    for b in range(blocks):
        own = seed.where(F.pmod(F.xxhash64("features"), F.lit(blocks)) == b) if blocks > 1 else seed
        s = np.array([r.features for r in own.select("features").collect()], float)  # about BLOCK rows
        shared = cand.sparkSession.sparkContext.broadcast(s if len(s) else None)

        def run(batches, shared=shared):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.array(batch.column("features").to_pylist(), float)
                d = np.minimum(batch.column("d2").to_numpy(), least_squared_distances(x, shared.value))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(d)], names=[*names, "d2"])

        out = out.mapInArrow(run, schema)
        if (b + 1) % CHAIN == 0 and b + 1 < blocks:
            out = checkpointed(out)
    return out


def sample_matrix(df: DataFrame, column: str = "features", key: str = "pos") -> tuple[np.ndarray, np.ndarray]:
    """(keys, vectors) of a sample whose rows the caller bounds (see ordering.sample), in the order of its keys."""
    rows = df.select(key, column).orderBy(key).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float).reshape(len(rows), -1 if rows else 0)


def distances_from(x: np.ndarray, y: np.ndarray, step: int = 32):
    """(rows from, rows to, distances of x's rows to all of y), some rows at a time."""
    for a in range(0, len(x), step):
        yield a, min(len(x), a + step), np.sqrt(((x[a : a + step, None, :] - y[None, :, :]) ** 2).sum(2))


def distance_stats(sample: DataFrame, key: str = "pos") -> DataFrame:
    """One row of all pairs of a bounded sample (key, features): n_pairs, mean, population deviation, least, most, relative
    spread, and whether distances concentrate.

    The sample goes to every task, and each gives the count, mean, squares about it, least and most of its rows' pairs.
    """
    spark = sample.sparkSession
    keys, y = sample_matrix(sample, key=key)
    shared = spark.sparkContext.broadcast((keys, y))

    def part(batches):
        keys, y = shared.value
        for batch in batches:
            out = []
            own, x = batch.column(0).to_numpy(), rows_of(batch) if batch.num_rows else np.zeros((0, 1))
            for a, b, d in distances_from(x, y):
                d = d[own[a:b, None] < keys[None, :]]
                if len(d):
                    out.append((len(d), d.mean(), ((d - d.mean()) ** 2).sum(), d.min(), d.max()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["n", "mean", "m2", "least", "most"])

    rows = sample.select(F.col(key), F.col("features").cast("array<double>").alias("features")).repartition(spark.sparkContext.defaultParallelism)
    got = rows.mapInArrow(part, "n long, mean double, m2 double, least double, most double").collect()  # a row for 32 of the sample
    n = sum(r.n for r in got)
    mean = sum(r.n * r.mean for r in got) / n if n else None
    std = (sum(r.m2 + r.n * (r.mean - mean) ** 2 for r in got) / n) ** 0.5 if n else None
    spread = (std / mean if mean > 0 else 0.0) if n else None
    row = (n, mean, std, min((r.least for r in got), default=None), max((r.most for r in got), default=None), spread, None if spread is None else spread < 0.1)
    return spark.createDataFrame([row], "n_pairs long, mean double, std double, min double, max double, rel_spread double, concentrated boolean")
