"""k-means with seed-covered clusters: a deterministic Lloyd fit, and what is picked from its clusters."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import checkpointed
from .fps import ONE_GROUP_BYTES

log = logging.getLogger(__name__)


def assign(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """df with cluster and center_d2: the nearest centre, ties to the lowest number."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centres, float))
    names = df.columns

    def run(batches):
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("features").to_pylist(), float)
            d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T, 0)
            k = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.astype(np.int64)), pa.array(((x - c[k]) ** 2).sum(1))], names=[*names, "cluster", "center_d2"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, cluster long, center_d2 double")


def _sums(starts):
    """Of each start and cluster the number of rows, their sum, and the squared distances to the centre, task by task."""

    def run(batches):
        centres = starts.value
        held = {i: (np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))) for i, c in centres.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            own = (x**2).sum(1)
            for i, c in centres.items():
                d = own[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T
                k = d.argmin(1)
                total, count, cost = held[i]
                np.add.at(total, k, x)
                count += np.bincount(k, minlength=len(c))
                cost += np.bincount(k, np.maximum(d[np.arange(len(x)), k], 0), minlength=len(c))
        for i, (total, count, cost) in held.items():
            own = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own), pa.array(count[own]), pa.array(cost[own]), pa.array(list(total[own]), pa.list_(pa.float64()))], names=["start", "cluster", "n", "cost", "total"])

    return run


def _added(batches):
    """Sums of arrays by (start, cluster): no number becomes a row of its own."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for start, cluster, n, cost, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = held.setdefault((start, cluster), [0, 0.0, 0.0])
            own[0], own[1], own[2] = own[0] + n, own[1] + cost, own[2] + np.array(total)
    if held:
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1] for k in keys]), pa.array([held[k][2].tolist() for k in keys], pa.list_(pa.float64()))], names=["start", "cluster", "n", "cost", "total"])


_SUMS = "start long, cluster long, n long, cost double, total array<double>"


def lloyd(df: DataFrame, centres, rounds: int = 300, tolerance: float = 1e-6, budget: int = ONE_GROUP_BYTES) -> tuple[np.ndarray, DataFrame]:
    """Centres and assigned rows of the best of several starts (a list of centre matrices, or one).

    Each start is fitted until no centre moves further than tolerance; rounds is a bound that is warned about when it is
    met. The start with the least sum of squared distances wins, the first among equals. While the rows of all starts fit
    the budget a start is one group; beyond it the starts are fitted in the same passes over the distributed rows.
    """
    starts = [np.asarray(c, float) for c in (centres if isinstance(centres, list) else [centres])]
    df = checkpointed(df)
    features = df.select(F.col("features").cast("array<double>").alias("features"))
    width = starts[0].shape[1] if len(starts[0]) else 0
    small = df.count() * width * 8 * len(starts) <= budget
    fitted, cost, open_ = (_fit_groups if small else _fit_passes)(features, starts, rounds, tolerance)
    if open_:
        log.warning("%d of %d k-means starts had not converged after %d rounds", open_, len(starts), rounds)
    best = min(range(len(starts)), key=lambda i: (cost[i], i))
    return fitted[best], assign(df, fitted[best])


def _fit_groups(features: DataFrame, starts: list[np.ndarray], rounds: int, tolerance: float) -> tuple[list[np.ndarray], list[float], int]:
    """Centres and costs of each start, and how many hadn't converged; the rows of a start are one group."""

    def fit(key, pdf):
        x = np.vstack(pdf["features"].to_numpy())
        x = x[np.lexsort(x.T[::-1])]  # sums don't depend on how rows were dealt
        c, own = starts[key[0]].copy(), (x**2).sum(1)
        moved = np.inf
        for _ in range(rounds):
            d = own[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T
            k = d.argmin(1)
            order = np.argsort(k, kind="stable")
            begin = np.flatnonzero(np.diff(k[order], prepend=-1))
            new = c.copy()
            new[k[order][begin]] = np.add.reduceat(x[order], begin) / np.diff(np.append(begin, len(x)))[:, None]
            moved = ((new - c) ** 2).sum(1).max()
            cost = float(np.maximum(d[np.arange(len(x)), k], 0).sum())
            c = new
            if moved <= tolerance**2:
                break
        return pd.DataFrame({"start": key[0], "cluster": np.arange(len(c)), "cost": cost, "open": bool(moved > tolerance**2), "centre": c.tolist()})

    every = features.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(len(starts) - 1))))
    rows = every.groupBy("start").applyInPandas(fit, "start int, cluster long, cost double, open boolean, centre array<double>").orderBy("start", "cluster").collect()
    fitted, cost, open_ = list(starts), [0.0] * len(starts), set()
    for i in {r.start for r in rows}:
        own = [r for r in rows if r.start == i]
        fitted[i], cost[i] = np.array([r.centre for r in own]), own[0].cost
        open_ |= {i} if own[0].open else set()
    return fitted, cost, len(open_)


def _fit_passes(features: DataFrame, starts: list[np.ndarray], rounds: int, tolerance: float) -> tuple[list[np.ndarray], list[float], int]:
    """The same by passes over distributed rows; the driver gets a row for each start and cluster in a round."""
    fitted = list(starts)
    moving = dict(enumerate(starts))
    cost = [0.0] * len(starts)
    for _ in range(rounds):
        shared = features.sparkSession.sparkContext.broadcast(moving)
        merged = features.mapInArrow(_sums(shared), _SUMS).repartition("start", "cluster").mapInArrow(_added, _SUMS)
        new = {i: c.copy() for i, c in moving.items()}
        for i in moving:
            cost[i] = 0.0
        for r in merged.collect():
            new[r.start][r.cluster] = np.array(r.total) / r.n
            cost[r.start] += r.cost
        for i, c in list(moving.items()):
            fitted[i] = new[i]
            if not len(c) or ((new[i] - c) ** 2).sum(1).max() <= tolerance**2:
                moving.pop(i)
            else:
                moving[i] = new[i]
        if not moving:
            break
    return fitted, cost, len(moving)


def uncovered(assigned: DataFrame) -> DataFrame:
    """Candidates of clusters that hold no seed; assigned has is_seed and cluster."""
    covered = assigned.where("is_seed").select("cluster").distinct()
    return assigned.where("not is_seed").join(covered, "cluster", "left_anti")


def representatives(assigned: DataFrame, per_cluster: int = 1, second_pick: str = "farthest", order: str = "pos") -> DataFrame:
    """Rows with slot, population: the nearest to the centre, then with several picks the farthest (or not), then the next nearest."""
    near = F.row_number().over(Window.partitionBy("cluster").orderBy("center_d2", order))
    population = F.count("*").over(Window.partitionBy("cluster"))
    ranked = assigned.withColumn("_near", near).withColumn("population", population.cast("long"))
    last = F.col("_near") == F.col("population")
    if per_cluster == 1 or second_pick != "farthest":
        return ranked.where(F.col("_near") <= per_cluster).withColumn("slot", (F.col("_near") - 1).cast("long")).drop("_near")
    slot = F.when(F.col("_near") == 1, 0).when(last, 1).when(F.col("_near") <= per_cluster - 1, F.col("_near"))
    return ranked.withColumn("slot", slot.cast("long")).where(F.col("slot").isNotNull()).drop("_near")


def trim_by_population(reps: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The n representatives of the most populous clusters, nearest first."""
    return reps.orderBy(F.desc("population"), "center_d2", order).limit(n)
