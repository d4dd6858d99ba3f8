"""Bounded-memory selection over micro-batches with a carry-forward pool.

Each batch gives its quota of points, the farthest from the user's seed and from the pool so far, or random ones; the
pool is cut back to its cap by the farthest-point rule; the final pass picks from the pool. A batch is read from its part
of a table in the shared folder and narrowed on the executors; the driver holds the pool.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import Selection, Stream
from ..operators.checkpoints import checkpointed, kept_by
from ..operators.fps import Picks, as_matrix, fps, greedy, seed_matrix
from ..operators.ordering import batch_of, n_batches, quota, sample
from ..operators.select import select_diverse

RESULT = "rank long, pos long, score double"


class Pool:
    """State of a run: positions and features of provisional picks. Its size never passes the cap by more than one quota."""

    def __init__(self, cap: int, seed: np.ndarray | None = None):
        self.cap, self.seed, self.evictions = cap, seed, 0
        self.pos, self.features = np.zeros(0, np.int64), None

    def held(self) -> np.ndarray | None:
        parts = [p for p in (self.seed, self.features) if p is not None and len(p)]
        return np.vstack(parts) if parts else None

    def take(self, pos: np.ndarray, x: np.ndarray) -> None:
        """Takes rows in this order, and evicts if need be; what stays keeps its order."""
        if len(pos):
            self.pos = np.concatenate((self.pos, pos))
            self.features = x if self.features is None else np.vstack((self.features, x))
        if len(self.pos) > self.cap:
            kept = np.sort(greedy(self.features, self.cap, self.seed, init="index:0").indices)
            self.pos, self.features = self.pos[kept], self.features[kept]
            self.evictions += 1

    def add(self, pos: np.ndarray, x: np.ndarray | None, n: int) -> Picks:
        """Takes the n farthest rows of a batch."""
        picked = greedy(x, n, self.held())
        if len(picked.indices):
            self.take(pos[picked.indices], x[picked.indices])
        return picked

    def final(self, n: int, **options) -> Picks:
        return greedy(self.features, n, self.seed, **{"init": "index:0", **options})

    def table(self, spark) -> DataFrame:
        """(place, pos, features) in order of picking."""
        rows = [(i, int(p), v.tolist()) for i, (p, v) in enumerate(zip(self.pos, self.features if len(self.pos) else (), strict=True))]
        return spark.createDataFrame(rows, "place long, pos long, features array<double>")


def pooled(cand: DataFrame, n_select: int, stream: Stream, seed: DataFrame | None = None, random_state: int = 0) -> tuple[Pool, list[tuple]]:
    """The pool of several batches of cand (pos from 0, features), and its picks: (pos, score, batch)."""
    spark = cand.sparkSession
    n = cand.count()
    batches, target = n_batches(n, stream.batch_size), stream.target(n_select, n)
    pool, log = Pool(stream.cap(n_select), seed_matrix(seed)), []
    parts = kept_by(cand.select("pos", "features", batch_of(F.col("pos"), stream.batch_size, n).alias("batch")), "batch")
    for b in range(batches):
        rows = parts.where(F.col("batch") == b).select("pos", "features")
        own = quota(b, batches, target)
        if stream.pool_stage == "random":
            got = sample(rows, own, F.col("pos"), random_state).orderBy("pos").collect()
            picked = [(r.pos, None, r.features) for r in got]
        else:
            picks = fps(rows, own, pool.held())
            got = picks.join(rows, "pos").orderBy("rank").collect()  # a quota of rows
            picked = [(r.pos, r.score, r.features) for r in got]
        if picked:
            pool.take(np.array([p[0] for p in picked], np.int64), as_matrix([p[2] for p in picked]))
        log += [(p[0], p[1], b) for p in picked]
    return pool, log


def pooled_fps(cand: DataFrame, n_select: int, stream: Stream, seed: DataFrame | None = None, *, final: bool = True, min_dist2: float | None = None, random_state: int = 0, init: str = "farthest_from_mean") -> DataFrame:
    """(rank, pos, score[, batch]): the final picks, or the pool's in order of picking. One batch alone gives the exact answer."""
    spark = cand.sparkSession
    if n_batches(cand.count(), stream.batch_size) <= 1:
        exact = fps(cand, n_select if final else stream.target(n_select, cand.count()), seed, init=init, min_dist2=min_dist2, random_state=random_state)
        return exact if final else exact.withColumn("batch", F.lit(0).cast("long"))
    pool, log = pooled(cand, n_select, stream, seed, random_state)
    if not final:
        return spark.createDataFrame([(i, *r) for i, r in enumerate(log)], f"{RESULT}, batch long")
    last = pool.final(n_select, min_dist2=min_dist2)
    return spark.createDataFrame([(i, int(pool.pos[j]), float(v) if np.isfinite(v) else None) for i, (j, v) in enumerate(zip(last.indices, last.scores, strict=True))], RESULT)


def select_streamed(cand: DataFrame, selection: Selection, stream: Stream, seed: DataFrame | None = None) -> DataFrame:
    """The selection by either method: from all candidates if they are one batch, else from the pool, started at its first row."""
    s = selection
    if n_batches(cand.count(), stream.batch_size) <= 1:
        return select_diverse(cand, s.n_select, seed, **s.options())
    pool, _ = pooled(cand, s.n_select, stream, seed, s.random_state)
    table = checkpointed(pool.table(cand.sparkSession))
    picked = select_diverse(table.select(F.col("place").alias("pos"), "features"), s.n_select, seed, **{**s.options(), "init": "index:0"})
    return picked.withColumnRenamed("pos", "place").join(table.select("place", "pos"), "place").drop("place")


def stream_fps(source: DataFrame, n_select: int, per_batch: int, checkpoint: str, *, cap: int | None = None, id_col: str = "pos") -> Pool:
    """Runs a streaming source (id_col, features) to its end, per_batch picks of each micro-batch. Unbounded input has no
    total, so the quota is fixed; the pool is cut back to its cap (20 times n_select, 20,000 at most).

    The picks of a micro-batch are those of all its rows, however they are partitioned; the driver gets per_batch rows.
    """
    pool = Pool(cap or Stream().cap(n_select))

    def batch(df: DataFrame, _: int) -> None:
        rows = checkpointed(df.select(F.col(id_col).cast("long").alias("pos"), F.col("features").cast("array<double>").alias("features")))
        got = fps(rows, per_batch, pool.held()).join(rows, "pos").orderBy("rank").collect()
        if got:
            pool.take(np.array([r.pos for r in got]), as_matrix([r.features for r in got]))

    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return pool
