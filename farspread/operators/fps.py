"""Farthest-point sampling: greedy, seeded by vectors already held, ties to the lowest position.

Two strategies give the same picks. While the candidates' matrix fits a checked budget, one Arrow group runs the greedy
loop. Beyond it the candidates stay distributed. A pass over them brings each row's least squared distance up to date
with the picks so far and fetches the farthest FETCHED rows. The driver goes on picking among these as long as the next
pick is provably the farthest of all: least distances only fall, so no row that wasn't fetched is beyond the last that
was. So a pass gives many picks, and every pass is checkpointed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import parse_init
from ..functions.vectors import is_finite, squared_distance
from .checkpoints import checkpointed

#: Bytes of float64 features that one group may hold.
ONE_GROUP_BYTES = 512 << 20
#: Rows of a pass that come to the driver.
FETCHED = 512


@dataclass
class Picks:
    """Positions in pick order, scores (least squared distance when picked; inf without a predecessor), and why it ended early."""

    indices: np.ndarray
    scores: np.ndarray
    reason: str | None
    aux: dict = field(default_factory=dict)


def as_matrix(x, name: str = "features") -> np.ndarray | None:
    if x is None or len(x) == 0:
        return None
    x = np.asarray(x, np.float64)
    if x.ndim != 2:
        raise ValueError(f"{name} must be two-dimensional")
    if not np.isfinite(x).all():
        raise ValueError(f"{name} hold NaN or infinite values")
    return x


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances to one vector, summed in the order of the dimensions."""
    return ((x - y) ** 2).sum(1)


def least_squared_distances(x: np.ndarray, s: np.ndarray | None, chunk: int = 256) -> np.ndarray:
    """Of each row the squared distance to the nearest of s, block by block; inf without any.

    The nearest of a block is found by products and its distance by differences, so that a row of s itself has 0.
    """
    out = np.full(len(x), np.inf)
    for i in range(0, 0 if s is None else len(s), chunk):
        part = s[i : i + chunk]
        d = (x**2).sum(1)[:, None] + (part**2).sum(1)[None, :] - 2 * x @ part.T
        np.minimum(out, ((x - part[d.argmin(1)]) ** 2).sum(1), out=out)
    return out


def greedy(x: np.ndarray | None, n: int, seed: np.ndarray | None = None, *, init: str = "farthest_from_mean", random_state: int = 0, min_dist2: float | None = None, allow_zero: bool = False) -> Picks:
    """At most n positions of x. The first pick is tested against neither min_dist2 nor zero."""
    size = 0 if x is None else len(x)
    k = min(n, size)
    if k <= 0:
        return Picks(np.zeros(0, np.int64), np.zeros(0), "exhausted" if n > 0 else None)
    least = np.full(size, np.inf)
    if seed is not None and len(seed):
        least = least_squared_distances(x, seed)
        at, rule = int(least.argmax()), "seeded"
    else:
        kind, number = parse_init(init)
        if kind == "index":
            at, rule = number % size, f"index:{number % size}"
        elif kind == "random":
            at, rule = int(np.random.default_rng(random_state).integers(size)), "random"
        else:
            at, rule = int(squared_distances(x, x.mean(0)).argmax()), "farthest_from_mean"
    open_ = np.ones(size, bool)
    picks: list[int] = []
    scores: list[float] = []
    reason = None
    while True:
        picks.append(at)
        scores.append(float(least[at]))
        open_[at] = False
        if len(picks) == k:
            break
        np.minimum(least, squared_distances(x, x[at]), out=least)
        at = int(np.where(open_, least, -np.inf).argmax())
        if min_dist2 is not None and least[at] < min_dist2:
            reason = "min_dist_stop"
            break
        if not allow_zero and least[at] <= 0:
            reason = "exhausted"
            break
    if reason is None and len(picks) < n:
        reason = "exhausted"
    return Picks(np.array(picks, np.int64), np.array(scores), reason, {"start_index": picks[0], "start_rule": rule})


def coverage_profile(x: np.ndarray | None, seed: np.ndarray | None = None) -> np.ndarray:
    """Scores of the greedy order over a set that is already chosen."""
    return greedy(x, 0 if x is None else len(x), seed).scores


def seed_matrix(seed: DataFrame | np.ndarray | None) -> np.ndarray | None:
    """A bounded seed set on the driver; sets beyond the budget are folded in by nearest.min_squared_distance instead."""
    if seed is None or isinstance(seed, np.ndarray):
        return as_matrix(seed, "seed")
    return as_matrix([r.features for r in seed.select("features").collect()], "seed")


def start_position(init: str, size: int, random_state: int) -> int | None:
    """The place, by position, of a cold start's first pick among size rows; None for the one farthest from the mean."""
    kind, number = parse_init(init)
    if kind == "index":
        return number % size
    return int(np.random.default_rng(random_state).integers(size)) if kind == "random" else None


def fps(cand: DataFrame, n: int, seed: DataFrame | np.ndarray | None = None, *, init: str = "farthest_from_mean", random_state: int = 0, min_dist2: float | None = None, allow_zero: bool = False, budget: int = ONE_GROUP_BYTES) -> DataFrame:
    """(rank, pos, score) of picks from cand (pos long, features array<double>); score is null without a predecessor.

    ``seed`` has a features column, or is a matrix. A wrong width or a value that isn't finite is an error. ``index:J`` and
    ``random`` count rows by pos. The picks don't depend on the strategy that the budget decides.
    """
    bad = F.max(F.when(is_finite(F.col("features")), 0).otherwise(1))
    shape = cand.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("most"), F.min(F.size("features")).alias("least"), bad.alias("bad")).first()
    if shape.n and shape.most != shape.least:
        raise ValueError(f"features have {shape.least} to {shape.most} numbers")
    if shape.bad:
        raise ValueError("features hold NaN or infinite values")
    rows = 0 if seed is None else len(seed) if isinstance(seed, np.ndarray) else seed.count()
    width = shape.most or 1
    small_seed = rows * width * 8 <= budget or isinstance(seed, np.ndarray)
    x_seed = seed_matrix(seed) if rows and small_seed else None
    if x_seed is not None and shape.n and x_seed.shape[1] != shape.most:
        raise ValueError(f"seed features have {x_seed.shape[1]} numbers, candidates {shape.most}")
    if shape.n * width * 8 <= budget and (small_seed or not rows):

        def group(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos", kind="stable")
            x = as_matrix(np.vstack(pdf["features"].to_numpy())) if len(pdf) else None
            p = greedy(x, n, x_seed, init=init, random_state=random_state, min_dist2=min_dist2, allow_zero=allow_zero)
            score = pd.Series(p.scores).where(np.isfinite(p.scores), None)
            return pd.DataFrame({"rank": np.arange(len(p.indices)), "pos": pdf["pos"].to_numpy()[p.indices], "score": score.astype(object)})

        return cand.select("pos", "features").withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda pdf: group(pdf), "rank long, pos long, score double")
    return _fps_passes(cand, n, (x_seed if x_seed is not None else seed) if rows else None, shape.n, init=init, random_state=random_state, min_dist2=min_dist2, allow_zero=allow_zero)


def _nearer(state: DataFrame, picks: np.ndarray, gone: list[int]) -> DataFrame:
    """state with the least squared distance brought up to date; rows that were picked leave."""
    shared = state.sparkSession.sparkContext.broadcast((picks, np.array(gone, np.int64)))

    def run(batches):
        picks, gone = shared.value
        for batch in batches:
            pos = batch.column("pos").to_numpy()
            batch = batch.filter(pa.array(~np.isin(pos, gone)))
            if not batch.num_rows:
                continue
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            least = batch.column("least").to_numpy().copy()
            for v in picks:  # summed as in the one group
                np.minimum(least, squared_distances(x, v), out=least)
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("features"), pa.array(least)], names=["pos", "features", "least"])

    return state.mapInArrow(run, "pos long, features array<double>, least double")


def _fps_passes(cand: DataFrame, n: int, seed, size: int, *, init: str, random_state: int, min_dist2: float | None, allow_zero: bool) -> DataFrame:
    from .nearest import column_means, min_squared_distance
    from .ordering import with_position

    spark = cand.sparkSession
    schema = "rank long, pos long, score double"
    k = min(n, size)
    if k <= 0:
        return spark.createDataFrame([], schema)
    plain = cand.select(F.col("pos").cast("long").alias("pos"), F.col("features").cast("array<double>").alias("features"))
    out: list[tuple] = []
    if seed is None:
        at = start_position(init, size, random_state)
        if at is None:
            mean = F.array(*[F.lit(float(m)) for m in column_means(plain)])
            far = plain.withColumn("d", squared_distance(F.col("features"), mean))
            first = far.agg(F.max_by(F.struct("pos", "features"), F.struct("d", -F.col("pos"))).alias("b")).first().b
        else:
            first = with_position(plain, "pos", name="place").where(F.col("place") == at).first()
        out.append((0, first.pos, None))
        state = plain.withColumn("least", F.lit(float("inf")))
        picks, gone = np.array([first.features], float), [first.pos]
    else:
        held = seed if not isinstance(seed, np.ndarray) else spark.createDataFrame([(v.tolist(),) for v in seed], "features array<double>")
        state = min_squared_distance(plain, held).withColumnRenamed("d2", "least")
        picks, gone = np.zeros((0, 0)), []
    done = len(out) >= k
    while not done:
        state = checkpointed(_nearer(state, picks, gone))
        top = state.orderBy(F.desc("least"), "pos").limit(FETCHED).collect()
        if not top:
            break
        pos, least = np.array([r.pos for r in top]), np.array([r.least for r in top])
        x = np.array([r.features for r in top], float)
        last = (least[-1], pos[-1]) if len(top) == FETCHED else (-1.0, 0)
        open_, picks, gone = np.ones(len(top), bool), [], []
        while True:
            if not open_.any():
                break
            tied = np.flatnonzero(open_ & (least == least[open_].max()))
            at = int(tied[pos[tied].argmin()])
            if least[at] < last[0] or (least[at] == last[0] and pos[at] > last[1]):
                break  # a row that wasn't fetched may be farther, or come first
            if out and ((min_dist2 is not None and least[at] < min_dist2) or (not allow_zero and least[at] <= 0)):
                done = True
                break
            out.append((len(out), int(pos[at]), float(least[at])))
            picks.append(x[at])
            gone.append(int(pos[at]))
            open_[at] = False
            if len(out) >= k:
                done = True
                break
            np.minimum(least, squared_distances(x, x[at]), out=least)
        picks = np.array(picks, float)
    return spark.createDataFrame(out, schema)
