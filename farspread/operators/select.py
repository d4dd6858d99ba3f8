"""Diversity selection: one call for both methods, with the reason of a short result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clusters
from .checkpoints import checkpointed
from .fps import as_matrix, fps
from .ordering import sample

RESULT = "rank long, pos long, pick_stage string, cluster long, score double, center_d2 double"


def select_diverse(cand: DataFrame, n_select: int, seed: DataFrame | None = None, *, method: str = "kmeans", min_dist2: float | None = None, init: str = "farthest_from_mean", k: int | None = None, per_cluster: int = 1, second_pick: str = "farthest", fill: str = "fps", trim: str = "population", rounds: int = 300, random_state: int = 0, n_init: int = 10, minibatch_threshold: int = 20_000) -> DataFrame:
    """(rank, pos, pick_stage, cluster, score, center_d2) of at most n_select rows of cand (pos, features).

    Rows whose pos is a seed's are never candidates. For k-means ``score`` is the coverage profile of the chosen set by
    rank (not a property of the row), as downstream curves expect; ``center_d2`` is the row's own. A score without a
    predecessor is null, a cluster of -1 says that the row topped the clusters up. k-means starts from the farthest points
    and from ``n_init`` - 1 random sets of rows, three starts in all beyond ``minibatch_threshold`` rows; the best fit counts.
    """
    spark = cand.sparkSession
    if seed is not None and "pos" in seed.columns:
        cand = cand.join(seed.select("pos"), "pos", "left_anti")
    if method == "fps":
        picked = fps(cand, n_select, seed, init=init, min_dist2=min_dist2, random_state=random_state)
        return picked.select("rank", "pos", F.lit("fps").alias("pick_stage"), F.lit(-1).cast("long").alias("cluster"), "score", F.lit(None).cast("double").alias("center_d2"))
    if method != "kmeans":
        raise ValueError(f"unknown method {method!r}: kmeans or fps")
    n = cand.count()
    if not n or n_select <= 0:
        return spark.createDataFrame([], RESULT)
    k = max(1, min(k or n_select, n))
    both = cand.select("pos", "features", F.lit(False).alias("is_seed"))
    if seed is not None:
        both = both.unionByName(seed.select((-F.monotonically_increasing_id() - 1).alias("pos"), "features", F.lit(True).alias("is_seed")))
    both = checkpointed(both)
    many = n_init if n + (0 if seed is None else seed.count()) <= minibatch_threshold else min(n_init, 3)
    first = fps(both, k, allow_zero=True).join(both, "pos").select(F.lit(0).alias("start"), F.col("rank").alias("at"), "features")
    for i in range(1, many):
        first = first.unionByName(sample(both, k, F.col("pos"), random_state + i).select(F.lit(i).alias("start"), F.col("pos").alias("at"), "features"))
    rows = first.orderBy("start", "at").collect()  # k rows a start
    starts = [as_matrix([r.features for r in rows if r.start == i]) for i in range(many)]
    _, assigned = clusters.lloyd(both, starts, rounds)
    assigned = checkpointed(assigned)
    reps = checkpointed(clusters.representatives(clusters.uncovered(assigned), per_cluster, second_pick))
    count = reps.count()
    if count > n_select:
        if trim == "population":
            reps = clusters.trim_by_population(reps, n_select)
        else:
            reps = reps.join(fps(reps.select("pos", "features"), n_select, seed).select("pos"), "pos")
    order = Window.partitionBy(F.lit(0).alias("_all")).orderBy("stage", "cluster_order", "slot")
    chosen = reps.select("pos", "features", F.lit("kmeans").alias("pick_stage"), F.lit(0).alias("stage"), F.col("cluster").alias("cluster_order"), "slot", "cluster", "center_d2")
    chosen = checkpointed(chosen)
    if count < n_select and fill == "fps":
        held = chosen.select("features") if seed is None else chosen.select("features").unionByName(seed.select("features"))
        rest = cand.join(chosen.select("pos"), "pos", "left_anti")
        more = fps(rest, n_select - count, held if held.count() else None, min_dist2=min_dist2)
        more = more.join(cand.select("pos", "features"), "pos").select("pos", "features", F.lit("fps_topup").alias("pick_stage"), F.lit(1).alias("stage"), F.col("rank").alias("cluster_order"), F.lit(0).cast("long").alias("slot"), F.lit(-1).cast("long").alias("cluster"), F.lit(None).cast("double").alias("center_d2"))
        chosen = checkpointed(chosen.unionByName(more))
    ranked = chosen.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    profile = fps(ranked.select(F.col("rank").alias("pos"), "features"), n_select).select("rank", "score")
    return ranked.join(profile, "rank", "left").select("rank", "pos", "pick_stage", "cluster", "score", "center_d2")


def shortfall(found: int, n_select: int, n_candidates: int, *, fill: str = "fps", method: str = "fps", min_dist2: float | None = None) -> str | None:
    """Why a selection is short, if it is: no candidate was left, clusters weren't topped up, or those left were too near."""
    if found >= n_select:
        return None
    if found >= n_candidates:
        return "exhausted"
    if method == "kmeans" and fill == "none":
        return "strict_no_fill"
    return "min_dist_stop" if min_dist2 is not None else "exhausted"


def finite_range(scores) -> tuple[float, float]:
    """Least and greatest finite score; NaN without any."""
    s = np.asarray([x for x in scores if x is not None and np.isfinite(x)], float)
    return (float(s.min()), float(s.max())) if len(s) else (float("nan"), float("nan"))
