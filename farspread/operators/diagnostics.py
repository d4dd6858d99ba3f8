"""Diagnostics: histograms, cumulative curves, rank correlation, principal components, classical scaling, neighbourhoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import checkpointed
from .fps import fps
from .nearest import column_means, distances_from, min_squared_distance, rows_of, sample_matrix
from .ordering import sample


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """(bin, n) of equal widths between the least and the greatest value, which is in the last bin."""
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if r.lo is None:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    at = F.lit(0).cast("long") if r.hi == r.lo else F.least(F.floor((F.col(column) - r.lo) / (r.hi - r.lo) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def _running(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """counts (one row a value) with before, the sum of n over smaller values: per range of values first, then within it."""
    parts = checkpointed(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(n).alias("_n"))
    earlier = Window.partitionBy(F.lit(0).alias("_all")).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = F.sum(n).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(base), "_part").withColumn("before", F.col("_base") + F.col("_within")).drop("_part", "_within", "_base")


def cumulative(df: DataFrame, column: str) -> DataFrame:
    """(value, share): the empirical distribution, from counts of equal values."""
    counts = checkpointed(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return _running(counts, "value").select("value", ((F.col("before") + F.col("n")) / F.lit(total)).alias("share"))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row, rho: the correlation of average ranks, which are found for each distinct value. Rows with a null don't count."""
    pairs = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    for c in ("a", "b"):
        counts = pairs.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("n"))
        ranks = _running(counts, "_v").select("_v", (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))
        pairs = pairs.join(ranks, F.col(c) == F.col("_v")).drop("_v")
    return pairs.agg(F.corr("ra", "rb").alias("rho"))


def covariance(df: DataFrame) -> np.ndarray:
    """The population covariance: partial sums per task, rows of it added up as arrays, then d rows of d on the driver."""
    mean = np.array(column_means(df))
    shared = df.sparkSession.sparkContext.broadcast(mean)
    schema = "i long, n long, row array<double>"

    def part(batches):
        total, n = np.zeros((len(mean), len(mean))), 0
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch) - shared.value
                total += x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean))), pa.array(np.full(len(mean), n)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "n", "row"])

    def added(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i, n, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(i, [0, 0.0])
                own[0], own[1] = own[0] + n, own[1] + np.array(row)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([*held]), pa.array([h[0] for h in held.values()]), pa.array([h[1].tolist() for h in held.values()], pa.list_(pa.float64()))], names=["i", "n", "row"])

    parts = df.select(F.col("features").cast("array<double>").alias("features")).mapInArrow(part, schema)
    out = np.zeros((len(mean), len(mean)))
    for r in parts.repartition("i").mapInArrow(added, schema).collect():
        out[r.i] = np.array(r.row) / r.n
    return out


def pca(df: DataFrame, k: int = 2) -> tuple[DataFrame, np.ndarray]:
    """df with coords array<double>, and the share of variance of every component. A component's largest loading is positive."""
    values, vectors = np.linalg.eigh(covariance(df))
    order = np.argsort(-values)
    ratio = np.maximum(values[order], 0) / max(values.clip(0).sum(), 1e-300)
    v = vectors[:, order[:k]]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    mean = column_means(df)
    coords = [F.aggregate(F.zip_with(F.zip_with("features", F.array(*map(F.lit, mean)), lambda x, m: x - m), F.array(*[F.lit(float(w)) for w in v[:, j]]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for j in range(v.shape[1])]
    return df.withColumn("coords", F.array(*coords)), ratio


def classical_mds(x: np.ndarray, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and shares of variance of a bounded sample, by double centring."""
    d2 = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T, 0)
    j = np.eye(len(x)) - 1 / max(len(x), 1)
    values, vectors = np.linalg.eigh(-0.5 * j @ d2 @ j)
    order = np.argsort(-values)[:k]
    top = np.maximum(values[order], 0)
    v = vectors[:, order] * np.sqrt(top)
    return v, top / max(np.maximum(values, 0).sum(), 1e-300)


def smacof(x: np.ndarray, k: int = 2, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Metric scaling of a bounded sample by majorisation, from the classical solution."""
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T, 0))
    y, last = classical_mds(x, k)[0], np.inf
    for _ in range(rounds):
        e = np.sqrt(np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * y @ y.T, 0))
        stress = ((d - e) ** 2).sum() / 2
        if last - stress <= tolerance * max(stress, 1e-12):
            break
        last = stress
        b = -np.divide(d, e, out=np.zeros_like(d), where=e > 1e-12)
        b[np.diag_indices_from(b)] = -(b.sum(1) - np.diag(b))
        y = b @ y / len(x)
    return y


def tsne(x: np.ndarray, k: int = 2, perplexity: float | None = None, rounds: int = 500, seed: int = 0) -> np.ndarray:
    """t-SNE of a bounded sample: at most 50 principal components, exact gradients, started from the first components."""
    n = len(x)
    centred = x - x.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    x = (u * s)[:, :50]
    perplexity = min(perplexity or float(np.clip(n / 100, 5, 50)), max(1.0, (n - 1) / 3))
    d2 = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T, 0)
    p = np.zeros((n, n))
    for i in range(n):
        others = np.delete(d2[i], i)
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            w = np.exp(-(others - others.min()) * beta)
            q = w / w.sum()
            entropy = -(q * np.log(np.maximum(q, 1e-300))).sum()
            if abs(entropy - np.log(perplexity)) < 1e-5:
                break
            lo, hi = (beta, hi) if entropy > np.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = x[:, :k] / max(x[:, 0].std(), 1e-12) * 1e-4
    y = y + np.random.default_rng(seed).normal(0, 1e-6, y.shape)
    step, gain = np.zeros_like(y), np.ones_like(y)
    for t in range(rounds):
        more = 12.0 if t < 250 else 1.0
        w = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * y @ y.T, 0))
        np.fill_diagonal(w, 0)
        g = (more * p - w / w.sum()) * w
        grad = 4 * (g.sum(1)[:, None] * y - g @ y)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if t < 250 else 0.8) * step - max(n / 12, 10) * gain * grad
        y = y + step
        y = y - y.mean(0)
    return y


def embed(x: np.ndarray, method: str = "pca", k: int = 2, *, metric: bool = True, **options) -> tuple[np.ndarray, str]:
    """Coordinates and a caption for a bounded sample."""
    if method == "pca":
        centred = x - x.mean(0)
        u, s, _ = np.linalg.svd(centred, full_matrices=False)
        ratio = s**2 / max((s**2).sum(), 1e-300)
        return (u * s)[:, :k], "PCA, " + " + ".join(f"{100 * r:.1f}%" for r in ratio[:k])
    if method == "mds":
        return (smacof(x, k), "metric MDS") if metric else (classical_mds(x, k)[0], "classical MDS")
    if method == "tsne":
        return tsne(x, k, **options), "t-SNE"
    raise ValueError(f"unknown embedding {method!r}: pca, mds or tsne")


def _excess(d: np.ndarray, e: np.ndarray, own: np.ndarray, k: int) -> int:
    """Of rows' distances before (d) and after (e), how far beyond k the ranks of the k nearest after lie before; ties by place."""
    line = np.arange(len(own))
    for m in (d, e):
        m[line, own] = np.inf
    rank = np.empty(d.shape, np.int64)
    rank[line[:, None], np.argsort(d, axis=1, kind="stable")] = np.arange(1, d.shape[1] + 1)
    near = np.argsort(e, axis=1, kind="stable")[:, :k]
    return int(np.maximum(rank[line[:, None], near] - k, 0).sum())


def trustworthiness(sample: DataFrame, k: int, key: str = "pos") -> DataFrame:
    """One row, trust, of a bounded sample (key, features, coords): how far the k nearest in coords are so in features.

    The sample goes to every task; each ranks the neighbours of its rows and gives one sum.
    """
    spark = sample.sparkSession
    keys, x = sample_matrix(sample, key=key)
    shared = spark.sparkContext.broadcast((keys, x, sample_matrix(sample, "coords", key)[1]))

    def part(batches):
        keys, x, y = shared.value
        for batch in batches:
            own = np.searchsorted(keys, batch.column(0).to_numpy())
            total = 0
            for (a, b, d), (_, _, e) in zip(distances_from(x[own], x), distances_from(y[own], y), strict=True):
                total += _excess(d, e, own[a:b], k)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["excess"])

    rows = sample.select(key).repartition(spark.sparkContext.defaultParallelism)
    n = len(keys)
    trust = 1 - 2 * F.sum("excess") / (n * k * (2 * n - 3 * k - 1))
    return rows.mapInArrow(part, "excess long").agg(trust.alias("trust"))


def faithfulness(x: np.ndarray, y: np.ndarray, *, max_points: int = 1000, k: int = 12, seed: int = 0) -> dict:
    """How far an embedding y of x distorts distances: n_points, spearman of pair distances, trustworthiness and its k.

    At most max_points rows, drawn by the seed, are compared.
    """
    own = np.sort(np.random.default_rng(seed).permutation(len(x))[:max_points])
    x, y = np.asarray(x, float)[own], np.asarray(y, float)[own]
    n = len(x)
    k = min(k, max(1, (n - 1) // 2))
    if n < 3:
        return {"n_points": n, "spearman": float("nan"), "trustworthiness": float("nan"), "k": k}
    d, e = (np.vstack([m for _, _, m in distances_from(v, v)]) for v in (x, y))
    upper = np.triu_indices(n, 1)

    def ranks(v):
        _, at, many = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(many) - (many - 1) / 2)[at]

    a, b = ranks(d[upper]), ranks(e[upper])
    rho = float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else float("nan")
    scale = n * k * (2 * n - 3 * k - 1)
    return {"n_points": n, "spearman": rho, "trustworthiness": 1 - 2 * _excess(d, e, np.arange(n), k) / scale if scale > 0 else float("nan"), "k": k}


def figure_data(rows: DataFrame, chosen: DataFrame, *, max_points: int = 2000, seed: int = 0, bins: int = 60) -> DataFrame:
    """(panel, series, x, y) of a run's diagnostics, from rows (pos, features) and the chosen rows' (rank, pos).

    'distances': a histogram of pair distances of a sample; 'scree': shares of variance of up to 20 components and their
    running sum; 'coverage': the distance of each pick from those before it; 'cdf': for the chosen rows and for as many
    random ones, the share of rows within a distance of the nearest.
    """
    spark = rows.sparkSession
    rows = checkpointed(rows.select("pos", F.col("features").cast("array<double>").alias("features")))
    out: list[tuple] = []
    _, x = sample_matrix(sample(rows, max_points, F.col("pos"), seed))
    if len(x) > 1:
        d = np.concatenate([m[np.arange(a, b)[:, None] < np.arange(len(x))[None, :]] for a, b, m in distances_from(x, x)])
        n, edges = np.histogram(d, bins)
        out += [("distances", "count", float((edges[i] + edges[i + 1]) / 2), float(n[i])) for i in range(bins)]
        _, ratio = pca(rows, 1)
        shares = ratio[:20]
        out += [("scree", s, float(i + 1), float(v)) for s, v_all in (("share", shares), ("running", np.cumsum(shares))) for i, v in enumerate(v_all)]
    picked = checkpointed(rows.join(chosen.select("pos", "rank"), "pos"))
    k = picked.count()
    if k:
        profile = fps(picked.select(F.col("rank").alias("pos"), "features"), k)
        out += [("coverage", "chosen", float(r["rank"] + 1), float(r.score) ** 0.5) for r in profile.where("score is not null").select("rank", "score").collect()]
    made = spark.createDataFrame(out, "panel string, series string, x double, y double")
    for name, of in (("chosen", picked), ("random", sample(rows, k, F.col("pos"), seed + 1))) if k else ():
        d = min_squared_distance(rows, of.select("features")).select(F.sqrt("d2").alias("d"))
        made = made.unionByName(cumulative(d, "d").select(F.lit("cdf").alias("panel"), F.lit(name).alias("series"), F.col("value").alias("x"), F.col("share").alias("y")))
    return made
