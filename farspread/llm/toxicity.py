"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier over the words that a text has is trained with numpy from confirmed toxic texts and unlabelled ones.
The risk of unlabelled texts as negatives holds the toxic ones among them, a share that the class prior gives; that part
is taken off, and a mini-batch whose corrected negative risk falls under zero steps the other way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, checkpointed, record_batch, released, slices
from .common import WORD as _WORD

#: Confirmed and unlabelled texts that a fit takes at most: those with the smallest hashes of their ids.
SAMPLE_POSITIVE = 4_000
SAMPLE_UNLABELLED = 12_000
_EDGES = ".,;:!?\"'()[]{}<>*$%&#|-_"


def words_of(text: str | None) -> set[str]:
    """Distinct words, A-Z in lower case, without punctuation at their ends."""
    return {w.strip(_EDGES) for w in _WORD.findall(text.translate(ASCII_LOWER))} - {""} if text else set()


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], words: list[str], prior: float, *, rounds: int = 120, batches: int = 8, rate: float = 0.7, decay: float = 1e-5, seed: int = 7) -> dict[str, float]:
    """Word weights and the bias (under the empty word) from texts as lists of numbers of the words that they have."""
    if not positive or not unlabelled:
        return {"": -20.0}
    np_, nu = len(positive), len(unlabelled)

    def matrix(texts):
        out = np.zeros((len(texts), len(words) + 1), np.float32)
        out[:, -1] = 1
        for i, own in enumerate(texts):
            out[i, own] = 1
        return out

    xp, xu = matrix(positive), matrix(unlabelled)
    w = np.zeros(len(words) + 1)
    w[-1] = -2.0
    total = np.full_like(w, 1e-8)
    rng = np.random.default_rng(seed)
    loss = lambda z: np.logaddexp(0, -z)  # noqa: E731  of being on the wrong side of z > 0
    slope = lambda z: -1 / (1 + np.exp(np.clip(z, -30, 30)))
    for _ in range(rounds):
        for p, u in zip(np.array_split(rng.permutation(np_), batches), np.array_split(rng.permutation(nu), batches), strict=True):
            if not len(p) or not len(u):
                continue
            zp, zu = xp[p] @ w, xu[u] @ w
            negative = loss(-zu).mean() - prior * loss(-zp).mean()
            grad_negative = -xu[u].T @ slope(-zu) / len(u) + prior * (xp[p].T @ slope(-zp)) / len(p)
            if negative >= 0:
                grad = prior * (xp[p].T @ slope(zp)) / len(p) + grad_negative
            else:
                grad = -grad_negative
            grad = grad + decay * np.append(w[:-1], 0)
            total += grad**2
            w -= rate * grad / np.sqrt(total)
    # The bias goes where the corrected zero-one risk is least, in the middle of the gap between scores.
    zp, zu = np.sort(xp @ w), np.sort(xu @ w)
    edges = np.unique(np.concatenate((zp, zu)))
    edges = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else np.zeros(1)
    missed = np.searchsorted(zp, edges) / np_
    flagged = 1 - np.searchsorted(zu, edges) / nu
    risk = prior * missed + np.maximum(0, flagged - prior * (1 - missed))
    w[-1] -= edges[int(risk.argmin())]
    return {**dict(zip(words, w[:-1].tolist(), strict=True)), "": float(w[-1])}


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED, least: int = 5, size: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> dict[str, float]:
    """Word weights from confirmed toxic texts (label 1) and a sample of all other rows, whose labels aren't looked at.

    The class prior among the unlabelled is a parameter; without one it is the share of toxic labels. Null ids and labels
    that aren't 0 or 1 don't count. The vocabulary is the ``size`` words of at least ``least`` confirmed texts that are
    most over-represented there; the driver gets these and the numbers of those that each sampled text has. Without a confirmed text every score is near 0.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    if prior is None:
        r = marked.agg(F.sum("_y").alias("y"), F.count("*").alias("n")).first()
        prior = (r.y or 0) / r.n if r.n else 0.0
    prior = min(max(prior, 1e-3), 0.5)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    toxic = marked.where("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(positives).select("_id")
    one = lambda ids: base.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("text").alias("text")).select("text")  # noqa: E731  of rows that repeat an id
    p = one(toxic)  # at most `positives` rows
    others = base.select("_id").where("_id is not null").orderBy(F.xxhash64(F.lit("u"), "_id"), "_id").limit(unlabelled).distinct()
    u = one(others)  # at most `unlabelled` rows

    schema = pa.schema([("words", pa.list_(pa.string()))])

    def split(batches):
        for batch in slices(batches):
            yield record_batch(schema, [sorted(words_of(t)) for t in batch.column(0).to_pylist()])

    p, u = (checkpointed(df.mapInArrow(split, "words array<string>")) for df in (p, u))
    n_p, n_u = p.count(), u.count()
    if not n_p or not n_u:
        return fit_nnpu([], [], [], prior)
    # The words that the two samples differ in most, in standard errors of the difference.
    count = lambda df, name: df.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias(name))
    both = count(p, "a").where(F.col("a") >= min(least, max(1, n_p // 50))).join(count(u, "b"), "word", "left").fillna(0, ["b"])
    share = (F.col("a") + F.col("b") + 1) / (n_p + n_u + 2)
    excess = ((F.col("a") + 0.5) / (n_p + 1) - (F.col("b") + 0.5) / (n_u + 1)) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    words = [r.word for r in both.withColumn("x", excess).where("x > 4").orderBy(F.desc("x"), "word").limit(size).collect()]
    known = {w: i for i, w in enumerate(words)}
    numbers = pa.schema([("own", pa.list_(pa.int32()))])

    def number(batches):
        for batch in batches:
            yield record_batch(numbers, [[known[w] for w in ws if w in known] for ws in batch.column(0).to_pylist()])

    xp, xu = ([list(r.own) for r in df.mapInArrow(number, "own array<int>").collect()] for df in (p, u))
    return fit_nnpu(sorted(xp), sorted(xu), words, prior, **options)


def score_toxicity(docs: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs, score from 0 to 1.

    A null or empty text has no word and scores as the bias alone; of a long one the distinct words are held at once. A null id is kept as null, repeated rows are all
    returned. Other columns of docs are not read, whatever their names. An empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    known = {k: v for k, v in weights.items() if k}
    bias = weights[""]

    def run(batches):
        for batch in slices(batches):
            z = [bias + sum(known[w] for w in sorted(words_of(t) & known.keys())) for t in batch.column(1).to_pylist()]
            yield record_batch(schema, batch.column(0), 1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50))))

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(released(run), "doc_id long, score double")
