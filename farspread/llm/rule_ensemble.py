"""Quality classifier: a sparse ensemble of rules (RuleFit; Friedman and Popescu, 2008).

Statistics of a text are Spark column expressions. Small gradient-boosted trees are grown with numpy on a bounded sample
of labelled rows, every path to a node becomes a conjunctive rule, a lasso logistic regression weighs the rules, and
those with a weight are compiled back into one Spark column expression that scores every row in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit takes at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text that hold no identity of it; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    n = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "chars": F.length(text).cast("double"),
        "words": F.size(words).cast("double"),
        "distinct": F.size(F.array_distinct(words)).cast("double"),
        "lines": n("\n"),
        "upper": n(r"\p{Lu}"),
        "digits": n("[0-9]"),
        "symbols": n(r"[#*$%&<>@_=+^~{}\[\]\\/]"),
        "pipes": n(r"\|"),
        "marks": n("[!?]"),
        "stops": n(r"[.,;:]"),
    }


def features(raw: dict[str, Column]) -> dict[str, Column]:
    """Ratios of the statistics; 0 where a text has nothing to divide by."""
    per = lambda a, b: raw[a] / F.greatest(raw[b], F.lit(1.0))
    return {
        "words": raw["words"],
        "word_length": (raw["chars"] - raw["words"]) / F.greatest(raw["words"], F.lit(1.0)),
        "distinct_share": per("distinct", "words"),
        "words_a_line": raw["words"] / (raw["lines"] + 1),
        "upper_share": per("upper", "chars"),
        "digit_share": per("digits", "chars"),
        "symbols_a_word": per("symbols", "words"),
        "pipes_a_word": per("pipes", "words"),
        "marks_a_word": per("marks", "words"),
        "stops_a_word": per("stops", "words"),
    }


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "_f_") -> DataFrame:
    raw = docs.withColumns({f"_s_{k}": c for k, c in statistics(F.col(f"`{text_col}`").cast("string")).items()})
    names = {k: F.col(f"_s_{k}") for k in statistics(F.lit(""))}
    return raw.withColumns({prefix + k: c for k, c in features(names).items()}).drop(*[f"_s_{k}" for k in names])


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (feature, is above, threshold) with weights, and an intercept: the log odds are their sum."""

    conjunctions: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, column=lambda f: F.col(f"_f_{f}")) -> Column:
        """The probability of label 1 as a Spark column expression."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.conjunctions, self.weights, strict=True):
            test = F.lit(True)
            for feature, above, threshold in rule:
                test = test & (column(feature) > threshold if above else column(feature) <= threshold)
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score_rows(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        """The same for a numpy matrix of features."""
        z = np.full(len(x), self.intercept)
        for rule, weight in zip(self.conjunctions, self.weights, strict=True):
            z += weight * _holds(rule, x, names)
        return 1 / (1 + np.exp(-z))


def _holds(rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, above, threshold in rule:
        v = x[:, names.index(feature)]
        out &= v > threshold if above else v <= threshold
    return out


def _grow(x, residual, curvature, names, depth, least, cuts):
    """Paths of one regression tree with the Newton step of each leaf."""
    paths: list[tuple] = []
    step = np.zeros(len(x))

    def split(rows, path):
        if path:
            paths.append(path)
        g, h = residual[rows].sum(), curvature[rows].sum()
        step[rows] = g / (h + 1.0)
        if len(path) >= depth or len(rows) < 2 * least:
            return
        best = (1e-6, None)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            bucket = np.searchsorted(edges, x[rows, f], side="left")
            n = np.bincount(bucket, minlength=len(edges) + 1).cumsum()[:-1]
            gs = np.bincount(bucket, residual[rows], len(edges) + 1).cumsum()[:-1]
            hs = np.bincount(bucket, curvature[rows], len(edges) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
            gain[(n < least) | (len(rows) - n < least)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), (f, edges[int(gain.argmax())]))
        if best[1] is None:
            return
        f, edge = best[1]
        low = x[rows, f] <= edge
        split(rows[low], (*path, (names[f], False, float(edge))))
        split(rows[~low], (*path, (names[f], True, float(edge))))

    split(np.arange(len(x)), ())
    return paths, step


def _lasso(a: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient; the intercept isn't penalised."""
    n, k = a.shape
    a1 = np.column_stack([a, np.ones(n)])
    lip = 0.25 * np.linalg.norm(a1, 2) ** 2 / n
    w = np.zeros(k + 1)
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        grad = a1.T @ (1 / (1 + np.exp(-np.clip(a1 @ v, -30, 30))) - y) / n
        new = v - grad / lip
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - strength / lip, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w, t = new, t2
    return w[:k], float(w[k])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 24, depth: int = 3, rate: float = 0.3, strength: float = 1e-3, least: int = 10) -> Rules:
    """Rules from rows of features x and labels y (0 or 1). With no row, or one label only, there is no rule."""
    if not len(y) or y.min() == y.max():
        p = (float(y.sum()) + 0.5) / (len(y) + 1)
        return Rules((), (), float(np.log(p / (1 - p))))
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[:-1])) for f in range(x.shape[1])]
    rules: dict[tuple, np.ndarray] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        paths, step = _grow(x, y - p, p * (1 - p), names, depth, least, cuts)
        for path in paths:
            rules.setdefault(tuple(sorted(path)), None)
        z = z + rate * step
    columns: dict[bytes, tuple] = {}
    for rule in rules:
        held = _holds(rule, x, names)
        columns.setdefault(np.packbits(held).tobytes(), rule)
    kept = list(columns.values())
    if not kept:  # too few rows to split
        return Rules((), (), float(np.log(y.mean() / (1 - y.mean()))))
    a = np.column_stack([_holds(r, x, names) for r in kept]).astype(float)
    scale = np.maximum(a.std(0), 0.02)
    w, intercept = _lasso((a - a.mean(0)) / scale, y, strength)
    chosen = np.flatnonzero(np.abs(w) > 1e-6)
    intercept -= float((w / scale * a.mean(0)).sum())
    return Rules(tuple(kept[i] for i in chosen), tuple(float(w[i] / scale[i]) for i in chosen), intercept)


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Rules:
    """Rules for label_col, from the labelled rows whose ids have the smallest hashes, at most ``sample`` of them.

    Labels that are null, not 0 or 1, or of a null id don't count; of an id with both labels the smaller counts. Of
    rows that repeat an id one text counts.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    found = with_features(base.join(F.broadcast(marked), "_id")).drop("text")
    names = list(features({k: F.lit(0.0) for k in statistics(F.lit(""))}))
    one = F.min(F.struct("_y", *[f"_f_{f}" for f in names])).alias("r")  # of rows that repeat an id
    rows = {r._id: r for r in found.groupBy("_id").agg(one).select("_id", "r.*").orderBy("_id").collect()}  # at most `sample` rows
    x = np.array([[r[f"_f_{f}"] for f in names] for r in rows.values()], float).reshape(len(rows), len(names))
    return fit_rules(x, np.array([r._y for r in rows.values()], float), names, **options)


def score_quality(docs: DataFrame, rules: Rules, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of every row; a null text scores as an empty one.

    All columns are kept, one named like ``score_col`` is replaced. A null id or one that repeats makes no difference. A text
    of any length is scored as a whole, in the JVM. An empty table gives an empty result.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    scored = with_features(held, "_text").withColumn("_score", rules.score())
    return scored.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != score_col], F.col("_score").alias(score_col))
