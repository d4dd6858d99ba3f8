"""Mixing sources to target weights by iterative proportional fitting (raking), with DataFrame functions only.

Tokens are first added up by cell (a combination of the categories), so the raking works on a table whose size doesn't
depend on the number of documents. One round scales the cells to each marginal in turn. A cell's fitted tokens over its
tokens, scaled so that no probability is over 1, is the probability with which its documents are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Cells that one task may rake; more are raked over shuffled windows.
ONE_TASK_CELLS = 200_000
SEED = "mix"
#: A category's target is at most so many times its share of the tokens; what cells may lack of the mixture's tokens.
MOST_RATIO, SLACK = 2.0, 0.002
#: Raking goes on until no marginal's share is further from its target than this, or for so many rounds.
TOLERANCE = 1e-10
ROUNDS = 150


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """What a text is made of, for tables without a topic column: table, markup, list or prose."""
    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    return F.when(5 * count(r"\|") >= tokens, "table").when(2 * count("[#*$%&]") >= tokens, "markup").when(12 * count("\n") >= tokens, "list").otherwise("prose")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that follows from the id alone: 52 bits of its md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _shares(cells: DataFrame, key: str, targets: DataFrame | None, power: float, others: float, most_ratio: float) -> DataFrame:
    """(_k, share) of every category: its target weight over those of all categories that have tokens, held to most_ratio
    times its share of the tokens; what that takes off goes to the others in proportion."""
    own = cells.groupBy(F.col(key).alias("_k")).agg(F.sum("tokens").alias("_tokens"))
    weight = F.pow(F.col("_tokens").cast("double"), F.lit(power))
    if targets is not None:
        t = targets.select(F.col(key).alias("_t"), F.col("share").cast("double").alias("_w"))
        own = own.join(t, F.col("_k").eqNullSafe(F.col("_t")), "left")
        weight = F.when(F.col("_w").isNull(), F.lit(float(others))).otherwise(F.col("_w"))
    own = checkpointed(own.select("_k", F.col("_tokens").cast("double").alias("_tokens"), F.when(F.col("_tokens") > 0, weight).otherwise(0.0).alias("_w")))
    sums = own.agg(F.sum("_w").alias("w"), F.sum("_tokens").alias("n")).first()
    if not sums.w or not sums.n:
        return own.select("_k", F.lit(0.0).alias(f"_share_{key}"))
    want, most = F.col("_w") / F.lit(sums.w), F.col("_tokens") * F.lit(most_ratio / sums.n)
    scale = 1.0
    while True:  # rises until the held categories stay the same
        held = want * F.lit(scale) > most
        r = own.agg(F.sum(F.when(held, most)).alias("held"), F.sum(F.when(~held, want)).alias("open")).first()
        new = (1 - (r.held or 0.0)) / r.open if r.open else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return own.select("_k", F.least(want * F.lit(scale), most).alias(f"_share_{key}"))


def _ceiling(fitted: DataFrame, slack: float) -> float:
    """The least ratio of fitted tokens to tokens such that what cells need beyond it is at most ``slack`` of all."""
    ratio = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(0.0)
    if slack <= 0:
        return fitted.agg(F.max(ratio)).first()[0] or 0.0
    total = fitted.agg(F.sum("fitted")).first()[0] or 0.0
    c = 0.0
    while True:  # rises to where the loss, which falls in straight pieces, meets the slack
        r = fitted.where(ratio > c).agg(F.sum("fitted").alias("f"), F.sum("tokens").alias("n")).first()
        new = (r.f - slack * total) / r.n if r.n else c
        if new <= c * (1 + 1e-12):
            return c
        c = new


def rake(cells: DataFrame, keys: list[str], targets: dict[str, DataFrame] | None = None, *, power: float = 0.7, others: float = 0.0, most_ratio: float = MOST_RATIO, rounds: int = 6, most: int = ROUNDS) -> DataFrame:
    """cells (keys, tokens) with fitted, the raked tokens, and _share_<key>, the targets.

    ``targets[key]`` has (key, share), weights of categories; one that it lacks weighs ``others``. Without a target table a
    category weighs its tokens to ``power``. Weights are scaled to the categories that have tokens, and none gets more than
    ``most_ratio`` times its share of the tokens: a category that has next to none can't be sampled up without throwing
    nearly all of the others away. The shares that follow are the targets. Null is a category of its own. After every ``rounds`` rounds the marginals are compared with their targets: raking ends when none is further off
    than TOLERANCE, when they come no nearer (no table of these cells has all targets), or after ``most`` rounds.
    """
    targets = targets or {}
    frame = checkpointed(cells)
    n = frame.count()
    total = float(frame.agg(F.sum("tokens")).first()[0] or 0)
    for k in keys:
        shares = _shares(frame, k, targets.get(k), power, others, most_ratio)
        frame = frame.join(shares, frame[k].eqNullSafe(F.col("_k")), "left").drop("_k")
    frame = frame.withColumn("fitted", F.col("tokens").cast("double"))
    missed = float("inf")
    for _ in range(0, most, rounds):
        if n <= ONE_TASK_CELLS:
            frame = frame.coalesce(1)
        for _ in range(rounds):
            for k in keys:
                own = F.sum("fitted").over(Window.partitionBy(k))
                frame = frame.withColumn("_sum", own).withColumn("fitted", F.when(F.col("_sum") > 0, F.col("fitted") * F.lit(total) * F.col(f"_share_{k}") / F.col("_sum")).otherwise(0.0))
        frame = checkpointed(frame.drop("_sum"))
        if not total:
            break
        off = frame.coalesce(1) if n <= ONE_TASK_CELLS else frame
        off = off.select(F.greatest(*[F.abs(F.sum("fitted").over(Window.partitionBy(k)) / F.lit(total) - F.col(f"_share_{k}")) for k in keys]).alias("away"))
        away = off.agg(F.max("away")).first()[0] or 0.0
        if away <= TOLERANCE or away > 0.999 * missed:
            break
        missed = away
    return frame.select(*keys, "tokens", "fitted", *[f"_share_{k}" for k in keys])


def marginals(cells: DataFrame, keys: list[str], targets: dict[str, DataFrame] | None = None, *, slack: float = 0.0, **how) -> DataFrame:
    """(key, category, tokens, target, result) of raked cells: shares that were asked for, and that a sample with the
    probabilities of mix() has in expectation."""
    fitted = checkpointed(rake(cells, keys, targets, **how))
    fitted = fitted.withColumn("kept", F.least(F.col("fitted"), F.col("tokens") * F.lit(_ceiling(fitted, slack))))
    total = fitted.agg(F.sum("kept")).first()[0] or 0.0
    out = None
    for k in keys:
        own = fitted.groupBy(F.col(k).cast("string").alias("category")).agg(F.sum("tokens").alias("tokens"), F.first(f"_share_{k}").alias("target"), F.sum("kept").alias("result"))
        own = own.select(F.lit(k).alias("key"), "category", "tokens", "target", (F.col("result") / F.lit(total) if total > 0 else F.lit(0.0)).alias("result"))
        out = own if out is None else out.unionByName(own)
    return out


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, *, power: float = 0.7, others: float = 0.0, most_ratio: float = MOST_RATIO, slack: float = SLACK, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
) -> DataFrame:
    """docs with mix_tokens, mix_topic, mix_probability and mix_kept, raked to source, language and topic marginals.

    ``targets`` has tables (source, share), (lang, share), (topic, share); see rake. The probability of a cell is its fitted
    tokens over its tokens, over a ceiling, and 1 at most. The ceiling is the least for which the tokens that cells would
    need beyond all that they have are ``slack`` of the mixture at most; so kept documents have the marginals in
    expectation, but for that share, and a few rare cells don't make all other probabilities small. With a slack of 0 it
    is the largest ratio. A document is kept if a number in [0, 1) made from its id is below its cell's probability.

    * A text without words weighs nothing; a cell of such texts has probability 0. A null text is one of them.
    * A null source or language is a category of its own. A null id draws one number for all; rows that repeat an id are
      kept or not together if they lie in one cell.
    * A text of any length is counted as a whole, in the JVM.
    * All columns are kept; the four that are added replace those of the same name. Empty in, empty out.
    """
    added = ["mix_tokens", "mix_topic", "mix_probability", "mix_kept"]
    keys = ["_source", "_lang", "_topic"]
    names = dict(zip(("source", "lang", "topic"), keys, strict=True))
    text = F.col(f"row.`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("_tokens", words_in(text))
    rows = rows.select("row", "_tokens", F.col(f"row.`{source_col}`").cast("string").alias("_source"), F.col(f"row.`{lang_col}`").cast("string").alias("_lang"), (topic_of(text, F.col("_tokens")) if topic is None else topic).alias("_topic"))
    cells = checkpointed(rows.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")))
    wanted = {names[k]: t.withColumnRenamed(k, names[k]) for k, t in (targets or {}).items()}
    fitted = checkpointed(rake(cells, keys, wanted, power=power, others=others, most_ratio=most_ratio))
    ceiling = _ceiling(fitted, slack)
    probability = F.least(F.col("fitted") / (F.col("tokens") * F.lit(ceiling)), F.lit(1.0)) if ceiling > 0 else F.lit(0.0)
    probability = F.when(F.col("tokens") > 0, probability).otherwise(0.0).alias("_p")
    fitted = fitted.select(*[F.col(k).alias(f"{k}_") for k in keys], probability)
    # Cells hold three names of some 20 bytes; more of them are joined by a shuffle.
    fitted = F.broadcast(fitted) if cells.count() <= ONE_TASK_CELLS else fitted
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    out = rows.join(fitted, same, "left")
    kept = uniform(F.col(f"row.`{id_col}`"), seed) < F.col("_p")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], F.col("_tokens").alias(added[0]), F.col("_topic").alias(added[1]), F.col("_p").alias(added[2]), F.coalesce(kept, F.lit(False)).alias(added[3]))


def target_tables(spark: SparkSession, weights: dict[str, dict[str, float]]) -> dict[str, DataFrame]:
    """Target tables from weights by key and category."""
    return {k: spark.createDataFrame([*w.items()], f"{k} string, share double") for k, w in weights.items()}


def mix_sql(weights: dict[str, dict[str, float]], others: float, documents: str = "documents", rounds: int = 150, seed: str = SEED, most_ratio: float = MOST_RATIO, slack: float = SLACK) -> str:
    """DuckDB SQL of (doc_id, source, lang, topic, tokens, probability, kept) for mix() with target_tables(weights)."""
    words = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT"
    less = lambda gone: f"coalesce(length(text) - length({gone}), 0)"
    pipes, lines, symbols = less("replace(text, '|', '')"), less("replace(text, chr(10), '')"), less("regexp_replace(text, '[#*$%&]', '', 'g')")
    topic = f"CASE WHEN 5 * {pipes} >= tokens THEN 'table' WHEN 2 * {symbols} >= tokens THEN 'markup' WHEN 12 * {lines} >= tokens THEN 'list' ELSE 'prose' END"
    parts = [
        f"w0 AS (SELECT doc_id, source, lang, text, {words} AS tokens FROM {documents})",
        f"w AS (SELECT doc_id, source, lang, tokens, {topic} AS topic FROM w0)",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM w GROUP BY ALL)",
    ]
    for k in ("source", "lang", "topic"):
        named = " ".join(f"WHEN {k} = '{name}' THEN {float(w)}" for name, w in weights[k].items())
        parts.append(f"s_{k} AS (SELECT {k}, sum(tokens) AS n, CASE WHEN sum(tokens) <= 0 THEN 0.0 {named} ELSE {float(others)} END::DOUBLE AS w FROM c GROUP BY {k})")
        parts.append(f"v_{k} AS (SELECT {k}, w / sum(w) OVER () AS want, n * {most_ratio} / sum(n) OVER () AS most FROM s_{k})")
        order = f"OVER (ORDER BY CASE WHEN want > 0 THEN most / want ELSE 1e300 END, {k} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        # the scale of the open categories: the greatest over those that the prefixes of a falling pressure give
        parts.append(f"l_{k} AS (SELECT greatest(1.0, max(CASE WHEN open_ > 1e-12 THEN (1 - held) / open_ END)) AS l FROM (SELECT sum(most) {order} AS held, 1 - sum(want) {order} AS open_ FROM v_{k}))")
        parts.append(f"t_{k} AS (SELECT {k}, least(want * l, most) AS share_{k} FROM v_{k}, l_{k})")
    join = " ".join(f"JOIN t_{k} ON c.{k} IS NOT DISTINCT FROM t_{k}.{k}" for k in ("source", "lang", "topic"))
    parts.append(f"f0 AS (SELECT c.*, share_source, share_lang, share_topic, sum(c.tokens) OVER () AS total FROM c {join})")
    step = "f WHERE i < {n}".format(n=rounds)
    for k in ("source", "lang", "topic"):
        scaled = f"CASE WHEN sum(fitted) OVER (PARTITION BY {k}) > 0 THEN fitted * total * share_{k} / sum(fitted) OVER (PARTITION BY {k}) ELSE 0.0 END"
        step = f"(SELECT * REPLACE ({scaled} AS fitted) FROM {step})"
    parts.append(f"f AS (SELECT 0 AS i, f0.*, tokens AS fitted FROM f0 UNION ALL SELECT * REPLACE (i + 1 AS i) FROM {step})")
    parts.append(f"r AS (SELECT source, lang, topic, tokens, fitted, CASE WHEN tokens > 0 THEN fitted / tokens ELSE 0.0 END AS ratio FROM f WHERE i = {rounds})")
    falling = "OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    parts.append(f"z AS (SELECT max((f - {slack} * total) / n) AS ceiling FROM (SELECT sum(fitted) {falling} AS f, sum(tokens) {falling} AS n, sum(fitted) OVER () AS total FROM r) WHERE n > 0)")
    parts.append("p AS (SELECT source, lang, topic, least(ratio / ceiling, 1.0) AS probability FROM r, z)")
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(w.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0"
    same = " AND ".join(f"w.{k} IS NOT DISTINCT FROM p.{k}" for k in ("source", "lang", "topic"))
    return f"WITH RECURSIVE {', '.join(parts)} SELECT w.doc_id, w.source, w.lang, w.topic, w.tokens, round(p.probability, 6) AS probability, {draw} < p.probability AS kept FROM w JOIN p ON {same}"
