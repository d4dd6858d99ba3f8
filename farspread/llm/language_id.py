"""Language identification by rank-order profiles of letter n-grams (Cavnar and Trenkle, 1994).

A text is its words in lower case, each between two spaces; other characters than letters part words. Its profile is
its most frequent 1- to 3-grams in falling order of count. The distance to a language is the sum over the text's
n-grams of how far their ranks in the two profiles lie apart, the profile's size for those that the language lacks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, record_batch, released, runs, slices

PROFILE = 400
#: n-grams that a task holds before it adds equal ones up.
HELD = 4_000_000
#: Profiles that may be sent to all tasks: so many languages of PROFILE n-grams each.
LANGUAGES = 1000
#: Characters of a text whose n-grams are counted at once.
SEGMENT = 1_000_000
_GAP = re.compile(r"\s")
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by n-gram."""
    grams, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(grams, kind="stable")
    start, _ = runs(grams[order])
    return grams[order][start], np.add.reduceat(counts[order], start) if len(start) else counts


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams as whole numbers, 21 bits a character, and their counts.

    A long text is taken by parts that end at a white space: no n-gram goes over one.
    """
    parts, start = [], 0
    while len(text) - start > SEGMENT and (gap := _GAP.search(text, start + SEGMENT)):
        parts.append(_ngrams(text[start : gap.start()]))
        start = gap.start()
    last = _ngrams(text[start:] if start else text)
    return added([*parts, last]) if parts else last


def _ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(letter_table()[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = codes[:-1], codes[1:]
    pairs = (a << 21) | b
    triples = (pairs[:-1] << 21) | codes[2:]
    all_of = np.concatenate((codes[codes != 32], pairs, triples[codes[1:-1] != 32]))
    all_of.sort()
    start, end = runs(all_of)
    return all_of[start], end - start


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in falling order of count, ties by n-gram."""
    if len(grams) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:size]]


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    held: dict[str, list] = {}
    size = 0

    for batch in slices(batches):
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(lang, []).append(ngrams(text))
            size += len(held[lang][-1][0])
            if size > HELD:
                held = {k: [added(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD // 2:
                    for k, v in held.items():
                        yield record_batch(schema, [k] * len(v[0][0]), *v[0])
                    held, size = {}, 0
    for k, v in held.items():
        grams, counts = added(v)
        yield record_batch(schema, [k] * len(grams), grams, counts)


def fit_profiles(docs: DataFrame, *, size: int = PROFILE, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[int]]:
    """Of each language its most frequent n-grams, counted over all rows with a text and a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(released(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = checkpointed(counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size))
    languages = top.select("lang").distinct().limit(LANGUAGES + 1).count()
    if languages > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():  # at most LANGUAGES * size rows
        out.setdefault(r.lang, []).append(r.gram)
    return out


def _predict(profiles: dict[str, list[int]], size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        tables = []
        for lang in sorted(profiles):
            grams = np.array(profiles[lang], np.int64)
            order = np.argsort(grams)
            tables.append((lang, grams[order], order))
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = ranked(*ngrams(text), size) if text else np.zeros(0, np.int64)
                if not len(own) or not tables:
                    rows.append((doc_id, "und", 0.0))
                    continue
                places, best = np.arange(len(own)), None
                for lang, grams, ranks in tables:
                    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                    away = np.where(grams[at] == own, np.abs(ranks[at] - places), size)
                    distance = int(away.sum())
                    if best is None or distance < best[0]:
                        best = distance, lang
                rows.append((doc_id, best[1], 1 - best[0] / (size * len(own))))
            if rows:
                yield record_batch(schema, *zip(*rows, strict=True))

    return run


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], *, size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs; score is 1 less the distance over the largest possible one.

    * A null text, or one without a letter, is ``und`` with score 0; so is any text when there is no profile.
    * A text of any length is read as a whole, by parts of about SEGMENT characters.
    * Equal distances go to the language that sorts first. A null id is kept as null, repeated rows are all returned.
    * Other columns of docs are not read, whatever their names. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(released(_predict(profiles, size)), "doc_id long, lang_pred string, score double")
