"""The corpus pipeline: each stage works on all that the one before it kept.

Every stage but the last returns the columns of its documents, whatever other columns they have; an operator sees only
those that it needs, so that its own names clash with none. An empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farspread.llm import jaccard_join, mixing, packing, rule_ensemble, substring_dedup
from farspread.llm.common import checkpointed, documents, small_or_plain
from farspread.llm.queries import MIXTURE, OTHERS, training_labels

#: SQL can express neither the fitted rules nor the chunks nor the packing.
ORACLE_SQL = None
SCORE = 0.3


def _aside(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator needs, and all but the text in one column, ``held``."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(others.alias("held"), *needed)


def _restored(out: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs from ``held`` and the text; those in ``changed`` are replaced."""
    return out.select(*[changed.get(c, F.col("text") if c == "text" else F.col(f"held.`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least SCORE. Labels are learnt from the training fold of those that are left.

    A null or empty text scores as one without a word. Rows that repeat an id, or have none, are judged one by one.
    """
    rules = rule_ensemble.fit_quality(docs, training_labels(spark, sf_dir))
    scored = rule_ensemble.score_quality(_aside(docs, "text"), rules, score_col="score")
    return _restored(scored.where(F.col("score") >= SCORE), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id.

    Rows that repeat an id are one document and stay together. Rows without an id, and texts without a word, stay.
    """
    groups = jaccard_join.jaccard_components(docs, n=5, threshold="0.8")
    gone = checkpointed(groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct())
    held = _aside(docs, "text", "doc_id")
    return _restored(held.join(small_or_plain(gone), F.col("doc_id") == F.col("gone"), "left_anti"), docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that an earlier one has; those of which no word is left go.

    ``n_chars`` follows a text that was cut. A null or empty text stays as it is; see dedup_substrings for rows that
    repeat an id or have none.
    """
    out = substring_dedup.dedup_substrings(_aside(docs, "text", "doc_id"))
    emptied = (F.col("bytes_cut") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~emptied)
    if "n_chars" not in docs.columns:
        return _restored(out, docs)
    length = F.when(F.col("bytes_cut") > 0, F.length("text")).otherwise(F.col("held.`n_chars`")).cast(docs.schema["n_chars"].dataType)
    return _restored(out, docs, n_chars=length)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents with the target weights of sources, languages and topics. Texts without a word go."""
    out = mixing.mix(_aside(docs, "text", "doc_id", "source", "lang"), mixing.target_tables(spark, MIXTURE), others=OTHERS)
    return _restored(out.where("mix_kept"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings), ("mixing to target weights", mixture), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
