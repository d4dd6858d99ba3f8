"""Describing records: feature lookup by provenance key, coverage, and the ordered status of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import FeatureTableError
from ..functions.provenance import basename

#: Quoted in messages at most.
SHOWN = 10


def duplicate_keys(table: DataFrame, key: str = "key") -> DataFrame:
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def basename_collisions(files: DataFrame, path: str = "source_file") -> DataFrame:
    """Base names that several paths share: their provenance keys would meet."""
    return files.select(basename(F.col(path)).alias("name"), F.col(path).alias("p")).groupBy("name").agg(F.countDistinct("p").alias("n_paths")).where("n_paths > 1")


def select_group(table: DataFrame, group: str | None, column: str = "group_label") -> DataFrame:
    """The rows of one feature group; without a choice the table must have one group only."""
    labels = [r[0] for r in table.select(column).distinct().orderBy(column).limit(SHOWN + 1).collect()]
    if group is None:
        if len(labels) > 1:
            raise FeatureTableError(f"the table has several groups: {labels[:SHOWN]}; choose one")
        return table
    if group not in labels and not table.where(F.col(column) == group).limit(1).count():
        raise FeatureTableError(f"no group {group!r}; there are {labels[:SHOWN]}")
    return table.where(F.col(column) == group)


def lookup(frames: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """frames with valid and features of the table; a frame that it lacks isn't valid. The table's keys must be unique."""
    twice = duplicate_keys(table, key).orderBy(key).limit(SHOWN).collect()
    if twice:
        raise FeatureTableError("duplicate keys: " + ", ".join(str(r[0]) for r in twice))
    joined = frames.join(table.select(key, "valid", "features"), key, "left")
    return joined.withColumn("found", F.col("valid").isNotNull()).withColumn("valid", F.coalesce("valid", F.lit(False)))


def missing(frames: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    return frames.join(table, key, "left_anti")


def inherited(frames: DataFrame, skipped: DataFrame, key: str = "key") -> DataFrame:
    return frames.join(skipped, key, "left_semi")


def check_coverage(frames: DataFrame, table: DataFrame, key: str = "key", on_invalid: str = "error") -> None:
    """All that is wrong at once, or nothing."""
    found = []
    for what, rows in (("missing", missing(frames, table, key)), ("invalid", frames.join(table.where("not valid"), key, "left_semi") if on_invalid == "error" else None)):
        if rows is not None and (n := rows.count()):
            found.append(f"{n} {what}: " + ", ".join(str(r[0]) for r in rows.select(key).orderBy(key).limit(SHOWN).collect()))
    if found:
        raise FeatureTableError("; ".join(found))


def status(*, small_vacuum: Column, vacuum: Column, cutoff: Column, box_error: Column, unknown: Column, inherited_status: Column, valid: Column) -> Column:
    """The first that applies, in this order; 'ok' else. unknown: texts such as Fe(26)."""
    return (
        F.when(small_vacuum, F.concat(F.lit("small_vacuum:2*vac="), (2 * vacuum).cast("string"), F.lit("<cutoff="), cutoff.cast("string")))
        .when(box_error.isNotNull(), F.concat(F.lit("box_error:"), box_error))
        .when(F.size(unknown) > 0, F.concat(F.lit("skipped_species:"), F.concat_ws(",", unknown)))
        .when(inherited_status.isNotNull(), inherited_status)
        .when(~valid, F.lit("invalid_features:no valid row"))
        .otherwise("ok")
    )


def numbered(frames: DataFrame, order: str = "pos") -> DataFrame:
    """row: consecutive numbers of described frames in processing order, null for the others. Counted per 65,536 positions first."""
    ok = F.col("status") == "ok"
    block = F.floor(F.col(order) / 65_536)
    counts = frames.groupBy(block.alias("_block")).agg(F.sum(F.when(ok, 1).otherwise(0)).alias("_n"))
    base = counts.select("_block", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0).alias("_all")).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.sum(F.when(ok, 1).otherwise(0)).over(Window.partitionBy("_block").orderBy(order))
    return frames.withColumn("_block", block).withColumn("_rn", within).join(base, "_block").withColumn("row", F.when(ok, F.col("_base") + F.col("_rn") - 1).cast("long")).drop("_block", "_rn", "_base")


def gather_unique(selection: DataFrame, rank: str = "rank") -> DataFrame:
    """Each (source_file, frame_index) once, at its best rank."""
    order = Window.partitionBy("source_file", "frame_index").orderBy(rank)
    return selection.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def out_of_range(selection: DataFrame, frames: DataFrame) -> DataFrame:
    return selection.join(frames, ["source_file", "frame_index"], "left_anti")


def legacy_index(selection: DataFrame, fallback_source: str, column: str = "original_index") -> DataFrame:
    """An older selection table: rows whose index isn't a number go, the source is the fallback."""
    return selection.withColumn("frame_index", F.expr(f"try_cast({column} AS double)").cast("bigint")).where("frame_index is not null").withColumn("source_file", F.lit(fallback_source))
