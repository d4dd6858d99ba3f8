"""Order of processing as an explicit column: stride, limit, shuffle, batches, samples.

``pos`` numbers rows from 0 in processing order. Numbers come from a two-step count (per range, then within it), so no
single task sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import checkpointed


def with_position(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """df with the row's place, from 0, in a total order of the given columns."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    # A checkpoint fixes the partition that a row is in: both readers below see the same.
    parts = checkpointed(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0).alias("_all")).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("_part", before.alias("_base"))
    return parts.withColumn("_rn", within).join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + F.col("_rn") - 1).cast("long")).drop("_part", "_rn", "_base")


def shuffle_key(seed: int, key: Column) -> Column:
    """A seeded global permutation: the same here as in any engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stride(df: DataFrame, every: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) % every == 0)


def batch_of(pos: Column, batch_size: int, n: int) -> Column:
    """Contiguous batches; one batch for a size of 0 or of n and over."""
    return F.lit(0).cast("long") if batch_size <= 0 or batch_size >= n else F.floor(pos / batch_size).cast("long")


def n_batches(n: int, batch_size: int) -> int:
    return 0 if n == 0 else 1 if batch_size <= 0 or batch_size >= n else -(-n // batch_size)


def quota(batch: int, batches: int, target: int) -> int:
    """A batch's part of the target; the parts add up to it, but none is 0."""
    return target if batches <= 1 else max(1, target * (batch + 1) // batches - target * batch // batches)


def quota_column(batch: Column, batches: int, target: int) -> Column:
    if batches <= 1:
        return F.lit(target).cast("long")
    return F.greatest(F.lit(1), F.floor(F.lit(target) * (batch + 1) / batches) - F.floor(F.lit(target) * batch / batches)).cast("long")


def sample(df: DataFrame, n: int, key: Column, seed: int) -> DataFrame:
    """n rows without replacement, the same whatever the partitions: those with the smallest seeded hashes."""
    return df.orderBy(shuffle_key(seed, key), key).limit(n)


def sample_per_group(df: DataFrame, group: str, quota: Column, key: Column, seed: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(shuffle_key(seed, key), key)
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= quota).drop("_rn")


def first_of(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key: DISTINCT ON."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
