"""Provenance keys: the base name of a source file and the frame's number in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def provenance_key(source_file: Column, frame_index: Column) -> Column:
    return F.concat(basename(source_file), F.lit(":"), frame_index.cast("bigint").cast("string"))


def split_source(src: Column) -> Column:
    """(source_file, frame) cut at the last colon; an error without one."""
    parts = F.struct(F.regexp_extract(src, "^(.*):([^:]*)$", 1).alias("source_file"), F.regexp_extract(src, "^(.*):([^:]*)$", 2).alias("frame"))
    return F.when(F.instr(src, ":") > 0, parts).otherwise(F.raise_error(F.concat(F.lit("no ':' in "), src)))


def kind_of(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".traj"), "traj").when(low.endswith(".xyz") | low.endswith(".extxyz"), "xyz").otherwise("generic")
