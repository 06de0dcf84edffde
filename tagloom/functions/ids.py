"""Item ids: 64 blocks of 2**58; the block tells the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.literals import BLOCK, ORIGINS, SHOWN


def _by_block(c: Column, then) -> Column:
    out = None
    for block in ORIGINS:
        hit = c.between(block * BLOCK, block * BLOCK + BLOCK - 1)
        out = F.when(hit, then(block)) if out is None else out.when(hit, then(block))
    return out


def origin_of(c: Column) -> Column:
    """builtin, user, file or plugin."""
    return _by_block(c, lambda b: F.lit(ORIGINS[b]))


def shown_id(c: Column) -> Column:
    """``File(7)`` and the like."""
    return _by_block(c, lambda b: F.concat(F.lit(f"{SHOWN[b]}("), (c - b * BLOCK).cast("string"), F.lit(")")))


def allocate(rows: DataFrame, used: DataFrame, block: int, order: list) -> DataFrame:
    """rows with a new item_id in a block: above the largest one in used, without gaps.

    Rows are dealt to 1024 buckets by a hash of the order columns and numbered by these inside a bucket; a bucket starts where
    the counts of those before it end. So the same rows get the same ids, and no task numbers all of them.
    """
    base = used.where(F.col("item_id").between(block * BLOCK, block * BLOCK + BLOCK - 1)).agg(F.coalesce(F.max("item_id") + 1, F.lit(block * BLOCK)).alias("__base"))
    bucket = F.pmod(F.xxhash64(*order), F.lit(1024))
    rows = rows.withColumn("__b", bucket)
    counts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__start"))
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1)
    out = numbered.join(F.broadcast(starts), "__b").crossJoin(F.broadcast(base))
    return out.withColumn("item_id", F.col("__base") + F.col("__start") + F.col("__k")).drop("__b", "__k", "__start", "__base")
