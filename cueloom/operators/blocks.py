"""Scans over one key's ordered rows, cut into blocks, so that a key with most rows of a table is spread over tasks.

A block is a range of the order column. What a row needs from the rows before its block (the last row's value, or the
last one that isn't null) is worked out from one summary row a block and put in front of the block as an entry row;
each block is then a window of its own. Runs that cross borders are stitched: only the first and the last run of
a block can, so the pass by key reads two rows a block at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_entries(rows: DataFrame, key: str, by: str, width: int, value: str, skip_nulls: bool = False) -> DataFrame:
    """rows with `block` and `entry`, and for each block a row with entry true whose value is the one that the blocks before leave."""
    rows = rows.withColumn("block", F.floor(F.col(by) / width).cast("long")).withColumn("entry", F.lit(False))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(by)) if skip_nulls else F.col(by))
    sums = rows.groupBy(key, "block").agg(last.alias(value))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entries = sums.withColumn(value, F.last(value, ignorenulls=skip_nulls).over(before)).withColumn("entry", F.lit(True))
    return rows.unionByName(entries, allowMissingColumns=True)


def in_block(key: str, by: str):
    """The order of a block's rows, after its entry row."""
    return Window.partitionBy(key, "block").orderBy(F.desc("entry"), by)


def stitched(runs: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """runs (key, block, joined, lo, hi; joined: goes on with the last run of the block before) -> key, lo, hi."""
    last = F.max(lo).over(Window.partitionBy(key, "block"))
    runs = runs.withColumn("edge", F.col("joined") | (F.col(lo) == last))
    run = F.sum((~F.col("joined")).cast("int")).over(Window.partitionBy(key).orderBy("block", lo))
    met = runs.where("edge").withColumn("run", run).groupBy(key, "run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
    return runs.where(~F.col("edge")).select(key, lo, hi).unionByName(met.select(key, lo, hi))


def numbered(runs: DataFrame, key: str) -> DataFrame:
    """runs (key, block, run: which of the block's new runs, 0 for one that goes on) with `run` counted over all blocks of the key."""
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy(F.col(key).alias("of"), F.col("block").alias("at")).agg(F.max("run").alias("earlier")).withColumn("earlier", F.coalesce(F.sum("earlier").over(before), F.lit(0)))
    return runs.join(sums, runs[key].eqNullSafe(sums["of"]) & runs["block"].eqNullSafe(sums["at"])).withColumn("run", F.col("run") + F.col("earlier")).drop("of", "at", "earlier")
