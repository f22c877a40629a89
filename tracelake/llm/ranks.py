"""Ranks of rows within groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import Scratch

#: monotonically_increasing_id counts a partition's rows from its number times this.
PART = 1 << 33


def ordered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows as a staged table in order over all its files, with `pos`, a long that ascends in that order.

    rows must read tables, so that a repeated task sees the same rows. Rows that are equal in
    all of order are parted at random (a fixed seed), so that many copies are no single task.
    """
    salted = rows.withColumn("_salt", F.rand(20240611))
    dealt = salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    return scratch.put(dealt.withColumn("pos", F.monotonically_increasing_id()), name)


def ranked(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with `rank` from 0 within their group in order, and `size`, the group's number of rows. group has no nulls.

    Rows are dealt by ranges of (group, order), so a group may lie in many tasks; what comes
    before is summed over parts of groups, of which there is one for a group and task at most.
    """
    table = ordered(rows, [group, *order], scratch, name)
    part = F.shiftright("pos", 33)
    parts = table.groupBy(group, part.alias("_part")).agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("size"))
    return table.withColumn("_part", part).join(parts, [group, "_part"]).withColumn("rank", F.col("pos") + F.col("_shift")).drop("_part", "_shift", "pos")
