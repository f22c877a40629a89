"""Jobs that the engine lacks as built-ins: bucketed range joins and folds over ordered rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.shared import held

#: Differences of time by which two gaps still count as equal.
_CLOSE = 1e-9


#: Rows of a key on one side that meet a block of the other in one task, and pairs of a task, about.
BLOCK_ROWS, TASK_PAIRS = 1 << 13, 1 << 27


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """The equi-join on keys for sides whose pairs are many more than their rows.

    Keys with more than a block of rows on a side are cut into blocks by hashes of their rows, and each block
    of a side meets each of the other, so that a crowded key is many tasks. There are as many partitions as the pairs
    ask for, not as the rows' bytes do. Keys' rows are counted in a first pass. Column names must differ but for the keys.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = held(count(left, "_nl").join(count(right, "_nr"), keys))
    pairs = sizes.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr"))).first()[0] or 0
    n = max(left.sparkSession.sparkContext.defaultParallelism, -int(-pairs // TASK_PAIRS))

    def side(df: DataFrame, own: str, other: str, at: str, against: str) -> DataFrame:
        blocks = lambda name: F.ceil(F.col(name) / block)
        cut = df.withColumn("_h", F.xxhash64(*df.columns)).join(sizes, keys)
        cut = cut.withColumn(at, F.pmod("_h", blocks(own))).withColumn(against, F.explode(F.sequence(F.lit(0).cast("long"), blocks(other) - 1)))
        return cut.drop("_h", own, other).repartition(n, *keys, "_i", "_j")

    return side(left, "_nl", "_nr", "_i", "_j").join(side(right, "_nr", "_nl", "_j", "_i").hint("merge"), [*keys, "_i", "_j"]).drop("_i", "_j")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], slack: float = 0.0, bucket: float = 10.0, dealt: bool = False) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals come within slack of each other.

    Both sides are spread over time buckets and meet by an equi-join on (keys, bucket), so a
    long recording is many small groups; a pair is taken in its first common bucket only.
    Column names of the sides must differ but for the keys. Where pairs are many more than rows, `dealt` cuts
    crowded buckets and deals them over as many tasks as their pairs need.
    """

    def spread(df: DataFrame, span: tuple[str, str], slack: float, name: str) -> DataFrame:
        low, high = F.floor((F.col(span[0]) - slack) / bucket), F.floor((F.col(span[1]) + slack) / bucket)
        return df.withColumn(name, low).withColumn("_bucket", F.explode(F.sequence(low, high)))

    a, b = spread(left, left_span, slack, "_first_a"), spread(right, right_span, 0.0, "_first_b")
    near = (F.col(left_span[0]) - slack <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]) + slack)
    both = dealt_join(a, b, [*keys, "_bucket"]) if dealt else a.join(b, [*keys, "_bucket"])
    return both.where(near & (F.col("_bucket") == F.greatest("_first_a", "_first_b"))).drop("_bucket", "_first_a", "_first_b")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, pd.Series], tuple[object, list[tuple]]], schema: str) -> DataFrame:
    """Runs a state machine over the rows of each key in order, in constant memory per key.

    step takes the state and a row and gives the new state and rows to emit; the state starts
    anew at each key. Keys are dealt by hash and sorted within partitions; nothing is grouped in memory.
    Rows whose keys are null are one key of their own; equal rows keep no order among them; an empty table emits nothing.
    """
    names = [part.split()[0] for part in schema.replace("\n", " ").split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, raw = None, None, None
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                now = tuple([getattr(row, k) for k in keys])
                if now != raw:  # nulls may differ from themselves
                    raw, key = now, tuple(None if pd.isna(v) else v for v in now)
                    if key != at:
                        at, state = key, start()
                state, rows = step(state, row)
                out.extend(rows)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


#: A stretch of time in which rows find those before and after them, in gaps.
STRETCH = 64


def thin(df: DataFrame, keys: list[str], at: str, tie: list[str], gap: float) -> DataFrame:
    """Keeps each key's first row, and then every row at least gap after the last one kept; of rows at one time the first by tie.

    A row with none less than gap before it is kept whatever came earlier. From each of these
    a chain leads from a row to the first one at least gap later; chains are followed by pointers
    that double in length each round, all keys at once. Rows meet within stretches of
    time, so one busy key is many small groups. Rows without a time are dropped; null keys are a
    key; with a gap of 0 all rows stay. Between rounds keys are 16 bytes of their SHA-256, however long they are.
    """
    if gap <= _CLOSE:
        return df.where(F.col(at).isNotNull())
    names = df.columns
    key = F.unhex(F.substring(F.sha2(F.to_json(F.struct(*keys)), 256), 1, 32)).alias("_k")
    first = F.min_by(F.struct(*names), F.struct(*tie)) if tie else F.first(F.struct(*names))
    rows = held(df.where(F.col(at).isNotNull()).groupBy(key, F.col(at).cast("double").alias("_t")).agg(first.alias("_row")))
    width = STRETCH * gap
    # a row's own stretch, and the one before or after for rows that are within two gaps of it
    mine = F.floor(F.col("_t") / width)
    around = F.array_distinct(F.array(mine, F.floor((F.col("_t") - 2 * gap) / width), F.floor((F.col("_t") + 2 * gap) / width)))
    spread = rows.select("_k", "_t", mine.alias("_mine"), F.explode(around).alias("_b"))
    up = Window.partitionBy("_k", "_b").orderBy("_t")
    # in falling order, the rows at least gap later come first, and the last of them is the nearest
    later = F.expr(f"last(_t) OVER (PARTITION BY _k, _b ORDER BY _t DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {gap - _CLOSE!r}D PRECEDING)")
    linked = spread.select("_k", "_t", "_mine", "_b", F.coalesce(F.col("_t") - F.lag("_t").over(up) >= gap - _CLOSE, F.lit(True)).alias("_free"), later.alias("_next"))
    linked = held(linked.where("_mine = _b").select("_k", "_t", "_free", "_next"))
    kept = linked.where("_free").select("_k", "_t")
    bound = linked.where("NOT _free").select("_k", F.col("_t").alias("_next"))
    jumps = held(linked.join(bound, ["_k", "_next"]).select("_k", "_t", "_next"))
    reached = kept
    while not jumps.isEmpty():
        new = held(reached.join(jumps, ["_k", "_t"]).select("_k", F.col("_next").alias("_t")))
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        jumps = held(jumps.join(jumps.select("_k", F.col("_t").alias("_next"), F.col("_next").alias("_far")), ["_k", "_next"]).select("_k", "_t", F.col("_far").alias("_next")))
    return rows.join(reached, ["_k", "_t"]).select("_row.*")


def islands(breaks: Column, window) -> Column:
    """Numbers runs of rows: a running count of rows that start a new one."""
    return F.sum(F.when(breaks, 1).otherwise(0)).over(window)
