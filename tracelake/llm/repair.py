"""Repair of the turn structure of conversations: the cheapest edits to an alternation of user and assistant.

A row is known to the repair by a code: its role's initial and its fault. Rows lie in one order
over the whole table, and blocks of it, about as long as the square root of the longest
conversation's rows, are the checkpoints of a dynamic program: a block is a min-plus matrix
over four states; what the rows after each block cost comes from the matrices; with that, each
block is walked by itself. Within a block vectors are kept at every square root of its rows only,
and computed anew while the walk goes forward.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import Scratch, bounded_batches
from tracelake.llm.ranks import ordered

#: Rows of a block, at least, as a power of two.
BLOCK_BITS = 10
#: White space (fixed value), and what ends a whole text.
SPACE, STOPS = " \t\n\v\f\r", ".!?"
#: What an edit costs, and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States: nothing yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the one role that an edit may put next, and what is still to insert at the end.
_NEXT = (USER, USER, ASSISTANT, USER)
_END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40
#: Where a kept row of each initial (s, u, a, any other) may stand, and where it leads.
_KEPT = ({NONE: SYSTEM}, {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
_LEGAL = {(0, 1), (1, 2), (2, 1)}

KEY = ["none", "conv"]


def _row(code: int) -> list[tuple[int, int, str, int]]:
    """(state, next state, edit, cost) of everything that can be done with a row."""
    initial, fault = divmod(code, 4)
    out = [(p, p, "D", DELETE) for p in range(4)]
    if fault < 2:
        out += [(p, q, "K", fault * TRUNCATED) for p, q in _KEPT[initial].items()]
        out += [(p, _NEXT[p], "R", REROLE + fault * TRUNCATED) for p in range(4)]
    return out


def _matrix(code: int) -> np.ndarray:
    """Least costs from state to state over insertions before a row, and the row."""
    m = np.full((4, 4), _FAR)
    for p, q, _, c in _row(code):
        m[p, q] = min(m[p, q], c)
    one = m[list(_NEXT)] + INSERT
    two = one[list(_NEXT)] + INSERT
    return np.minimum(m, np.minimum(one, two))


_MATRICES = np.array([_matrix(c) for c in range(16)])
_ROWS = [m.tolist() for m in _MATRICES]
_EDITS = [sorted(((p, q, e, c) for p, q, e, c in _row(code)), key=lambda x: x[2]) for code in range(16)]


def block_matrix(codes: str) -> np.ndarray:
    """The product of a block's matrices, by halves."""
    m = _MATRICES[[int(c, 16) for c in codes]]
    while len(m) > 1:
        last = m[len(m) & ~1 :]
        m = np.minimum((m[: len(m) & ~1 : 2, :, :, None] + m[1::2, None, :, :]).min(2), _FAR)
        m = np.concatenate((m, last)) if len(last) else m
    return m[0]


def _before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    a, b, c, d = after
    return tuple(min(w + a, x + b, y + c, z + d) for w, x, y, z in _ROWS[code])


@lru_cache(1 << 14)
def walk(codes: str, after: tuple[int, ...], state: int, final: bool) -> tuple[str, list[int], list[int], int, int]:
    """The cheapest edits of a block's rows, least in ASCII among equals: (audit, rows, states, last state, cost).

    after: what the rows after the block cost from each state. rows and states tell each
    line that is put out: the row it comes from (-1: inserted) and the state it leads to, negative if
    the row keeps its own role. A final block also makes the insertions at the end.
    """
    rows = [int(c, 16) for c in codes]
    step = isqrt(len(rows)) + 1
    held, at = {len(rows): after}, after
    for i in range(len(rows) - 1, -1, -1):
        at = _before(rows[i], at)
        if i % step == 0:
            held[i] = at
    audit, lines, states, spent = [], [], [], 0

    def insert(p: int) -> int:
        audit.append("I")
        lines.append(-1)
        states.append(_NEXT[p])
        return _NEXT[p]

    p = state
    for start in range(0, len(rows), step):
        stop = min(start + step, len(rows))
        costs = [held[stop]]
        for i in range(stop - 1, start - 1, -1):
            costs.append(_before(rows[i], costs[-1]))
        costs.reverse()
        for i in range(start, stop):
            now, then = costs[i - start], costs[i - start + 1]
            done = False
            while not done:
                best = now[p]
                for source, q, edit, cost in _EDITS[rows[i]]:
                    if edit > "I" and now[_NEXT[p]] + INSERT == best:
                        break  # an insertion comes before what keeps the row
                    if source == p and cost + then[q] == best:
                        audit.append(edit)
                        if edit != "D":
                            lines.append(i)
                            states.append(-q if edit == "K" else q)
                        p, spent, done = q, spent + cost, True
                        break
                if not done:
                    p, spent = insert(p), spent + INSERT
    while final and _END[p]:
        p, spent = insert(p), spent + INSERT
    return "".join(audit), lines, states, p, spent


def _coded(rows: DataFrame) -> Column:
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)), F.lit(0))
    fault = F.when(bare == "", 2).when(F.col("pos") > F.col("_first"), 3).when(F.right(bare, F.lit(1)).isin(*STOPS), 0).otherwise(1)
    return F.lower(F.hex((F.when(initial == 0, 3).otherwise(initial - 1) * 4 + fault).cast("long")))


_PLAN = "none boolean, conv long, block long, first_pos long, audit string, lines array<int>, states array<int>, cost long, blank long, duplicate long, truncated long, illegal long, head int, tail int"


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _PLAN.split(", ")]
    schema = pa.schema(list(zip(names, [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 5, pa.int32(), pa.int32()], strict=True)))
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for none, conv, block, first, codes, after, state, final in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
            audit, lines, states, _, cost = walk(codes, tuple(after), state, final)
            initials, faults = [int(c, 16) // 4 for c in codes], [int(c, 16) % 4 for c in codes]
            illegal = sum(x not in _LEGAL for x in zip(initials, initials[1:], strict=False))
            row = (none, conv, block, first, audit, lines, states, cost, faults.count(2), faults.count(3), faults.count(1), illegal, initials[0], initials[-1])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _matrices(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: block_matrix(c).ravel().tolist())


def _costs_after(g: pd.DataFrame) -> pd.DataFrame:
    """Checkpoints of one conversation: what the rows after each of its blocks cost."""
    g = g.sort_values("block")
    after = [np.array(_END)]
    for m in g["matrix"].iloc[:0:-1]:
        after.append(np.minimum((np.array(m).reshape(4, 4) + after[-1]).min(1), _FAR))
    return pd.DataFrame({"none": g["none"], "conv": g["conv"], "block": g["block"], "after": [x.tolist() for x in after[::-1]], "final": g["block"] == g["block"].max()})


def _ends(codes: pd.Series, after: pd.Series) -> pd.Series:
    """The state in which a block's walk ends, from each state."""
    return pd.Series([[walk(c, tuple(int(x) for x in a), p, False)[3] for p in range(4)] for c, a in zip(codes, after, strict=True)])


def _starts(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("block")
    state, starts = NONE, []
    for ends in g["ends"]:
        starts.append(state)
        state = int(ends[state])
    return pd.DataFrame({"none": g["none"], "conv": g["conv"], "block": g["block"], "state": starts})


class Repaired(NamedTuple):
    report: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, block_bits: int = BLOCK_BITS) -> Repaired:
    """Cheapest edits that make each conversation's role initials an optional s, then pairs of u and a.

    rows: conv_id, turn, role, text, read from tables; null roles and texts are one space, rows
    without conv_id are one conversation. Rows go by turn, nulls first, then role, the text's
    first 64 characters and the digest of role and text; equal rows stay rows each. report: none and
    conv (conv_id is null, and conv_id or 0), blank, duplicate, truncated, illegal, cost, audit,
    and min_turn, max_turn, n_turns. turns: the repaired rows as none, conv, block, at (their
    order), role, text. An empty table gives empty ones.

    No conversation is gathered: blocks and the blocks of a conversation are about the square
    root of its rows, and repeated texts are found by grouping. An audit is one value, as long as
    its conversation has edits.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    r = rows.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    r = r.withColumn("_key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).withColumn("_head", F.left("text", F.lit(64)))
    table = ordered(r, [*KEY, "turn", "role", "_head", "_key"], scratch, "turns").drop("_head")
    turns = table.groupBy(*KEY, "turn").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.min("turn").alias("min_turn"), F.max("turn").alias("max_turn"), F.count("turn").alias("n_turns"), F.sum("n").alias("n"))
    turns = scratch.put(turns, "spans")
    most = turns.agg(F.max("n")).first()[0] or 0
    bits = max(block_bits, (isqrt(most).bit_length()))
    # repeated rows by grouping; the table of those is joined, small or not
    seen = table.groupBy(*KEY, "_key").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    coded = table.join(seen, [*KEY, "_key"], "left").select(*KEY, F.shiftright("pos", bits).alias("block"), "pos", _coded(table).alias("code"))
    blocks = coded.groupBy(*KEY, "block").agg(F.min("pos").alias("first_pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"))
    blocks = scratch.put(blocks.join(blocks.groupBy(*KEY).agg(F.count("*").alias("n_blocks")), KEY), "blocks")
    long = blocks.where("n_blocks > 1").select(*KEY, "block", "first_pos", "codes")
    matrices = long.select(*KEY, "block", F.pandas_udf(_matrices, "array<long>")("codes").alias("matrix"))
    after = matrices.groupBy(*KEY).applyInPandas(_costs_after, "none boolean, conv long, block long, after array<long>, final boolean")
    long = scratch.put(long.join(after, [*KEY, "block"]), "costs")
    ends = long.select(*KEY, "block", F.pandas_udf(_ends, "array<int>")("codes", "after").alias("ends"))
    starts = ends.groupBy(*KEY).applyInPandas(_starts, "none boolean, conv long, block long, state int")
    whole = blocks.where("n_blocks = 1").select(*KEY, "block", "first_pos", "codes", F.array(*(F.lit(x).cast("long") for x in _END)).alias("after"), F.lit(NONE).alias("state"), F.lit(True).alias("final"))
    known = whole.unionByName(long.join(starts, [*KEY, "block"]).select(*whole.columns))
    plan = scratch.put(known.mapInArrow(_planned, _PLAN), "plan")

    parts = F.sort_array(F.collect_list(F.struct("block", "audit", "head", "tail")))
    found = plan.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), parts.alias("p"))
    legal = ", ".join(f"{a}{b}" for a, b in sorted(_LEGAL))
    between = F.expr(f"size(filter(transform(sequence(1, size(p)), i -> CASE WHEN i < size(p) THEN 10 * p[i - 1].tail + p[i].head END), x -> x NOT IN ({legal})))")
    report = found.select(*KEY, "blank", "duplicate", "truncated", (F.col("illegal") + between).alias("illegal"), "cost", F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"))
    report = report.join(turns.drop("n"), KEY)

    lines = plan.select(*KEY, "block", "first_pos", F.posexplode(F.arrays_zip("lines", "states")).alias("at", "x")).select(*KEY, "block", "at", F.when(F.col("x.lines") >= 0, F.col("first_pos") + F.col("x.lines")).alias("pos"), F.col("x.states").alias("to"))
    role = F.when(F.col("to") == USER, "user").when(F.col("to") == ASSISTANT, "assistant")
    kept = lines.where("pos IS NOT NULL").join(table.select("pos", "role", "text"), "pos").select(*KEY, "block", "at", F.coalesce(role, "role").alias("role"), "text")
    made = lines.where("pos IS NULL").select(*KEY, "block", "at", role.alias("role"), F.lit("").alias("text"))
    return Repaired(report, kept.unionByName(made))


def digests(turns: DataFrame) -> DataFrame:
    """(none, conv, sha256) of `role:text` of each conversation's turns, joined by line breaks.

    A digest is a chain over its whole input, so one task streams a conversation; it holds a batch and the digest only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        out: list[tuple] = []
        for batch in batches:
            for none, conv, role, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (none, conv) != key:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = (none, conv), hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if len(out) > 4000:
                yield rows_of(out)
                out = []
        if key is not None:
            out.append((*key, h.hexdigest()))
        yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.bool_(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["none", "conv", "sha256"])

    dealt = turns.repartition(*KEY).sortWithinPartitions(*KEY, "block", "at").select(*KEY, "role", "text")
    return dealt.mapInArrow(run, "none boolean, conv long, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text; nulls as one space) as the CRC-32 of `conv_id:turn` has it: dropped, emptied, cut, repeated or said by the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), STOPS, "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those of which no row is left have zeros and empty values."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = repair(damaged(rows))
    asked = rows.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv")).distinct()
    out = asked.join(done.report, KEY, "left").join(digests(done.turns), KEY, "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    return out.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), gaps.alias("gaps"), *(count(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
