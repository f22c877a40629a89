"""Families of near copies: the Jaccard join of sets that mostly hold the same shingles, without a row for every pair.

A family has a leader, and a set of it is described by its difference from the leader's
set. The overlap of two sets of a family follows from these differences alone:
|A and B| = |L| - |L - A| - |L - B| + |(L - A) and (L - B)| + |(A - L) and (B - L)|. Blocks of sets are compared
with each other, a product of incidence matrices each, and what leaves a comparison is
each set's number of links and as many links as connect the same sets, not the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import Scratch, in_parts, lean

#: Sets of a block, and shingles that its sets hold together (one larger set is a block of its own), about.
FAMILY_BLOCK, FAMILY_SHINGLES = 256, 1 << 19
#: Columns of an incidence matrix at a time.
COLUMNS = 4096
#: Heads of a set's lists that may lead it.
CANDIDATES = 4


def leaders(lists: DataFrame, percent: int, close: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(set_id, leader, blocks, block) of the sets that a leader stands for, leaders of two sets or more only.

    lists: (token, set_id, n). The smallest set of a token's list is its head; close keeps
    the rows whose set_id and leader have near sketches. A set's leader is the smallest
    close one of the heads that most of its lists have, or else the head of at least half
    of its prefix. Then the lists name their smallest leader instead, so that families of
    the same copies become one and copies that share few lists with a head join them.
    Which leader a set has affects time and no result.
    """
    lists = lists.select("token", "set_id", "n")
    prefix = F.floor(F.col("n") * (100 - percent) / 100) + 1

    def named(heads: DataFrame) -> DataFrame:
        votes = lists.join(heads, "token").groupBy("set_id", "n", "leader").agg(F.count("*").alias("votes"))
        most = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "leader"))), 1, CANDIDATES)
        return votes.groupBy("set_id", "n").agg(most.alias("most"))

    first = scratch.put(named(lists.groupBy("token").agg(F.min("set_id").alias("leader"))), "heads")
    half = first.where(-2 * F.col("most")[0]["votes"] >= prefix).select("set_id", F.col("most")[0]["leader"].alias("half"))
    chosen = close(first.select("set_id", F.explode("most.leader").alias("leader"))).groupBy("set_id").agg(F.min("leader").alias("leader"))
    best = chosen.join(half, "set_id", "full").select("set_id", F.coalesce("leader", "half").alias("leader"))
    # a set that only stands for itself names no family
    best = scratch.put(best.join(best.groupBy("leader").agg(F.count("*").alias("k")).where("k > 1").select("leader"), "leader").select("set_id", "leader"), "first-leaders")
    again = named(lists.join(best, "set_id").groupBy("token").agg(F.min("leader").alias("leader")))
    moved = close(again.select("set_id", F.explode("most.leader").alias("leader"))).groupBy("set_id").agg(F.min("leader").alias("moved"))
    best = scratch.put(lists.select("set_id", "n").distinct().join(best, "set_id", "left").join(moved, "set_id", "left").select("set_id", "n", F.coalesce(F.least("leader", "moved"), "leader", "moved").alias("leader")).where("leader IS NOT NULL"), "leaders")
    sizes = best.groupBy("leader").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("k > 1")
    blocks = F.greatest(F.ceil(F.col("k") / FAMILY_BLOCK), F.ceil(F.col("total") / FAMILY_SHINGLES)).cast("int")
    return best.join(sizes.select("leader", blocks.alias("blocks")), "leader").select("set_id", "leader", "blocks", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("block"))


def packed(places: np.ndarray, of: int) -> bytes:
    """Places below `of` as a bit each, or as 4 bytes each where these are fewer."""
    if 32 * len(places) < of:
        return places.astype(np.uint32).tobytes()
    bits = np.zeros(of, np.uint8)
    bits[places] = 1
    return np.packbits(bits).tobytes()


def unpacked(data: bytes, n: int, of: int) -> np.ndarray:
    """The n places that packed has put away."""
    return np.frombuffer(data, np.uint32).astype(np.uint64) if 32 * n < of else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), count=of)).astype(np.uint64)


def differences(members: DataFrame, elements: DataFrame) -> DataFrame:
    """(leader, blocks, block, set_id, n, m, gaps, missing, extra): each set's and its leader's size, how many and (packed) which places of the leader's sorted elements a set lacks, and the elements that it alone of the two holds.

    members as of leaders, elements (set_id, elements) of all members and leaders. A
    leader's elements go to every block of its family, so that no family is one task.
    """
    heads = members.select("leader", "blocks").distinct().join(elements.select(F.col("set_id").alias("leader"), F.col("elements").alias("base")), "leader")
    heads = heads.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "base")
    rows = members.join(elements, "set_id").join(heads, ["leader", "block"]).select("leader", "blocks", "block", "set_id", "elements", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, gaps, missing, extra = [], [], [], [], []
            for own, base in zip(batch.column(4), batch.column(5), strict=True):
                own, base = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(base.as_buffer(), np.uint64)
                places = np.flatnonzero(np.isin(base, own, assume_unique=True, invert=True))
                n.append(len(own))
                m.append(len(base))
                gaps.append(len(places))
                missing.append(packed(places, len(base)))
                extra.append(np.setdiff1d(own, base, assume_unique=True).view(np.int64))
            counts = [pa.array(c, pa.int64()) for c in (n, m, gaps)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *counts, pa.array(missing, pa.binary()), pa.array(extra, pa.list_(pa.int64()))], [*batch.schema.names[:4], "n", "m", "gaps", "missing", "extra"])

    return rows.mapInArrow(lean(run), "leader long, blocks int, block int, set_id long, n long, m long, gaps long, missing binary, extra array<long>")


def recurring(deltas: DataFrame, scratch: Scratch) -> DataFrame:
    """deltas, with those elements in `extra` that another set of the family has too: what one set holds alone is in no intersection, and need not go to every block."""
    each = deltas.select("leader", "set_id", F.explode("extra").alias("e"))
    total, found = deltas.agg(F.sum(F.size("extra"))).first()[0] or 0, []
    for own in in_parts(each, "e", total):
        often = own.groupBy("leader", "e").agg(F.count("*").alias("k")).where("k > 1").select("leader", "e")
        found.append(scratch.put(own.join(often, ["leader", "e"]).groupBy("set_id").agg(F.collect_list("e").alias("e")), "extras"))
    again = reduce(DataFrame.unionByName, found).groupBy("set_id").agg(F.flatten(F.collect_list("e")).alias("_extra"))
    return deltas.join(again, "set_id", "left").withColumn("extra", F.coalesce("_extra", F.array().cast("array<long>"))).drop("_extra")


def common_counts(deltas: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements deltas[i] and deltas[j] share, for i in x and j in y."""
    sizes = np.array([len(d) for d in deltas], np.int64)
    flat, row = np.concatenate(deltas) if deltas else np.zeros(0, np.uint64), np.repeat(np.arange(len(deltas)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1  # an element that only one set holds is in no intersection
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        held = np.zeros((len(deltas), COLUMNS), np.float32)
        held[row[a:b], column[a:b] - start] = 1
        out += held[x] @ held[y].T
    return out.astype(np.int64)


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a symmetric matrix of links connects, one less than the nodes of each component."""
    todo, out = np.ones(len(adjacent), bool), []
    for start in range(len(adjacent)):
        if not todo[start]:
            continue
        todo[start], ahead = False, [start]
        while ahead:
            u = ahead.pop()
            new = np.flatnonzero(adjacent[u] & todo)
            todo[new] = False
            out += [(u, v) for v in new.tolist()]
            ahead += new.tolist()
    return out


def family_links(deltas: DataFrame, percent: int, boundary: int) -> DataFrame:
    """(a, b, k) rows: links between sets of a family that connect all that its links connect (k null), and numbers of links k of sets a (b null). deltas as of recurring.

    A pair counts if one of its sets is larger than the boundary. Each pair of blocks is a group of its own.
    """
    rows = deltas.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "n", "m", "gaps", "missing", "extra")

    def scan(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, ids, n, m, gaps = (table.column(c).to_numpy() for c in ("block", "set_id", "n", "m", "gaps"))
        missing = [unpacked(d.as_py(), k, m[0]) for d, k in zip(table.column("missing"), gaps.tolist(), strict=True)]
        extra = [np.array(e.as_py(), np.int64).view(np.uint64) for e in table.column("extra")]
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        overlap = m[0] - gaps[x][:, None] - gaps[y][None, :] + common_counts(missing, x, y) + common_counts(extra, x, y)
        link = ((100 + percent) * overlap >= percent * (n[x][:, None] + n[y][None, :])) & (np.maximum(n[x][:, None], n[y][None, :]) > boundary)
        adjacent = np.zeros((len(ids), len(ids)), bool)
        if i == j:
            np.fill_diagonal(link, False)
        adjacent[np.ix_(x, y)] = link
        adjacent |= adjacent.T
        pairs, k = forest(adjacent), adjacent.sum(axis=1)
        some = np.flatnonzero(k)
        ends = np.array(pairs, np.int64).reshape(-1, 2)
        a = np.concatenate((ids[ends[:, 0]], ids[some]))
        b = [*ids[ends[:, 1]].tolist(), *[None] * len(some)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "k": pa.array([*[None] * len(pairs), *k[some].tolist()], pa.int64())})

    return rows.groupBy("leader", "i", "j").applyInArrow(scan, "a long, b long, k long")
