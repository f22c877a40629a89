"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. The graph starts from random hyperplane cells and is improved
by rounds of joins of neighbours of neighbours: the neighbours of a node, and those that
have it as a neighbour, are each other's candidates. A pair is compared only if one of its
two edges is new, and leaves the comparison only if it is nearer than what its node has;
rounds end when few edges change. A search walks from entry points along edges and ends
with exact distances on the given vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import bounded_batches, dropped, lean, shared_path, staged

NEIGHBOURS, REVERSE, ROUNDS, TREES, CELL = 28, 28, 12, 6, 200
#: Rounds end when fewer than this share of all edges is new.
FEW = 0.01
BEAM, EXPAND, SEEDS, MAX_HOPS = 320, 40, 320, 60
TOP = 10
#: Nodes that one worker call takes at a time, about.
GROUP = 1500


def usable(vectors: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """(id, vec) of rows with an id whose vector is not null or zero and has finite components only; doubles stay doubles, -0 is 0."""
    kind = "array<double>" if "double" in dict(vectors.dtypes)["embedding"] else "array<float>"
    v = vectors.select(F.col(id_column).cast("long").alias(id_column), F.col("embedding").cast(kind).alias("vec")).where(F.col(id_column).isNotNull() & F.col("vec").isNotNull())
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0))
    return v.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(kind))


def nodes_of(vectors: DataFrame, top: int = TOP) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, members, n): nodes (node, vec, first) are the distinct usable vectors and the smallest id of each, members (node, vec_id) the top + 1 smallest ids of each.

    Usable vectors have the most frequent length too.
    """
    v = usable(vectors)
    size = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    v = v.where(F.size("vec") == (size.n if size else 0)).withColumn("node", F.xxhash64("vec"))
    # the smallest ids of a node in two steps, so that a vector that many rows hold is no single group
    near = Window.partitionBy("node", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    few = v.select("node", "vec_id").distinct().withColumn("r", F.row_number().over(near)).where(F.col("r") <= top + 1).select("node", "vec_id")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= top + 1).select("node", "vec_id")
    nodes = staged(v.groupBy("node").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("first")), "nodes")
    return nodes, staged(few, "node-ids"), nodes.count()


def _codes_of(nodes: DataFrame) -> DataFrame:
    """(node, code): vectors as the bytes of float32, all divided by one power of two so that squares stay finite."""
    top = nodes.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 1.0
    scale = math.ldexp(1.0, -math.frexp(top)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            codes = (x * scale).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "code"])

    return nodes.select("node", "vec").mapInArrow(lean(run), "node long, code binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float32).reshape(len(parts), -1).astype(np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.maximum(d, 0)


def _best(u: np.ndarray, v: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Positions of each u's k smallest d over distinct v."""
    order = np.lexsort((v, d, u))
    u, v = u[order], v[order]
    same = np.zeros(len(u), bool)
    by_pair = np.lexsort((np.arange(len(u)), v, u))
    same[by_pair[1:]] = (u[by_pair][1:] == u[by_pair][:-1]) & (v[by_pair][1:] == v[by_pair][:-1])
    order, u = order[~same], u[~same]
    first = np.concatenate(([True], u[1:] != u[:-1])) if len(u) else np.zeros(0, bool)
    rank = np.arange(len(u)) - np.maximum.accumulate(np.where(first, np.arange(len(u)), 0))
    return order[rank < k]


def _pairs(u: list[np.ndarray], v: list[np.ndarray], d: list[np.ndarray], k: int) -> pa.Table:
    u, v, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((u, np.int64), (v, np.int64), (d, np.float64)))
    best = _best(u, v, d, k)
    return pa.table({"u": pa.array(u[best], pa.int64()), "v": pa.array(v[best], pa.int64()), "d": pa.array(d[best], pa.float64())})


def _cell_pairs(table: pa.Table, k: int) -> pa.Table:
    """The k nearest others of every node within its cell: rows (cell, node, code)."""
    keys, ids, x = table.column("cell").to_numpy(), table.column("node").to_numpy(), _matrix(table.column("code"))
    us, vs, ds = [], [], []
    order = np.lexsort((ids, keys))
    for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        if len(part) > 1:
            d = _distances(x[part], x[part])
            np.fill_diagonal(d, np.inf)
            kk = min(k, len(part) - 1)
            at = np.argpartition(d, kk - 1, axis=1)[:, :kk]
            us.append(np.repeat(ids[part], kk))
            vs.append(ids[part][at].ravel())
            ds.append(np.take_along_axis(d, at, axis=1).ravel())
    return _pairs(us, vs, ds, k)


def _round_pairs(table: pa.Table, k: int) -> pa.Table:
    """For rows (centre, node, new, worst, code): pairs (u, v, d) of a centre's nodes, one of them new to it, with d below u's worst; the k nearest of each u."""
    keys, ids, worst = (table.column(c).to_numpy() for c in ("centre", "node", "worst"))
    new, x = np.array(table.column("new").to_pylist(), bool), _matrix(table.column("code"))
    us, vs, ds = [], [], []
    order = np.lexsort((ids, keys))
    for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        own = ids[part]
        if len(part) < 2 or not new[part].any():
            continue
        d = _distances(x[part], x[part])
        a, b = np.nonzero((d < worst[part][:, None]) & (new[part][:, None] | new[part][None, :]) & (own[:, None] != own[None, :]))
        us.append(own[a])
        vs.append(own[b])
        ds.append(d[a, b])
    return _pairs(us, vs, ds, k)


def _topk(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k nearest distinct neighbours; an edge is new (1) unless it was there before."""
    edges = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    w = Window.partitionBy("u").orderBy("d", "v")
    return edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("u", "v", "d", "new")


def start_graph(codes: DataFrame, n: int, k: int, trees: int, cell: int) -> DataFrame:
    """Edges (u, v, d) among the nodes of a cell; cells are sides of random hyperplanes, over-full ones parted by a hash."""
    dim = len(codes.first().code) // 4
    bits = max(0, math.ceil(math.log2(max(n, 1) / cell)))
    planes = np.random.default_rng(5).normal(size=(trees, max(bits, 1), dim)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            for t in range(trees):
                side = (x @ planes[t].T.astype(np.float64) > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(side * trees + t), b.column(0), b.column(1)], ["cell", "node", "code"])

    cells = staged(codes.mapInArrow(run, "cell long, node long, code binary"), "cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / (3 * cell)).alias("parts"))
    rows = cells.join(sizes, "cell").withColumn("cell", F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.col("parts"))))
    groups = max(1, n * trees // GROUP)
    each = rows.groupBy(F.pmod("cell", F.lit(groups)).alias("g")).applyInArrow(lambda t: _cell_pairs(t, k), "u long, v long, d double")
    return _topk(each.withColumn("new", F.lit(1)), k)


def improved(graph: DataFrame, codes: DataFrame, n: int, k: int, reverse: int) -> DataFrame:
    """One round of NN-descent over edges (u, v, d, new).

    A node's neighbours, up to `reverse` of the nodes that have it as one (new ones first)
    and the node itself are compared with each other, but for pairs of two that were so
    compared before. A node that has been nobody's new neighbour takes part no more.
    """
    w = Window.partitionBy("v").orderBy(F.desc("new"), F.xxhash64("u", "v"))
    back = graph.withColumn("r", F.row_number().over(w)).where(F.col("r") <= reverse).select(F.col("v").alias("centre"), F.col("u").alias("node"), "new")
    around = graph.select(F.col("u").alias("centre"), F.col("v").alias("node"), "new").unionByName(back).groupBy("centre", "node").agg(F.max("new").alias("new"))
    active = around.where("new = 1").select("centre").distinct()
    around = around.join(active, "centre", "left_semi").unionByName(active.select("centre", F.col("centre").alias("node"), F.lit(0).alias("new")))
    # what a node's neighbours have to beat goes with its code
    worst = graph.groupBy("u").agg(F.max("d").alias("worst"), F.count("*").alias("have"))
    limit = F.when(F.col("have") >= k, F.col("worst")).otherwise(F.lit(float("inf")))
    known = codes.join(worst.withColumnRenamed("u", "node"), "node", "left").select("node", "code", F.coalesce(limit, F.lit(float("inf"))).alias("worst"))
    rows = around.join(known, "node").select("centre", "node", (F.col("new") == 1).alias("new"), "worst", "code")
    groups = max(1, n // 300)
    found = rows.groupBy(F.pmod(F.xxhash64("centre"), F.lit(groups)).alias("g")).applyInArrow(lambda t: _round_pairs(t, k), "u long, v long, d double")
    return _topk(graph.withColumn("new", F.lit(0)).unionByName(found.withColumn("new", F.lit(1))), k)


def neighbour_graph(nodes: DataFrame, n: int, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS, trees: int = TREES, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(codes, graph): vectors as bytes, and edges (u, v, d) to each node's nearest found."""
    spark = nodes.sparkSession
    codes = staged(_codes_of(nodes), "codes")
    kind, path = "u long, v long, d double, new int", shared_path(spark, "graph")
    start_graph(codes, n, k, trees, cell).write.parquet(path)
    for _ in range(rounds):
        improved(spark.read.schema(kind).parquet(path), codes, n, k, reverse).write.parquet(new := shared_path(spark, "graph"))
        dropped(spark, path)
        path = new
        changed, edges = spark.read.schema(kind).parquet(path).agg(F.sum("new"), F.count("*")).first()
        if not edges or changed < FEW * edges:
            break
    return codes, spark.read.schema(kind).parquet(path)


def search(codes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, expand: int = EXPAND, seeds: int = SEEDS) -> DataFrame:
    """(query, node) pairs: the `beam` nearest nodes that a greedy walk from each query's entry points finds.

    queries: (query, node, code), node being the query's own where it is one. Entry points
    are a fixed number of nodes chosen by hash, and the own node. In every round each query
    expands its nearest unexpanded nodes; rounds end when no query has any among its beam.
    """
    spark = codes.sparkSession
    back = graph.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))).where(F.col("r") <= REVERSE).select(F.col("v").alias("u"), F.col("u").alias("v"))
    links = staged(graph.select("u", "v").unionByName(back).groupBy("u").agg(F.collect_set("v").alias("to")), "links")
    first = codes.orderBy(F.xxhash64("node")).limit(seeds).collect()
    seed_ids, seed_codes = [r.node for r in first], [bytes(r.code) for r in first]
    state_kind = "query long, code binary, ids array<long>, ds array<double>, done array<boolean>"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.frombuffer(b"".join(seed_codes), np.float32).reshape(len(seed_codes), -1).astype(np.float64)
        for b in batches:
            d = _distances(_matrix(b.column(2)), y)
            ids, ds = [], []
            for own, row in zip(b.column(1).to_pylist(), d, strict=True):
                near = np.argsort(row, kind="stable")[:beam].tolist()
                own_first = [(own, 0.0)] if own is not None else []
                pairs = own_first + [(seed_ids[j], float(row[j])) for j in near if seed_ids[j] != own]
                ids.append([p[0] for p in pairs])
                ds.append([p[1] for p in pairs])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.list_(pa.int64())), pa.array(ds, pa.list_(pa.float64())), pa.array([[False] * len(i) for i in ids], pa.list_(pa.bool_()))], ["query", "code", "ids", "ds", "done"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for query, code, ids, ds, done, asked, found in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                held = dict(zip(ids, zip(ds, done, strict=True), strict=True))
                for i in asked or ():
                    held[i] = (held[i][0], True)
                new = {r["v"]: r["vcode"] for r in found or ()}
                if new:
                    x = np.frombuffer(b"".join(new.values()), np.float32).reshape(len(new), -1).astype(np.float64)
                    d = _distances(np.frombuffer(code, np.float32).astype(np.float64)[None, :], x)[0]
                    held.update(zip(new, ((float(z), False) for z in d), strict=True))
                best = sorted(held, key=lambda i: (held[i][0], i))[:beam]
                out.append((query, code, best, [held[i][0] for i in best], [held[i][1] for i in best]))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["query", "code", "ids", "ds", "done"])

    path = shared_path(spark, "beam")
    queries.select("query", "node", "code").mapInArrow(begin, state_kind).write.parquet(path)
    for _ in range(MAX_HOPS):
        state = spark.read.schema(state_kind).parquet(path)
        wanted = F.slice(F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"]), 1, expand)
        if not state.where(F.size(wanted) > 0).limit(1).count():
            break
        asked = state.select("query", "ids", wanted.alias("w")).select("query", "ids", F.col("w.ids").alias("asked"))
        # neighbours that a query does not hold yet, each once, fetch their codes
        met = asked.select("query", F.explode("asked").alias("u")).join(links, "u").select("query", F.explode("to").alias("v")).distinct()
        met = met.join(state.select("query", "ids"), "query").where(~F.array_contains("ids", F.col("v"))).select("query", "v")
        found = met.join(codes.select(F.col("node").alias("v"), F.col("code").alias("vcode")), "v").groupBy("query").agg(F.collect_list(F.struct("v", "vcode")).alias("found"))
        moved = state.join(asked.select("query", "asked"), "query").join(found, "query", "left").select("query", "code", "ids", "ds", "done", "asked", "found")
        moved.mapInArrow(lean(step), state_kind).write.parquet(new := shared_path(spark, "beam"))
        dropped(spark, path)
        path = new
    return spark.read.schema(state_kind).parquet(path).select("query", F.explode("ids").alias("node"))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's `top` nearest found, by Euclidean distance in double precision.

    queries: rows of vectors; a row is no candidate of its own query. Rows without id, and
    vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, as query or candidate. Rows that repeat a vec_id are taken
    once if their vectors agree, else each vector under that id. Equal distances go to the
    smaller vec_id; with fewer candidates all are returned; an empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    nodes, members, n = nodes_of(vectors, top)
    kind = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], kind)
    codes, graph = neighbour_graph(nodes, n)
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("query"))
    asked = staged(asked.join(nodes.select(F.col("node").alias("query")), "query", "left_semi").distinct(), "asked")
    found = search(codes, graph, codes.join(asked.select(F.col("query").alias("node")).distinct(), "node").select(F.col("node").alias("query"), "node", "code"), max(beam, 3 * top))
    pairs = found.join(nodes, "node").join(nodes.select(F.col("node").alias("query"), F.col("vec").alias("qvec")), "query")
    score = F.sqrt(F.aggregate(F.zip_with("vec", "qvec", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0).cast("double"), lambda s, x: s + x))
    # the answer lies in the top + 1 first nodes by distance and smallest id, and in the top + 1 ids that are kept of each
    near = pairs.select("query", "node", "first", score.alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "first"))).where(F.col("r") <= top + 1)
    rows = near.join(members, "node").join(asked.select("query", "query_id"), "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
