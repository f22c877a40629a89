"""Connected components of a table of links: two rounds of contraction, then alternating large-star and small-star rounds.

Contraction sends every node to its smallest neighbour, which turns a densely linked group
into a few classes at once; star rounds finish long chains in few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import Scratch, dropped, shared_path


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v) with u > v, distinct. Both rounds keep what is connected; neighbours are never gathered in one row."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _contracted(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(labels, edges): each node's smallest neighbour, itself included, and the links (u > v) among those classes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    named = edges.join(labels.select(F.col("id").alias("u"), F.col("label").alias("x")), "u").join(labels.select(F.col("id").alias("v"), F.col("label").alias("y")), "v")
    return labels, scratch.put(named.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "joined")


def components(links: DataFrame, contractions: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id that links reach.

    Null ends and loops are ignored, repeated links count once; no links give no rows.
    Every round is a table in the shared folder; rounds end when none changes anything. The
    result reads tables that scratch keeps as labels and stars, for the caller to drop.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "joined")
    maps = []
    for _ in range(contractions):
        labels, edges = _contracted(edges, scratch)
        maps.append(labels)
    found = _star_components(edges, scratch)
    for labels in reversed(maps):
        # a class that no link leaves any more is its own component
        found = labels.join(found.select(F.col("id").alias("label"), "component"), "label", "left").select("id", F.coalesce("component", "label").alias("component"))
    return found


def _star_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    spark = edges.sparkSession
    path, state = "", None
    while True:
        edges.write.parquet(new := shared_path(spark, "stars"))
        edges = spark.read.schema("u long, v long").parquet(new)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if path:
            dropped(spark, path)
        if now == state:
            scratch.paths.setdefault("stars", []).append(new)
            break
        path, state = new, now
        edges = _stars(_stars(edges, small=False), small=True)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
