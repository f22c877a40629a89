"""Tables held in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A path not taken yet in the folder of spark.checkpoint.dir, which driver and executors share.

    A local session without one gets a fresh one, on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    return f"{context._jsc.sc().getCheckpointDir().get().rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends, and a lost executor costs no recomputation.

    From then on each statement's shuffle files go when it ends, not when the driver happens to collect garbage.
    """
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = shared_folder(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(table: DataFrame) -> None:
    """Deletes the files of a held table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of links (a, b): the smallest node that links reach.

    Links are turned towards smaller nodes in rounds: first a node's larger neighbours go to its
    smallest one, then its smaller neighbours and itself do. Neighbours are never gathered in
    a row; rounds are few even for chains, and each is a table in the shared folder.
    """
    edges = held(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
        first = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = held(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        let_go(first)
