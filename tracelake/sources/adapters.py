"""Observation tables derived from the driver's star schema by plain arithmetic, and the same as SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.exprs import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectory_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per event: a user is a track, ten videos, seconds from 2024 on a coarse clock."""
    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("double")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        (F.col("user_id") % 10).alias("video_id"), F.col("user_id").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_number"),
        (F.floor(micros / 10_000_000).cast("double") / 1000.0).alias("pts"), box(F.col("value"), k * 5, 10 + F.col("event_id") % 40, 10 + F.col("event_id") % 30).alias("bbox"),
        ((F.col("event_id") % 100).cast("double") / 100.0).alias("confidence"), "event_id",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = trajectory_points(spark, sf_dir)
    return p.select("video_id", F.col("event_id").alias("detection_id"), F.floor(F.col("pts") / 2).alias("frame_number"), "pts", (F.col("track_id") % 5).cast("string").alias("class_name"), "bbox", "confidence", "track_id")


def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment per turn of a conversation."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 4.0
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("segment_id"), start.alias("start"), (start + 3 + (F.length("text") % 5) * 0.5).alias("end"), F.col("text"), F.col("role").alias("language"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-like intervals: one per event, as long as its value in hundredths of a second."""
    e = table(spark, sf_dir, "events")
    p = trajectory_points(spark, sf_dir).select("event_id", "pts", "video_id", "track_id", "confidence")
    return p.join(e.select("event_id", "event_type", "value"), "event_id").select("video_id", "event_id", "event_type", F.col("pts").alias("start"), (F.col("pts") + F.col("value") / 100).alias("end"), "track_id", "confidence")


#: The same tables for DuckDB.
POINTS = """p AS (
  SELECT user_id % 10 AS video_id, user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_number,
    ((epoch_us(ts) - 1704067200000000) // 10000000)::DOUBLE / 1000.0 AS pts, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 5 AS y,
    (10 + event_id % 40)::DOUBLE AS w, (10 + event_id % 30)::DOUBLE AS h, (event_id % 100)::DOUBLE / 100.0 AS confidence, event_id, event_type, value FROM events
)"""
SEGMENTS = """s AS (
  SELECT conv_id AS video_id, turn AS segment_id, turn * 4.0::DOUBLE AS "start", turn * 4.0::DOUBLE + 3 + (length(text) % 5) * 0.5::DOUBLE AS "end", text, role AS language FROM conversations
)"""
