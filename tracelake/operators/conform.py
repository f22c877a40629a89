"""Bringing observation rows into one shape: provenance, aliases, routing, crops, dataset contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.exprs import crop_box, normalize_ocr

#: Old column names and what they are called now.
ALIASES = {"timestamp_seconds": "pts", "start_time": "start", "end_time": "end", "source": "provider", "class_label": "class_name"}


def conform(df: DataFrame, fps: float = 30.0) -> DataFrame:
    """Renames old columns, derives a missing pts from the frame number with a note, and normalized_text from text."""
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
        elif old in df.columns:
            df = df.withColumn(new, F.coalesce(new, old)).drop(old)
    if "frame_number" in df.columns:
        pts = F.col("pts") if "pts" in df.columns else F.lit(None).cast("double")
        df = df.withColumn("timestamp_source", F.when(pts.isNotNull(), "given").otherwise("derived")).withColumn("pts", F.coalesce(pts, F.col("frame_number") / fps))
    if "text" in df.columns:
        own = F.col("normalized_text") if "normalized_text" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("normalized_text", F.coalesce(own, normalize_ocr(F.col("text"))))
    return df


def route(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """df (language, script) with the provider of a small rule table (kind: language or script, value, provider): by language, then script, then default."""
    by = lambda kind, name: F.broadcast(rules.where(F.col("kind") == kind).select(F.col("value").alias(kind), F.col("provider").alias(name)))
    j = df.join(by("language", "_l"), "language", "left").join(by("script", "_s"), "script", "left")
    return j.withColumn("provider", F.coalesce("_l", "_s", F.lit(default))).drop("_l", "_s")


def bundle_crops(candidates: DataFrame, keyframes: DataFrame, points: DataFrame, width: float, height: float, margin: float = 0.1, most: int = 6) -> DataFrame:
    """Crops of a candidate's tracks at its keyframes, `most` of them by position and track. candidates: video_id, candidate_id, track_ids; keyframes: video_id, candidate_id, position, frame_number."""
    who = candidates.select("video_id", "candidate_id", F.explode("track_ids").alias("track_id"))
    hit = who.join(keyframes, ["video_id", "candidate_id"]).join(points.select("video_id", "track_id", "frame_number", "bbox"), ["video_id", "track_id", "frame_number"])
    c = hit.withColumn("crop", crop_box(F.col("bbox"), F.lit(width), F.lit(height), F.lit(margin))).where("crop.reason IS NULL")
    w = Window.partitionBy("video_id", "candidate_id").orderBy("position", "track_id")
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r", "bbox")


def contract_issues(status: DataFrame, intervals: DataFrame, qa: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, issue): items against status, intervals against duration, answers against answerable, repeated videos.

    status: video_id, modality, status, n; intervals: video_id, start, end; qa: video_id, is_answerable, reference_answer; videos: video_id, duration_seconds.
    """
    out = [
        status.where("status IN ('not_annotated', 'not_applicable') AND coalesce(n, 0) > 0").select("video_id", F.lit("items_without_annotation").alias("issue")),
        status.where("status = 'annotated' AND n IS NULL").select("video_id", F.lit("annotated_without_items").alias("issue")),
        intervals.where("end < start OR start < 0").select("video_id", F.lit("bad_interval").alias("issue")),
        intervals.join(videos, "video_id").where(F.col("end") > F.col("duration_seconds") + 0.5).select("video_id", F.lit("after_the_end").alias("issue")),
        qa.where("is_answerable AND coalesce(trim(reference_answer), '') = ''").select("video_id", F.lit("answer_missing").alias("issue")),
        videos.groupBy("video_id").count().where("count > 1").select("video_id", F.lit("repeated_video").alias("issue")),
    ]
    return reduce(DataFrame.unionByName, out)
