"""Time index of recordings: repair, frame rate tests, frame and time lookups, sampling, scenes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.ordered import ordered_fold, range_join, thin

VFR_TOLERANCE, OUT_OF_RANGE, MIN_STEP = 0.02, 0.05, 1e-6


def repair_timestamps(frames: DataFrame, default_fps: float = 30.0) -> DataFrame:
    """frames (video_id, frame_number, pts) with pts strictly increasing and not negative, and why a row was changed.

    Recordings without faults are told by a window and pass as they are; only the others
    run through the fold, where a repaired value feeds the next row.
    """
    w = Window.partitionBy("video_id").orderBy("frame_number")
    known = F.col("pts").isNotNull() & ~F.isnan("pts")
    fault = ~known | (F.col("pts") < 0) | (F.col("pts") <= F.lag("pts").over(w))
    marked = frames.select("video_id", "frame_number", "pts").withColumn("_fault", F.coalesce(fault, F.lit(False)))
    bad = marked.where("_fault").select("video_id").distinct()
    fine = marked.join(bad, "video_id", "left_anti").select("video_id", "frame_number", "pts", F.lit(False).alias("is_repaired"), F.lit(None).cast("string").alias("repair_reason"), F.col("pts").alias("original_pts"))
    gap = 1.0 / default_fps

    def step(last, row):
        pts = None if row.pts is None or math.isnan(row.pts) else row.pts
        if pts is None:
            new, why = (0.0, "missing_start_pts") if last is None else (last + gap, "missing_pts")
        elif last is None:
            new, why = (pts, None) if pts >= 0 else (0.0, "non_monotonic_pts")
        elif pts > last:
            new, why = pts, None
        else:
            new, why = last + gap, "duplicate_pts" if pts == last else "non_monotonic_pts"
        return new, [(row.video_id, row.frame_number, new, why is not None, why, pts)]

    schema = "video_id long, frame_number long, pts double, is_repaired boolean, repair_reason string, original_pts double"
    fixed = ordered_fold(marked.join(bad, "video_id", "left_semi").select("video_id", "frame_number", "pts"), ["video_id"], ["frame_number"], lambda: None, step, schema)
    return fine.unionByName(fixed)


def is_vfr(frames: DataFrame, tolerance: float = VFR_TOLERANCE) -> DataFrame:
    """video_id, n_frames, median_delta (upper), max_deviation, is_vfr: whether a gap departs from the median by over tolerance of it."""
    w = Window.partitionBy("video_id").orderBy("pts")
    delta = frames.where("pts IS NOT NULL").select("video_id", (F.col("pts") - F.lag("pts").over(w)).alias("d"))
    counts = frames.where("pts IS NOT NULL").groupBy("video_id").agg(F.count("*").alias("n_frames"))
    ranked = delta.where(F.col("d") > MIN_STEP).select("video_id", "d", F.row_number().over(Window.partitionBy("video_id").orderBy("d")).alias("r"), F.count("*").over(Window.partitionBy("video_id")).alias("n"))
    median = ranked.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("video_id", F.col("d").alias("median_delta"), "n")
    worst = ranked.join(median.select("video_id", "median_delta"), "video_id").groupBy("video_id").agg(F.max(F.abs(F.col("d") - F.col("median_delta"))).alias("max_deviation"))
    out = counts.join(median, "video_id", "left").join(worst, "video_id", "left")
    enough = (F.col("n_frames") >= 3) & (F.col("n") >= 2)
    return out.select("video_id", "n_frames", "median_delta", "max_deviation", F.coalesce(enough & (F.col("max_deviation") / F.col("median_delta") > tolerance), F.lit(False)).alias("is_vfr"))


def frame_to_time(queries: DataFrame, frames: DataFrame) -> DataFrame:
    """queries (video_id, frame_number) with pts, and an error where the frame is not in the table."""
    out = queries.join(frames.select("video_id", "frame_number", "pts"), ["video_id", "frame_number"], "left")
    return out.withColumn("error", F.when(F.col("pts").isNull(), "frame_out_of_range"))


def time_to_frame(queries: DataFrame, frames: DataFrame, slack: float = OUT_OF_RANGE) -> DataFrame:
    """queries (video_id, query_id, t) with the nearest frame, the earlier of two as near; an error beyond slack of the recording.

    One union and two windows: the last frame before a query and the first after it. Of frames with
    one time the first by number stands for all.
    """
    frames = frames.groupBy("video_id", "pts").agg(F.min("frame_number").alias("frame_number"))
    f = frames.select("video_id", F.col("pts").alias("t"), F.lit(None).cast("long").alias("query_id"), F.struct("pts", "frame_number").alias("f"))
    q = queries.select("video_id", F.col("t").cast("double").alias("t"), F.col("query_id").cast("long").alias("query_id"), F.lit(None).cast("struct<pts:double,frame_number:long>").alias("f"))
    w = Window.partitionBy("video_id").orderBy("t", F.col("f").isNull(), "f.frame_number")
    both = f.unionByName(q).select("*", F.last("f", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.first("f", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("b"), F.min("f").over(Window.partitionBy("video_id")).alias("lo"), F.max("f").over(Window.partitionBy("video_id")).alias("hi"))
    nearer = F.when(F.col("b").isNull() | (F.col("t") - F.col("a.pts") <= F.col("b.pts") - F.col("t")), F.col("a")).otherwise(F.col("b"))
    out = F.when((F.col("t") < F.col("lo.pts") - slack) | (F.col("t") > F.col("hi.pts") + slack) | F.col("lo").isNull(), "time_out_of_range")
    return both.where("query_id IS NOT NULL").select("video_id", "query_id", "t", nearer.alias("f"), out.alias("error")).select("video_id", "query_id", "t", F.when(F.col("error").isNull(), F.col("f.frame_number")).alias("frame_number"), "error")


def timing_plan(videos: DataFrame) -> DataFrame:
    """Which index a recording uses: explicit stamps, an exact scan, or a constant rate; CFR without a rate falls back to exact."""
    fps = F.col("fps").isNotNull() & (F.col("fps") > 0)
    plan = F.when(F.col("has_explicit_pts"), "explicit").when((F.col("timing_mode") == "exact") | F.coalesce("is_vfr", F.lit(False)) | ~fps, "exact").otherwise("cfr")
    return videos.withColumn("timing_plan", plan)


def sample_frames(frames: DataFrame, strategy: str = "every_nth", n: int = 10, gap: float = 1.0, scenes: DataFrame | None = None, detections: DataFrame | None = None) -> DataFrame:
    """Frames to read: all, every_nth, min_gap, scene_boundary, or with_detections (every_nth in recordings without any)."""
    if strategy == "all":
        return frames
    if strategy == "every_nth":
        return frames.where(F.col("frame_number") % n == 0)
    if strategy == "min_gap":
        return thin(frames.select("video_id", "frame_number", "pts"), ["video_id"], "pts", ["frame_number"], gap)
    if strategy == "scene_boundary":
        return frames.join(scenes.select("video_id", F.col("start_frame").alias("frame_number")).distinct(), ["video_id", "frame_number"], "left_semi")
    if strategy == "with_detections":
        hit = frames.join(detections.select("video_id", "frame_number").distinct(), ["video_id", "frame_number"], "left_semi")
        return hit.unionByName(frames.join(detections.select("video_id").distinct(), "video_id", "left_anti").where(F.col("frame_number") % n == 0))
    raise ValueError(f"unknown strategy {strategy}")


def scenes_from_cuts(cuts: DataFrame, videos: DataFrame) -> DataFrame:
    """Scenes between cuts (video_id, frame_number of a scene's first frame); a recording without cuts is one scene. videos: video_id, total_frames."""
    starts = cuts.select("video_id", "frame_number").unionByName(videos.select("video_id", F.lit(0).cast("long").alias("frame_number"))).distinct()
    w = Window.partitionBy("video_id").orderBy("start_frame")
    s = starts.join(videos.select("video_id", "total_frames"), "video_id").where("frame_number < total_frames OR frame_number = 0").withColumnRenamed("frame_number", "start_frame")
    return s.select("video_id", (F.row_number().over(w) - 1).alias("scene_index"), "start_frame", F.greatest("start_frame", F.coalesce(F.lead("start_frame").over(w), "total_frames") - 1).alias("end_frame"))


def assign_scene(frames: DataFrame, scenes: DataFrame) -> DataFrame:
    """frames with the scene_index that holds them."""
    f = frames.withColumn("_f", F.col("frame_number"))
    return range_join(f, scenes, ["video_id"], ("frame_number", "_f"), ("start_frame", "end_frame"), bucket=500.0).drop("_f", "start_frame", "end_frame")
