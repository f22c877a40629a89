"""Evidence rows of events, tracks, texts and speech, in one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _evidence(df: DataFrame, kind: str, source: Column, at: Column, confidence: Column, description: Column, payload: Column, tags: list[Column], module: str) -> DataFrame:
    """The id is a digest of what the row is made from, so the same run makes the same evidence."""
    return df.select(
        "video_id", F.sha2(F.concat_ws("|", F.lit(kind), F.col("video_id").cast("string"), source.cast("string")), 256).alias("evidence_id"), F.lit(kind).alias("evidence_type"), F.lit(module).alias("source_module"), source.cast("string").alias("source_id"),
        at.alias("timestamp_seconds"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(1.0)))).alias("confidence"), description.alias("description"), F.to_json(payload).alias("raw_payload"), F.array_sort(F.array_distinct(F.array(F.lit(kind), *tags))).alias("tags"),
    )


def event_evidence(events: DataFrame) -> DataFrame:
    """events: video_id, event_id, event_type, start, end, confidence."""
    e = F.col("event_type")
    text = F.concat(F.replace(e, F.lit("_"), F.lit(" ")), F.format_string(" at %.2fs", "start"))
    return _evidence(events, "event", F.col("event_id"), F.col("start"), F.col("confidence"), text, F.struct("event_type", "start", "end"), [e], "events")


def track_evidence(tracks: DataFrame, summaries: DataFrame) -> DataFrame:
    j = tracks.join(summaries.select("video_id", "track_id", "displacement", "path_length", "direction"), ["video_id", "track_id"], "left")
    text = F.format_string("Track over %d frames from %.2fs to %.2fs", (F.col("last_frame") - F.col("first_frame") + 1).cast("long"), "first_seconds", "last_seconds")
    return _evidence(j, "track", F.col("track_id"), F.col("first_seconds"), F.col("confidence"), text, F.struct("displacement", "path_length", "direction"), [F.coalesce("direction", F.lit("still"))], "perception")


def text_evidence(texts: DataFrame) -> DataFrame:
    return _evidence(texts, "ocr", F.col("observation_id"), F.col("first_seconds"), F.col("confidence_summary.mean"), F.concat(F.lit("Text: "), F.col("text")), F.struct("first_frame", "last_frame"), [], "ocr")


def transcript_evidence(segments: DataFrame) -> DataFrame:
    c = F.col("confidence") if "confidence" in segments.columns else F.lit(None).cast("double")
    return _evidence(segments, "transcript", F.col("segment_id"), F.col("start"), c, F.concat(F.lit("Speech: "), F.col("text")), F.struct("start", "end"), [F.coalesce("language", F.lit("unknown"))], "audio")


def all_evidence(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
