"""Named lookups over a table of requests: tracks, objects, frames, evidence, scenes, graph nodes.

A request without a match keeps its row where it asks for one entity (found is false) and has
no row where it asks for a set. Repeated requests are answered each; null ids match nothing.
Rows of an entity table that repeat an id are all given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.keywords import keyword_matches
from tracelake.operators.lookups import lookup


def lookup_tracks(requests: DataFrame, tracks: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """requests (request_id, track_id) with the track (track_id, first_seconds, last_seconds, ...) and its duration, 2 decimals.

    A missing start counts as 0 and a missing end as the start. fallback: raw tracks of the same columns.
    """
    start = F.coalesce("first_seconds", F.lit(0.0))
    return lookup(requests, tracks, "track_id", fallback).withColumn("duration", F.when(F.col("found"), F.round(F.coalesce("last_seconds", start) - start, 2)))


def lookup_objects(requests: DataFrame, detections: DataFrame, tracks: DataFrame) -> DataFrame:
    """(request_id, kind, object_id, class_name) of requests (request_id, video_id, object_id, class_part).

    With an object_id: the detection of that id, else the track. Without: the video's
    detections whose class holds class_part in any case (all, if it is null or empty).
    """
    text = lambda c: F.col(c).cast("string")
    d = detections.select(F.col("video_id").alias("d_video"), text("detection_id").alias("d_id"), "class_name")
    named = requests.where("object_id IS NOT NULL").select("request_id", text("object_id").alias("object_id"))
    one = named.join(d, F.col("object_id") == F.col("d_id")).select("request_id", F.lit("detection").alias("kind"), "object_id", "class_name")
    t = tracks.select(text("track_id").alias("object_id"), "class_name")
    other = named.join(one.select("request_id", "object_id").distinct(), ["request_id", "object_id"], "left_anti").join(t, "object_id").select("request_id", F.lit("track").alias("kind"), "object_id", "class_name")
    free = requests.where("object_id IS NULL").select("request_id", F.col("video_id").alias("d_video"), F.lower(F.coalesce("class_part", F.lit(""))).alias("keyword"))
    named = keyword_matches(detections.select("class_name").distinct(), free.where("keyword <> ''"), "class_name")
    some = free.where("keyword <> ''").join(named, "keyword").join(d, ["d_video", "class_name"])
    many = some.select("request_id", F.lit("detection").alias("kind"), F.col("d_id").alias("object_id"), "class_name")
    whole = free.where("keyword = ''").join(d, "d_video").select("request_id", F.lit("detection").alias("kind"), F.col("d_id").alias("object_id"), "class_name")
    return one.unionByName(other).unionByName(many).unionByName(whole)


def lookup_frames(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames (frame_id, ...) that requests (request_id, frame_ids) list, each once."""
    return requests.select("request_id", F.explode("frame_ids").alias("frame_id")).distinct().join(frames, "frame_id")


def lookup_evidence(requests: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """The evidence (evidence_id, ...) of requests (request_id, evidence_id, event_id): of that id, else what the event (event_id, evidence_ids) cites."""
    own = requests.where("evidence_id IS NOT NULL").select("request_id", "evidence_id")
    of_event = requests.where("evidence_id IS NULL").select("request_id", "event_id").join(events.select("event_id", F.explode("evidence_ids").alias("evidence_id")), "event_id").select("request_id", "evidence_id")
    return own.unionByName(of_event).distinct().join(evidence, "evidence_id")


def lookup_scenes(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """requests (request_id, scene_id) with the scene (scene_id, start, end, ...) and its duration, 2 decimals."""
    return lookup(requests, scenes, "scene_id").withColumn("duration", F.round(F.col("end") - F.col("start"), 2))


def query_graph(requests: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """The first `limit` nodes by id for each of requests (request_id, video_id, node_type, label); a null node_type or label asks for any.

    label is a substring in any case. Requests that ask for the same are answered once: all parts of
    labels are searched in one pass over the nodes, so that a request meets only nodes that hold its
    part; those that ask for any label meet the first `limit` nodes of each type of their video.
    """
    r = requests.select("request_id", "video_id", F.col("node_type").alias("_type"), F.lower("label").alias("_part"))
    asked = r.where("video_id IS NOT NULL").select("video_id", "_type", "_part").distinct()
    fits = F.col("_type").isNull() | (F.col("_type") == F.col("node_type"))
    parts = asked.where("_part IS NOT NULL")
    named = keyword_matches(nodes, parts.select(F.col("_part").alias("keyword")), "label").withColumnRenamed("keyword", "_part").join(parts, ["video_id", "_part"]).where(fits)

    def first(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("node_id"))).where(F.col("_r") <= limit).drop("_r")

    free = asked.where("_part IS NULL").join(first(nodes, "video_id", "node_type"), "video_id").where(fits)
    found = first(named.unionByName(free), "video_id", "_type", "_part").withColumnsRenamed({"video_id": "_v", "_type": "_t", "_part": "_p"})
    met = r.join(found, (F.col("video_id") == F.col("_v")) & F.col("_type").eqNullSafe(F.col("_t")) & F.col("_part").eqNullSafe(F.col("_p")))
    return met.drop("_v", "_t", "_p", "_type", "_part")
