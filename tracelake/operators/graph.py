"""Evidence graph: nodes and edges from entity tables, lookups, paths, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.boxes import overlap_join
from tracelake.functions.exprs import cx, cy, edge_id, node_id
from tracelake.functions.ordered import range_join
from tracelake.functions.shared import held
from tracelake.functions.zones import points_in_zones

NEAR_SECONDS, MIN_OVERLAP = 2.0, 0.1


def nodes_from(df: DataFrame, kind: str, source: str, label: Column, start: Column | None = None, end: Column | None = None, confidence: Column | None = None, derivation: str = "observed") -> DataFrame:
    """Graph nodes of one entity table."""
    none = F.lit(None).cast("double")
    return df.select("video_id", node_id(kind, F.col(source)).alias("node_id"), F.lit(kind).alias("node_type"), F.col(source).cast("string").alias("source_id"), label.cast("string").alias("label"), (none if start is None else start).alias("timestamp_start"), (none if end is None else end).alias("timestamp_end"), (none if confidence is None else confidence).alias("confidence"), F.lit(derivation).alias("derivation"))


def edges_from(df: DataFrame, relation: str, source: Column, target: Column, derivation: str = "structural", confidence: Column | None = None) -> DataFrame:
    """Graph edges of one projection; source and target are node ids."""
    c = F.lit(1.0) if confidence is None else confidence
    return df.select("video_id", edge_id(F.lit(relation), source, target).alias("edge_id"), source.alias("source_node_id"), target.alias("target_node_id"), F.lit(relation).alias("relationship"), F.lit(derivation).alias("derivation"), c.alias("confidence"))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def containment_edges(scenes: DataFrame | None = None, zones: DataFrame | None = None, tracks: DataFrame | None = None, segments: DataFrame | None = None, frames: DataFrame | None = None, detections: DataFrame | None = None) -> DataFrame:
    """CONTAINS edges: a video its scenes, zones, tracks and segments; a scene (or the video) its frames; a frame its detections."""
    video = node_id("video", F.col("video_id"))
    out = [edges_from(df, "CONTAINS", video, node_id(kind, F.col(key))) for df, kind, key in ((scenes, "scene", "scene_id"), (zones, "zone", "zone_id"), (tracks, "track", "track_id"), (segments, "transcript", "segment_id")) if df is not None]
    if frames is not None:
        f = frames if "scene_id" in frames.columns else frames.withColumn("scene_id", F.lit(None).cast("string"))
        out.append(edges_from(f, "CONTAINS", F.when(F.col("scene_id").isNotNull(), node_id("scene", F.col("scene_id"))).otherwise(video), node_id("frame", F.col("frame_id"))))
        if detections is not None:
            there = detections.join(frames.select("frame_id").distinct(), "frame_id", "left_semi")
            out.append(edges_from(there, "CONTAINS", node_id("frame", F.col("frame_id")), node_id("detection", F.col("detection_id"))))
    return union_all(*out)


def membership_edges(tracks: DataFrame, detections: DataFrame) -> DataFrame:
    """BELONGS_TO edges from detections to the tracks (with detection_ids) that list them."""
    each = tracks.select("track_id", F.explode("detection_ids").alias("detection_id"))
    return edges_from(each.join(detections.select("video_id", "detection_id"), "detection_id"), "BELONGS_TO", node_id("detection", F.col("detection_id")), node_id("track", F.col("track_id")))


def participation_edges(events: DataFrame, tracks: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """PARTICIPATES_IN from tracks to events, OCCURS_IN from events to the zones they name."""
    each = events.select("video_id", "event_id", F.explode("participants").alias("track_id"))
    known = each.join(tracks.select("video_id", F.col("track_id").cast("string").alias("track_id")), ["video_id", "track_id"], "left_semi")
    out = edges_from(known, "PARTICIPATES_IN", node_id("track", F.col("track_id")), node_id("event", F.col("event_id")))
    if zones is None:
        return out
    named = events.join(zones.select("zone_id", "zone_name"), "zone_name")
    return out.unionByName(edges_from(named, "OCCURS_IN", node_id("event", F.col("event_id")), node_id("zone", F.col("zone_id"))))


def semantic_edges(semantic: DataFrame, events: DataFrame) -> DataFrame:
    """DERIVED_FROM from semantic events to their source events, SUPPORTS_SEMANTIC_EVENT back."""
    each = semantic.select("video_id", "semantic_event_id", F.explode("source_event_ids").alias("event_id")).join(events.select("event_id"), "event_id", "left_semi")
    s, e = node_id("semantic_event", F.col("semantic_event_id")), node_id("event", F.col("event_id"))
    return edges_from(each, "DERIVED_FROM", s, e, "semantic").unionByName(edges_from(each, "SUPPORTS_SEMANTIC_EVENT", e, s, "semantic"))


def evidence_edges(evidence: DataFrame, events: DataFrame, frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """REFERENCES from evidence to its frame and track, SUPPORTED_BY from events to evidence; only to what exists."""
    ev = node_id("evidence", F.col("evidence_id"))
    a = edges_from(evidence.join(frames.select("frame_id").distinct(), "frame_id", "left_semi"), "REFERENCES", ev, node_id("frame", F.col("frame_id")))
    b = edges_from(evidence.join(tracks.select("track_id").distinct(), "track_id", "left_semi"), "REFERENCES", ev, node_id("track", F.col("track_id")))
    c = events.select("video_id", "event_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi")
    return union_all(a, b, edges_from(c, "SUPPORTED_BY", node_id("event", F.col("event_id")), ev))


def temporal_edges(events: DataFrame, near: float = NEAR_SECONDS, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """TEMPORALLY_NEAR from the earlier to the later of two events that overlap (ends included) or are at most near apart.

    PRECEDES and FOLLOWS hold for every ordered pair of a video; see ordered_pairs.
    """
    a = events.select(*keys, F.col("event_id").alias("a_id"), F.col("start").alias("a_start"), F.coalesce("end", "start").alias("a_end"))
    b = events.select(*keys, F.col("event_id").alias("b_id"), F.col("start").alias("b_start"), F.coalesce("end", "start").alias("b_end"))
    p = range_join(a, b, list(keys), ("a_start", "a_end"), ("b_start", "b_end"), near).where(F.struct("a_start", "a_id") < F.struct("b_start", "b_id"))
    gap = F.greatest(F.col("b_start") - F.col("a_end"), F.lit(0.0))
    s, t = node_id("event", F.col("a_id")), node_id("event", F.col("b_id"))
    return p.select(*keys, edge_id(F.lit("TEMPORALLY_NEAR"), s, t).alias("edge_id"), s.alias("source_node_id"), t.alias("target_node_id"), F.lit("TEMPORALLY_NEAR").alias("relationship"), F.lit(near).alias("threshold"), gap.alias("actual_value"))


def ordered_pairs(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """PRECEDES or FOLLOWS for the pairs (a_id, b_id) asked for; all pairs of a video are quadratic and not made."""
    e = events.select("event_id", F.col("start"), F.coalesce("end", "start").alias("end"))
    p = wanted.join(e.toDF("a_id", "a_start", "a_end"), "a_id").join(e.toDF("b_id", "b_start", "b_end"), "b_id")
    return p.select("a_id", "b_id", F.when(F.col("a_end") < F.col("b_start"), "PRECEDES").when(F.col("b_end") < F.col("a_start"), "FOLLOWS").alias("relationship")).where("relationship IS NOT NULL")


def overlap_edges(detections: DataFrame, threshold: float = MIN_OVERLAP) -> DataFrame:
    """SPATIALLY_OVERLAPS between detections of one frame, which meet by grid cells."""
    d = detections.select("video_id", "frame_number", "detection_id", "bbox")
    a, b = d.toDF("video_id", "frame_number", "a_id", "a_box"), d.toDF("video_id", "frame_number", "b_id", "b_box")
    p = overlap_join(a, b, ["video_id", "frame_number"], "a_box", "b_box", threshold, F.col("a_id") < F.col("b_id"))
    s, t = node_id("detection", F.col("a_id")), node_id("detection", F.col("b_id"))
    return p.select("video_id", edge_id(F.lit("SPATIALLY_OVERLAPS"), s, t).alias("edge_id"), s.alias("source_node_id"), t.alias("target_node_id"), F.lit("SPATIALLY_OVERLAPS").alias("relationship"), F.lit(threshold).alias("threshold"), F.col("iou").alias("actual_value"))


def zone_edges(tracks: DataFrame, zones: DataFrame) -> DataFrame:
    """OCCURS_IN from tracks to zones that hold the centre of their first or last box; any number of zones, met by grid cells."""
    centre = lambda b: F.struct(cx(F.col(b)).alias("x"), cy(F.col(b)).alias("y"))
    ends = tracks.withColumn("_c", F.explode(F.array(centre("start_bbox"), centre("end_bbox")))).withColumn("_x", F.col("_c.x")).withColumn("_y", F.col("_c.y")).drop("_c")
    z = points_in_zones(ends, zones, "_x", "_y").drop("_x", "_y").dropDuplicates(["video_id", "track_id", "zone_id"])
    return edges_from(z, "OCCURS_IN", node_id("track", F.col("track_id")), node_id("zone", F.col("zone_id")), "spatial")


def query_nodes(nodes: DataFrame, video_id=None, types: list[str] | None = None, source_ids: list[str] | None = None, start: float | None = None, end: float | None = None, label: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes by any of these; nodes without a time pass a time window; label is a substring in any case; a limit takes the first by node_id."""
    out = nodes if video_id is None else nodes.where(F.col("video_id") == video_id)
    out = out if types is None else out.where(F.col("node_type").isin(types))
    out = out if source_ids is None else out.where(F.col("source_id").isin(source_ids))
    out = out if start is None else out.where(F.coalesce(F.coalesce("timestamp_end", "timestamp_start") >= start, F.lit(True)))
    out = out if end is None else out.where(F.coalesce(F.col("timestamp_start") <= end, F.lit(True)))
    out = out if label is None else out.where(F.contains(F.lower("label"), F.lit(label.lower())))
    return out if limit is None else out.orderBy("node_id").limit(limit)


def query_edges(edges: DataFrame, relationships: list[str] | None = None, source: str | None = None, target: str | None = None, derivations: list[str] | None = None, min_confidence: float | None = None, limit: int | None = None) -> DataFrame:
    out = edges if relationships is None else edges.where(F.col("relationship").isin(relationships))
    out = out if source is None else out.where(F.col("source_node_id") == source)
    out = out if target is None else out.where(F.col("target_node_id") == target)
    out = out if derivations is None else out.where(F.col("derivation").isin(derivations))
    out = out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)
    return out if limit is None else out.orderBy("edge_id").limit(limit)


def incident_edges(edges: DataFrame, ids: DataFrame, direction: str = "both", relationships: list[str] | None = None) -> DataFrame:
    """Edges at each node of ids (node_id), with the node at the other end as `other`."""
    e = query_edges(edges, relationships)
    out = e.join(ids.select(F.col("node_id").alias("source_node_id")).distinct(), "source_node_id").select("*", F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("other"))
    into = e.join(ids.select(F.col("node_id").alias("target_node_id")).distinct(), "target_node_id").select("*", F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("other"))
    return {"out": out, "in": into}.get(direction) or out.unionByName(into)


def neighbors(nodes: DataFrame, edges: DataFrame, ids: DataFrame, direction: str = "both", relationships: list[str] | None = None) -> DataFrame:
    """(node_id, other): distinct neighbours that are nodes."""
    found = incident_edges(edges, ids, direction, relationships).select("node_id", "other").distinct()
    return found.join(nodes.select(F.col("node_id").alias("other")).distinct(), "other", "left_semi").select("node_id", "other")


#: Rows of one partition where found paths meet the pairs asked for.
PATH_ROWS = 200_000


def find_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 5, shortest_only: bool = False) -> DataFrame:
    """Every simple outbound path of up to max_depth edges for each pair (source, target), as an array of edge ids; empty where both are one.

    max_depth rounds of joins; the pairs and each round's partial paths are tables in the shared folder. Paths of all
    rounds meet the pairs in one join of as many partitions as their rows need, so no task holds more with more rows.
    """
    hop = edges.select(F.col("source_node_id").alias("at"), F.col("target_node_id").alias("next"), "edge_id")
    empty = F.array().cast("array<string>")
    pairs = held(pairs.select("source", "target").distinct())
    # paths grow from distinct sources, whatever the number of their targets
    part = pairs.select("source").distinct().select("source", F.col("source").alias("at"), F.array("source").alias("seen"), empty.alias("path"))
    found, rows = [], pairs.count()
    for _ in range(max_depth):
        part = part.join(hop, "at").where(~F.array_contains("seen", F.col("next"))).select("source", F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen"), F.concat("path", F.array("edge_id")).alias("path"))
        part = held(part)
        found.append(part.select("source", F.col("at").alias("target"), "path"))
        rows += part.count()
    out = pairs.where("source = target").select("source", "target", empty.alias("path"))
    if found:
        n = max(edges.sparkSession.sparkContext.defaultParallelism, -(-rows // PATH_ROWS))
        # planned sizes are those of compressed files, too low for a broadcast; pairs are distinct, and a semi join would be moved below the repartition
        asked = pairs.repartition(n, "source", "target").hint("merge")
        out = out.unionByName(union_all(*found).repartition(n, "source", "target").join(asked, ["source", "target"]))
    if shortest_only:
        out = out.withColumn("_m", F.min(F.size("path")).over(Window.partitionBy("source", "target"))).where(F.size("path") == F.col("_m")).drop("_m")
    return out


def trace_chain(edges: DataFrame, semantic_ids: DataFrame) -> DataFrame:
    """(start, level, node_id): semantic event, its events, their evidence, its frames and tracks."""

    def follow(level: DataFrame, relation: str) -> DataFrame:
        e = edges.where(F.col("relationship") == relation).select(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("next"))
        return level.join(e, "node_id").select("start", F.col("next").alias("node_id")).distinct()

    a = semantic_ids.select(F.col("node_id").alias("start"), "node_id").distinct()
    b = follow(a, "DERIVED_FROM")
    c = follow(b, "SUPPORTED_BY")
    d = follow(c, "REFERENCES")
    return union_all(*(x.withColumn("level", F.lit(n)) for x, n in ((a, "semantic_event"), (b, "event"), (c, "evidence"), (d, "source"))))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends that are no node: edge_id, end, node_id."""
    known = nodes.select("node_id").distinct()
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source_node_id").alias("node_id")), F.struct(F.lit("target").alias("end"), F.col("target_node_id").alias("node_id")))).alias("x")).select("edge_id", "x.*")
    return ends.join(known, "node_id", "left_anti").select("edge_id", "end", "node_id")


def graph_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, id): missing provenance, bad times, orphans, dangling and cross-video edges, confidences outside [0, 1]."""
    linked = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).distinct()
    where = nodes.select("node_id", "video_id").distinct()
    ends = edges.select("edge_id", "source_node_id", "target_node_id").join(where.toDF("source_node_id", "v1"), "source_node_id").join(where.toDF("target_node_id", "v2"), "target_node_id")
    bad = lambda df, issue, key, cond: df.where(cond).select(F.lit(issue).alias("issue"), F.col(key).alias("id"))
    outside = (F.col("confidence") < 0) | (F.col("confidence") > 1)
    return union_all(
        bad(nodes, "empty_provenance", "node_id", F.col("derivation").isNull() | (F.col("derivation") == "")),
        bad(nodes, "negative_time", "node_id", F.col("timestamp_start") < 0),
        bad(nodes, "inverted_time", "node_id", F.col("timestamp_end") < F.col("timestamp_start")),
        bad(nodes, "confidence_range", "node_id", outside),
        bad(edges, "confidence_range", "edge_id", outside),
        bad(nodes.where("node_type <> 'video'").join(linked, "node_id", "left_anti"), "orphan_node", "node_id", F.lit(True)),
        bad(dangling_edges(nodes, edges), "dangling_edge", "edge_id", F.lit(True)),
        bad(ends, "cross_video_edge", "edge_id", F.col("v1") != F.col("v2")),
    )


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges by video and type."""
    n = nodes.groupBy("video_id", F.col("node_type").alias("type")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    return n.unionByName(edges.groupBy("video_id", F.col("relationship").alias("type")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge")))
