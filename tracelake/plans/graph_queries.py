"""Queries of the time index, fusion and the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from tracelake.operators import fusion as fu
from tracelake.operators import graph as gr
from tracelake.operators import timeindex as ti
from tracelake.operators import tracks as tr
from tracelake.plans.queries import _TRACKS, query
from tracelake.sources import adapters as ad

_FRAMES = """f AS (SELECT track_id AS video_id, frame_number, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 1.0 ELSE pts END AS pts FROM p)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    return p.select(F.col("track_id").alias("video_id"), "frame_number", F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, 1.0).otherwise(F.col("pts")).alias("pts"))


@query("tim1_repair_timestamps", f"""WITH RECURSIVE {ad.POINTS}, {_FRAMES}, r AS (
  SELECT video_id, frame_number, pts AS original_pts, CASE WHEN pts IS NULL THEN 0.0 ELSE pts END AS pts, CASE WHEN pts IS NULL THEN 'missing_start_pts' END AS why FROM f WHERE frame_number = 0
  UNION ALL
  SELECT f.video_id, f.frame_number, f.pts, CASE WHEN f.pts > r.pts THEN f.pts ELSE r.pts + 1.0 / 30 END, CASE WHEN f.pts IS NULL THEN 'missing_pts' WHEN f.pts > r.pts THEN NULL WHEN f.pts = r.pts THEN 'duplicate_pts' ELSE 'non_monotonic_pts' END
  FROM r JOIN f ON f.video_id = r.video_id AND f.frame_number = r.frame_number + 1)
SELECT video_id, frame_number, round(pts, 4) AS pts, why IS NOT NULL AS is_repaired, why AS repair_reason, original_pts FROM r""")
def tim1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.repair_timestamps(_frames(spark, sf_dir)).withColumn("pts", F.round("pts", 4))


@query("tim2_is_vfr", f"""WITH {ad.POINTS}, d AS (SELECT track_id AS video_id, pts - lag(pts) OVER (PARTITION BY track_id ORDER BY pts) AS d FROM p), k AS (
  SELECT video_id, d, row_number() OVER (PARTITION BY video_id ORDER BY d) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM d WHERE d > 1e-6
), md AS (SELECT video_id, d AS median_delta, n FROM k WHERE r = n // 2 + 1), dev AS (SELECT video_id, max(abs(d - median_delta)) AS md FROM k JOIN md USING (video_id) GROUP BY video_id), c AS (SELECT track_id AS video_id, count(*) AS n_frames FROM p GROUP BY 1)
SELECT video_id, n_frames, round(median_delta, 6) AS median_delta, round(md, 6) AS max_deviation, coalesce(n_frames >= 3 AND n >= 2 AND md / median_delta > 0.02, false) AS is_vfr FROM c LEFT JOIN md USING (video_id) LEFT JOIN dev USING (video_id)""")
def tim2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    out = ti.is_vfr(p.select(F.col("track_id").alias("video_id"), "frame_number", "pts"))
    return out.withColumn("median_delta", F.round("median_delta", 6)).withColumn("max_deviation", F.round("max_deviation", 6))


@query("tim3_frame_to_time", f"""WITH {ad.POINTS} SELECT q.track_id AS video_id, q.frame_number, p.pts, CASE WHEN p.pts IS NULL THEN 'frame_out_of_range' END AS error
FROM (SELECT track_id, frame_number + 5 AS frame_number FROM p) q LEFT JOIN p ON p.track_id = q.track_id AND p.frame_number = q.frame_number""")
def tim3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ad.trajectory_points(spark, sf_dir).select(F.col("track_id").alias("video_id"), "frame_number", "pts")
    return ti.frame_to_time(f.select("video_id", (F.col("frame_number") + 5).alias("frame_number")), f)


@query("tim4_time_to_frame", f"""WITH {ad.POINTS}, q AS (SELECT track_id, event_id AS query_id, pts + (event_id % 7) * 0.5 AS t FROM p), j AS (
  SELECT q.track_id AS video_id, query_id, t, p.frame_number, row_number() OVER (PARTITION BY query_id ORDER BY abs(p.pts - t), p.pts, p.frame_number) AS r, max(p.pts) OVER (PARTITION BY q.track_id, query_id) AS hi, min(p.pts) OVER (PARTITION BY q.track_id, query_id) AS lo FROM q JOIN p USING (track_id))
SELECT video_id, query_id, t, CASE WHEN t BETWEEN lo - 0.05 AND hi + 0.05 THEN frame_number END AS frame_number, CASE WHEN t NOT BETWEEN lo - 0.05 AND hi + 0.05 THEN 'time_out_of_range' END AS error FROM j WHERE r = 1""")
def tim4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    q = p.select(F.col("track_id").alias("video_id"), F.col("event_id").alias("query_id"), (F.col("pts") + (F.col("event_id") % 7) * 0.5).alias("t"))
    return ti.time_to_frame(q, p.select(F.col("track_id").alias("video_id"), "frame_number", "pts"))


@query("tim6_sample_frames", f"WITH {ad.POINTS} SELECT track_id AS video_id, frame_number, pts FROM p WHERE frame_number % 7 = 0")
def tim6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.sample_frames(ad.trajectory_points(spark, sf_dir).select(F.col("track_id").alias("video_id"), "frame_number", "pts"), n=7)


@query("tim7_thin", f"""WITH RECURSIVE {ad.POINTS}, k AS (
  SELECT track_id, pts, frame_number FROM p WHERE frame_number = 0
  UNION ALL
  SELECT p.track_id, p.pts, p.frame_number FROM k JOIN p ON p.track_id = k.track_id AND p.frame_number = (SELECT min(q.frame_number) FROM p q WHERE q.track_id = k.track_id AND q.pts - k.pts >= 5 - 1e-9 AND q.frame_number > k.frame_number))
SELECT track_id AS video_id, frame_number, pts FROM k""")
def tim7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.sample_frames(ad.trajectory_points(spark, sf_dir).select(F.col("track_id").alias("video_id"), "frame_number", "pts"), "min_gap", gap=5.0)


@query("tim8_scenes", f"""WITH {ad.POINTS}, v AS (SELECT track_id AS video_id, max(frame_number) + 1 AS total FROM p GROUP BY 1), c AS (SELECT track_id AS video_id, frame_number AS a FROM p WHERE event_id % 9 = 0 UNION SELECT video_id, 0 FROM v),
s AS (SELECT video_id, row_number() OVER w - 1 AS scene_index, a AS start_frame, greatest(a, coalesce(lead(a) OVER w, total) - 1) AS end_frame FROM c JOIN v USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY a))
SELECT s.video_id, scene_index, count(*) AS n_frames FROM s JOIN p ON p.track_id = s.video_id AND p.frame_number BETWEEN start_frame AND end_frame GROUP BY ALL""")
def tim8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir).withColumn("video_id", F.col("track_id"))
    videos = p.groupBy("video_id").agg((F.max("frame_number") + 1).alias("total_frames"))
    s = ti.scenes_from_cuts(p.where("event_id % 9 = 0").select("video_id", "frame_number"), videos)
    return ti.assign_scene(p.select("video_id", "frame_number"), s).groupBy("video_id", "scene_index").agg(F.count("*").alias("n_frames"))


# ---- fusion


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    e = ad.table(spark, sf_dir, "events").select("event_id", "event_type")
    return p.join(e, "event_id").select("video_id", F.col("event_id").alias("observation_id"), F.floor(F.col("pts") / 2).alias("frame_number"), "pts", F.col("event_type").alias("text"), F.lower("event_type").alias("normalized_text"), "confidence", "bbox")


@query("fus1_fuse_text")
def fus1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fu.fuse_text(_ocr(spark, sf_dir))
    return out.select("video_id", "observation_id", "text", "first_frame", "last_frame", F.size("supporting_observation_ids").alias("n"), F.round("confidence_summary.mean", 4).alias("mean_confidence"))


@query("fus2_fuse_transcripts", f"""WITH {ad.SEGMENTS}, q AS (SELECT video_id, segment_id, "start" AS a, "end" AS b, text, language FROM s), l AS (
  SELECT *, lag(b) OVER w AS pb, lag(text) OVER w AS pt, lag(language) OVER w AS pl FROM q WINDOW w AS (PARTITION BY video_id ORDER BY a, b, segment_id)
), i AS (SELECT *, sum(CASE WHEN coalesce(language = pl AND a - pb <= 0.5 AND (text = pt OR (a < pb AND (contains(text, pt) OR contains(pt, text)))), false) THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY a, b, segment_id) AS g FROM l)
SELECT video_id, min(segment_id) AS segment_id, min(a) AS "start", max(b) AS "end", arg_max(text, length(text) * 1000000 - segment_id) AS text, count(*) AS n_segments FROM i GROUP BY video_id, g""")
def fus2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.fuse_transcripts(ad.transcript_segments(spark, sf_dir)).select("video_id", "segment_id", "start", "end", "text", "n_segments")


@query("fus3_confidence_summary", f"WITH {ad.POINTS} SELECT video_id, round(avg(confidence), 4) AS mean, min(confidence) AS min, max(confidence) AS max, count(*) AS count FROM p GROUP BY video_id")
def fus3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.confidence_summary(ad.trajectory_points(spark, sf_dir), ["video_id"]).withColumn("mean", F.round("mean", 4))


# ---- graph: the star schema as a containment graph


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {n: ad.table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")}
    levels = [("region", "r_regionkey", "r_name", None, None), ("nation", "n_nationkey", "n_name", "region", "n_regionkey"), ("customer", "c_custkey", "c_name", "nation", "c_nationkey"), ("order", "o_orderkey", "o_orderstatus", "customer", "o_custkey")]
    nodes, edges = [], []
    for (kind, key, label, up, up_key), name in zip(levels, t, strict=True):
        df = t[name].withColumn("video_id", F.lit(0).cast("long"))
        nodes.append(gr.nodes_from(df, kind, key, F.col(label)))
        if up:
            edges.append(gr.edges_from(df, "CONTAINS", F.concat(F.lit(f"{up}:"), F.col(up_key).cast("string")), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))))
    return gr.union_all(*nodes), gr.union_all(*edges)


_GRAPH = """n AS (
  SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_type, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderstatus FROM orders
), e AS (
  SELECT 'CONTAINS:' || s || '->' || t AS edge_id, s, t FROM (
    SELECT 'region:' || n_regionkey AS s, 'nation:' || n_nationkey AS t FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)
)"""


@query("gra1_nodes", f"WITH {_GRAPH} SELECT node_id, node_type, label FROM n")
def gra1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].select("node_id", "node_type", "label")


@query("gra2_containment", f"WITH {_GRAPH} SELECT edge_id, s AS source_node_id, t AS target_node_id FROM e")
def gra2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1].select("edge_id", "source_node_id", "target_node_id")


@query("gra7_temporal_near", f"""WITH {ad.POINTS}, i AS (SELECT track_id, event_id, pts AS s, pts + value / 100 AS e FROM p)
SELECT a.track_id, 'event:' || a.event_id AS source_node_id, 'event:' || b.event_id AS target_node_id, round(greatest(b.s - a.e, 0), 4) AS actual_value
FROM i a JOIN i b ON a.track_id = b.track_id AND (a.s < b.s OR (a.s = b.s AND a.event_id < b.event_id)) AND a.s - 2 <= b.e AND b.s <= a.e + 2""")
def gra7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.temporal_edges(ad.intervals(spark, sf_dir), keys=("track_id",)).select("track_id", "source_node_id", "target_node_id", F.round("actual_value", 4).alias("actual_value"))


@query("gra8_overlap", f"""WITH {ad.POINTS}, d AS (SELECT video_id, floor(pts / 2) AS f, event_id AS id, x, y, w, h FROM p), j AS (
  SELECT a.video_id, a.id AS a_id, b.id AS b_id, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s FROM d a JOIN d b ON a.video_id = b.video_id AND a.f = b.f AND a.id < b.id)
SELECT video_id, 'detection:' || a_id AS source_node_id, 'detection:' || b_id AS target_node_id, round(i / (s - i), 4) AS actual_value FROM j WHERE i / (s - i) >= 0.1""")
def gra8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.overlap_edges(ad.detections(spark, sf_dir)).select("video_id", "source_node_id", "target_node_id", F.round("actual_value", 4).alias("actual_value"))


@query("gra9_zone_edges", f"""WITH {ad.POINTS}, {_TRACKS}, c AS (SELECT track_id, arg_min(x + w / 2, frame_number) AS x0, arg_min(y + h / 2, frame_number) AS y0, arg_max(x + w / 2, frame_number) AS x1, arg_max(y + h / 2, frame_number) AS y1 FROM p GROUP BY 1)
SELECT 'track:' || track_id AS source_node_id, 'zone:z1' AS target_node_id FROM c WHERE (x0 > 50 AND x0 <= 250 AND y0 > 50 AND y0 <= 250) OR (x1 > 50 AND x1 <= 250 AND y1 > 50 AND y1 <= 250)""")
def gra9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.plans.queries import _zones

    return gr.zone_edges(tr.track_table(ad.trajectory_points(spark, sf_dir)), _zones(spark).where("zone_id = 'z1'")).select("source_node_id", "target_node_id")


@query("gra10_query_nodes", f"WITH {_GRAPH} SELECT node_id, label FROM n WHERE node_type IN ('nation', 'region') AND contains(lower(label), 'a')")
def gra10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.query_nodes(_graph(spark, sf_dir)[0], types=["nation", "region"], label="A").select("node_id", "label")


@query("gra11_query_edges", f"WITH {_GRAPH} SELECT edge_id FROM e WHERE s = 'nation:3'")
def gra11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.query_edges(_graph(spark, sf_dir)[1], ["CONTAINS"], source="nation:3", min_confidence=0.5).select("edge_id")


@query("gra12_neighbors", f"WITH {_GRAPH}, i AS (SELECT node_id FROM n WHERE node_type = 'customer') SELECT DISTINCT node_id, other FROM (SELECT s AS node_id, t AS other FROM e UNION ALL SELECT t, s FROM e) JOIN i USING (node_id) WHERE other IN (SELECT node_id FROM n)")
def gra12(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return gr.neighbors(n, e, n.where("node_type = 'customer'"))


@query("gra13_find_paths", f"""WITH {_GRAPH} SELECT e1.s AS source, e3.t AS target, e1.edge_id || ' ' || e2.edge_id || ' ' || e3.edge_id AS path FROM e e1 JOIN e e2 ON e2.s = e1.t JOIN e e3 ON e3.s = e2.t WHERE e1.s LIKE 'region:%' AND e3.t LIKE 'order:%'""")
def gra13(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    o = ad.table(spark, sf_dir, "orders").join(ad.table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(ad.table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    pairs = o.select(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("target"))
    return gr.find_paths(e, pairs, 3).select("source", "target", F.array_join("path", " ").alias("path"))


@query("gra18_dangling", f"WITH {_GRAPH}, k AS (SELECT node_id FROM n WHERE node_type <> 'nation') SELECT edge_id, 'source' AS \"end\", s AS node_id FROM e WHERE s NOT IN (FROM k) UNION ALL SELECT edge_id, 'target', t FROM e WHERE t NOT IN (FROM k)")
def gra18(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return gr.dangling_edges(n.where("node_type <> 'nation'"), e)


@query("gra19_issues", f"""WITH {_GRAPH} SELECT 'orphan_node' AS issue, count(*) AS n FROM n WHERE node_id NOT IN (SELECT s FROM e UNION ALL SELECT t FROM e) HAVING count(*) > 0""")
def gra19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.graph_issues(*_graph(spark, sf_dir)).groupBy("issue").agg(F.count("*").alias("n"))


@query("gra20_metrics", f"WITH {_GRAPH} SELECT 0::BIGINT AS video_id, node_type AS type, count(*) AS n, 'node' AS what FROM n GROUP BY 2 UNION ALL SELECT 0, 'CONTAINS', count(*), 'edge' FROM e")
def gra20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.graph_metrics(*_graph(spark, sf_dir))


@query("prj2_iou_pairs", f"""WITH {ad.POINTS}, d AS (SELECT video_id, floor(pts / 2)::BIGINT AS frame_number, x, y, w, h, event_id FROM p)
SELECT a.video_id, a.event_id AS a, b.event_id AS b, round(sqrt(pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y + a.h / 2 - b.y - b.h / 2, 2)), 4) AS distance FROM d a JOIN d b ON a.video_id = b.video_id AND a.frame_number = b.frame_number AND a.event_id < b.event_id""")
def prj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.functions.exprs import cx, cy, point_distance, rounded
    from tracelake.functions.ordered import dealt_join

    b = F.col("bbox")
    d = ad.detections(spark, sf_dir).select("video_id", "frame_number", "detection_id", cx(b).alias("x"), cy(b).alias("y"))
    # centres are worked out once a box; a frame's boxes all meet, and crowded frames are many tasks
    p = dealt_join(d.toDF("video_id", "frame_number", "a", "ax", "ay"), d.toDF("video_id", "frame_number", "b", "bx", "by"), ["video_id", "frame_number"]).where("a < b")
    p = p.select("video_id", "a", "b", point_distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("d"))
    return p.select("video_id", "a", "b", rounded(F.col("d"), 4).alias("distance"))


@query("prj7_crop_boxes", f"""WITH {ad.POINTS}, c AS (
  SELECT event_id, w, h, greatest(floor(x - w * 0.1), 0) AS l, greatest(floor(y - h * 0.1), 0) AS t, least(ceil(x + w * 1.1), 400) AS r, least(ceil(y + h * 1.1), 300) AS b FROM p)
SELECT event_id, CASE WHEN r - l >= 2 AND b - t >= 2 THEN l END::BIGINT AS "left", CASE WHEN r - l >= 2 AND b - t >= 2 THEN b END::BIGINT AS bottom, CASE WHEN NOT (r - l >= 2 AND b - t >= 2) THEN 'crop_too_small' END AS reason FROM c""")
def prj7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.functions.exprs import crop_box

    c = crop_box(F.col("bbox"), F.lit(400.0), F.lit(300.0), F.lit(0.1))
    return ad.trajectory_points(spark, sf_dir).select("event_id", c.alias("c")).select("event_id", F.col("c.left").alias("left"), F.col("c.bottom").alias("bottom"), F.col("c.reason").alias("reason"))



