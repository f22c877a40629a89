"""Queries over the derived observation tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.exprs import node_id, rect_zone
from tracelake.operators import events as ev
from tracelake.operators import tracks as tr
from tracelake.sources import adapters as ad

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- tracks

_TRACKS = """t AS (
  SELECT video_id, track_id, min(frame_number) AS first_frame, max(frame_number) AS last_frame, min(pts) AS first_seconds, max(pts) AS last_seconds, round(avg(confidence), 4) AS confidence, count(*) AS n_points FROM p GROUP BY ALL
)"""
_STEPS = """m AS (
  SELECT *, hypot_d / greatest(pts - lp, 0.001) >= 10 AS moving FROM (
    SELECT *, sqrt(dx * dx + dy * dy) AS hypot_d FROM (
      SELECT video_id, track_id, frame_number, pts, x + w / 2 - lag(x + w / 2) OVER o AS dx, y + h / 2 - lag(y + h / 2) OVER o AS dy, lag(pts) OVER o AS lp FROM p WINDOW o AS (PARTITION BY track_id ORDER BY frame_number))
    WHERE dx IS NOT NULL)
)"""
_LIFE = """life AS (
  SELECT video_id, track_id, 'object_appeared' AS event_type, first_seconds AS s, first_seconds AS e, confidence FROM t WHERE last_frame > first_frame
  UNION ALL SELECT video_id, track_id, 'object_present', first_seconds, last_seconds, confidence FROM t WHERE last_frame > first_frame AND last_seconds > first_seconds
  UNION ALL SELECT video_id, track_id, 'object_disappeared', last_seconds, last_seconds, confidence FROM t WHERE last_frame > first_frame
)"""
_MOTION = """motion AS (
  SELECT video_id, track_id, CASE WHEN moving THEN 'started_moving' ELSE 'stopped_moving' END AS event_type, pts AS s, pts AS e, confidence
  FROM (SELECT *, lag(moving) OVER (PARTITION BY track_id ORDER BY frame_number) AS was FROM m) JOIN t USING (video_id, track_id) WHERE was IS NOT NULL AND was <> moving
)"""


@query("trk2_track_table", f"WITH {ad.POINTS}, {_TRACKS} SELECT * FROM t")
def trk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.track_table(ad.trajectory_points(spark, sf_dir)).drop("start_bbox", "end_bbox")


@query("trk3_trajectory_summary", f"""WITH {ad.POINTS}, q AS (
  SELECT *, sqrt((cx - lx) * (cx - lx) + (cy - ly) * (cy - ly)) AS d FROM (
    SELECT video_id, track_id, frame_number, pts, x + w / 2 AS cx, y + h / 2 AS cy, lag(x + w / 2) OVER o AS lx, lag(y + h / 2) OVER o AS ly FROM p WINDOW o AS (PARTITION BY track_id ORDER BY frame_number))
), g AS (SELECT video_id, track_id, count(*) AS n_points, coalesce(sum(d), 0) AS path, greatest(max(pts) - min(pts), 1e-6) AS dur, arg_max(cx, frame_number) - arg_min(cx, frame_number) AS dx, arg_max(cy, frame_number) - arg_min(cy, frame_number) AS dy FROM q GROUP BY ALL)
SELECT video_id, track_id, n_points, round(sqrt(dx * dx + dy * dy), 4) AS displacement, round(path, 4) AS path_length, round(dur, 4) AS duration, round(path / dur, 4) AS mean_speed,
  CASE WHEN sqrt(dx * dx + dy * dy) >= 2 THEN (['E', 'SE', 'S', 'SW', 'W', 'NW', 'N', 'NE'])[((floor(((degrees(atan2(dy, dx)) + 360) % 360 + 22.5) / 45))::BIGINT % 8) + 1] END AS direction FROM g""")
def trk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tr.trajectory_summary(ad.trajectory_points(spark, sf_dir))
    return s.select("video_id", "track_id", "n_points", *(F.round(c, 4).alias(c) for c in ("displacement", "path_length", "duration", "mean_speed")), "direction")


@query("trk4_trajectory_in_window", f"""WITH {ad.POINTS}, c AS (SELECT video_id, track_id, event_id AS candidate_id, pts AS s, pts + 5 AS e FROM p WHERE event_type = 'purchase'), j AS (
  SELECT c.video_id, candidate_id, c.track_id, p.frame_number AS f, p.pts, p.x + p.w / 2 AS cx, p.y + p.h / 2 AS cy FROM c JOIN p ON c.video_id = p.video_id AND c.track_id = p.track_id AND p.pts BETWEEN s AND e)
SELECT video_id, candidate_id, track_id, count(*) AS n_points, round(sqrt(pow(arg_max(cx, f) - arg_min(cx, f), 2) + pow(arg_max(cy, f) - arg_min(cy, f), 2)), 4) AS displacement,
  round(sqrt(pow(arg_max(cx, f) - arg_min(cx, f), 2) + pow(arg_max(cy, f) - arg_min(cy, f), 2)) / greatest(arg_max(pts, f) - arg_min(pts, f), 0.001), 4) AS velocity FROM j GROUP BY ALL""")
def trk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    wanted = ad.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id")
    c = p.join(wanted, "event_id").select("video_id", "track_id", F.col("event_id").alias("candidate_id"), F.col("pts").alias("start"), (F.col("pts") + 5).alias("end"))
    return tr.trajectory_in_window(p, c).select("video_id", "candidate_id", "track_id", "n_points", F.round("displacement", 4).alias("displacement"), F.round("velocity", 4).alias("velocity"))


@query("prj14_filter_detections", f"""WITH {ad.POINTS} SELECT video_id, frame_number, detection_id, confidence FROM (
  SELECT video_id, floor(pts / 2)::BIGINT AS frame_number, event_id AS detection_id, confidence, row_number() OVER (PARTITION BY video_id, floor(pts / 2) ORDER BY confidence DESC, event_id) AS r FROM p WHERE confidence >= 0.3 AND track_id % 5 IN (0, 1, 2)) WHERE r <= 3""")
def prj14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.filter_detections(ad.detections(spark, sf_dir), 0.3, ["0", "1", "2"], 3).select("video_id", "frame_number", "detection_id", "confidence")


# ---- events


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    t = tr.track_table(p)
    return ev.timeline(ev.lifecycle_events(t), ev.motion_events(p, t))


@query("evt1_lifecycle", f'WITH {ad.POINTS}, {_TRACKS}, {_LIFE} SELECT video_id, track_id, event_type, s AS "start", e AS "end", confidence FROM life')
def evt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.lifecycle_events(tr.track_table(ad.trajectory_points(spark, sf_dir)))


@query("evt2_motion", f'WITH {ad.POINTS}, {_TRACKS}, {_STEPS}, {_MOTION} SELECT video_id, track_id, event_type, s AS "start", e AS "end", confidence FROM motion')
def evt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    return ev.motion_events(p, tr.track_table(p))


@query("evt10_timeline", f'WITH {ad.POINTS}, {_TRACKS}, {_STEPS}, {_LIFE}, {_MOTION} SELECT video_id, track_id, event_type, s AS "start", e AS "end", confidence FROM (SELECT * FROM life UNION ALL SELECT * FROM motion)')
def evt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)


@query("evt13_timeline_summary", f"""WITH {ad.POINTS}, {_TRACKS}, {_STEPS}, {_LIFE}, {_MOTION}, a AS (SELECT * FROM life UNION ALL SELECT * FROM motion)
SELECT video_id, count(*) AS n_events, round(min(s), 2) AS first_seconds, round(max(e), 2) AS last_seconds, round(round(max(e), 2) - round(min(s), 2), 2) AS span,
  count(*) FILTER (event_type = 'object_appeared') AS appeared, count(*) FILTER (event_type = 'started_moving') AS started, count(*) FILTER (event_type = 'stopped_moving') AS stopped FROM a GROUP BY video_id""")
def evt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.timeline_summary(_timeline(spark, sf_dir))
    n = lambda k: F.coalesce(F.col("counts")[k], F.lit(0)).cast("long")
    return s.select("video_id", "n_events", "first_seconds", "last_seconds", "span", n("object_appeared").alias("appeared"), n("started_moving").alias("started"), n("stopped_moving").alias("stopped"))


_TURNS = """r AS (
  SELECT *, (degrees(atan2(dy, dx)) + 360) % 360 AS hd FROM m WHERE moving AND hypot_d >= 3
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pts, frame_number) AS i FROM (
    SELECT *, least(abs(hd - lh), 360 - abs(hd - lh)) AS turn FROM (SELECT *, lag(hd) OVER (PARTITION BY track_id ORDER BY frame_number) AS lh FROM r)) WHERE turn >= 45
), kept AS (
  SELECT video_id, track_id, pts, turn, i FROM turns WHERE i = 1
  UNION ALL
  SELECT n.video_id, n.track_id, n.pts, n.turn, n.i FROM kept k JOIN turns n ON n.track_id = k.track_id AND n.i = (SELECT min(q.i) FROM turns q WHERE q.track_id = k.track_id AND q.i > k.i AND q.pts - k.pts >= 0.3 - 1e-9)
)"""


@query("evt3_direction", f"""WITH RECURSIVE {ad.POINTS}, {_TRACKS}, {_STEPS}, {_TURNS}
SELECT video_id, track_id, 'direction_changed' AS event_type, pts AS "start", pts AS "end", confidence, round(turn, 4) AS turn FROM kept JOIN t USING (video_id, track_id)""")
def evt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    return ev.direction_events(p, tr.track_table(p))


def _zones(spark: SparkSession) -> DataFrame:
    tri = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 400D, 'y', 0D), named_struct('x', 200D, 'y', 350D))"
    return spark.range(1).select(F.explode(F.array(F.struct(F.lit("z1").alias("zone_id"), rect_zone(50, 50, 200, 200).alias("polygon")), F.struct(F.lit("z2").alias("zone_id"), F.expr(tri).alias("polygon")))).alias("z")).select("z.*")


@query("evt4_zone", f"""WITH RECURSIVE {ad.POINTS}, q AS (
  SELECT video_id, track_id, pts, x + w / 2 > 50 AND x + w / 2 <= 250 AND y + h / 2 > 50 AND y + h / 2 <= 250 AS inside, row_number() OVER (PARTITION BY track_id ORDER BY pts, frame_number) AS i FROM p
), f AS (
  SELECT video_id, track_id, i, inside AND pts + 1 >= 0.5 AS within, CASE WHEN inside AND pts + 1 >= 0.5 THEN pts ELSE -1 END AS last, inside AND pts + 1 >= 0.5 AS fired, pts, NULL::DOUBLE AS dwell FROM q WHERE i = 1
  UNION ALL
  SELECT q.video_id, q.track_id, q.i, CASE WHEN q.inside <> within AND q.pts - last >= 0.5 THEN q.inside ELSE within END, CASE WHEN q.inside <> within AND q.pts - last >= 0.5 THEN q.pts ELSE last END, q.inside <> within AND q.pts - last >= 0.5, q.pts,
    CASE WHEN q.inside <> within AND q.pts - last >= 0.5 AND within THEN q.pts - last END
  FROM f JOIN q ON q.track_id = f.track_id AND q.i = f.i + 1
)
SELECT 'z1' AS zone_id, video_id, track_id, CASE WHEN within THEN 'zone_entered' ELSE 'zone_exited' END AS event_type, pts AS "start", round(dwell, 4) AS dwell FROM f WHERE fired""")
def evt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.zone_events(ad.trajectory_points(spark, sf_dir), _zones(spark).where("zone_id = 'z1'"))
    return found.withColumn("dwell", F.round("dwell", 4))


@query("evt7_speech", f"""WITH {ad.SEGMENTS} SELECT video_id, segment_id, event_type, CASE WHEN event_type = 'speech_ended' THEN "end" ELSE "start" END AS "start", CASE WHEN event_type = 'speech_started' THEN "start" ELSE "end" END AS "end", 1.0::DOUBLE AS confidence
FROM s, (VALUES ('speech_started'), ('speech_detected'), ('speech_ended')) v(event_type)""")
def evt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.speech_events(ad.transcript_segments(spark, sf_dir))


@query("evt11_between", f'WITH {ad.POINTS}, {_TRACKS}, {_STEPS}, {_LIFE}, {_MOTION} SELECT video_id, track_id, event_type, s AS "start", e AS "end", confidence FROM (SELECT * FROM life UNION ALL SELECT * FROM motion) WHERE s <= 60 AND e >= 30')
def evt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.events_between(_timeline(spark, sf_dir), 30.0, 60.0)


@query("evt12_temporal_relations", f"""WITH {ad.POINTS}, i AS (SELECT track_id, event_id, pts AS s, pts + value / 100 AS e FROM p), j AS (
  SELECT a.track_id, a.event_id AS a_id, b.event_id AS b_id, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, abs(a.s - b.s) <= 1e-4 AND abs(a.e - b.e) <= 1e-4 AS eq
  FROM i a JOIN i b ON a.track_id = b.track_id AND a.event_id < b.event_id AND a.s - 2 <= b.e AND b.s <= a.e + 2)
SELECT track_id, relation, count(*) AS n FROM j, (VALUES ('equals'), ('before'), ('after'), ('overlaps'), ('contains'), ('during'), ('near')) v(relation)
WHERE CASE relation WHEN 'equals' THEN eq WHEN 'before' THEN e1 < s2 WHEN 'after' THEN e2 < s1 WHEN 'overlaps' THEN s1 < e2 AND s2 < e1 WHEN 'contains' THEN s1 <= s2 AND e1 >= e2 AND NOT eq WHEN 'during' THEN s2 <= s1 AND e2 >= e1 AND NOT eq ELSE greatest(s1, s2) - least(e1, e2) <= 2 END GROUP BY ALL""")
def evt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.temporal_relations(ad.intervals(spark, sf_dir), keys=("track_id",)).groupBy("track_id", "relation").agg(F.count("*").alias("n"))


@query("prj19_node_ids", f"WITH {ad.POINTS}, {_TRACKS} SELECT 'track:' || track_id AS node_id, 'CONTAINS:video:' || video_id || '->track:' || track_id AS edge_id FROM t")
def prj19(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.functions.exprs import edge_id

    t = tr.track_table(ad.trajectory_points(spark, sf_dir))
    return t.select(node_id("track", F.col("track_id")).alias("node_id"), edge_id(F.lit("CONTAINS"), node_id("video", F.col("video_id")), node_id("track", F.col("track_id"))).alias("edge_id"))
