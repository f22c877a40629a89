"""Queries of graph projections, named lookups, results, notes, crops, evidence tables and annotation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import exprs as ex
from tracelake.operators import conform as co
from tracelake.operators import entities as en
from tracelake.operators import evaluation as va
from tracelake.operators import events as ev
from tracelake.operators import evidence as vd
from tracelake.operators import graph as gr
from tracelake.operators import lectures as le
from tracelake.operators import lookups as lo
from tracelake.operators import ranking as ra
from tracelake.operators import timeindex as ti
from tracelake.operators import tracks as tr
from tracelake.plans.queries import query
from tracelake.sources import adapters as ad

_WORDS = r"list_filter(string_split_regex(trim(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_ENDS = ("relationship", "source_node_id", "target_node_id")


# ---- graph projections


@query("gra3_membership", f"WITH {ad.POINTS} SELECT video_id, 'detection:' || event_id AS source_node_id, 'track:' || (track_id * 1000 + frame_number // 20) AS target_node_id FROM p WHERE event_id % 2 = 0 AND event_id % 3 <> 0")
def gra3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir).where("event_id % 2 = 0")
    tracklets = p.groupBy((F.col("track_id") * 1000 + F.floor(F.col("frame_number") / 20)).alias("track_id")).agg(F.collect_list("event_id").alias("detection_ids"))
    return gr.membership_edges(tracklets, ad.detections(spark, sf_dir).where("detection_id % 3 <> 0")).select("video_id", "source_node_id", "target_node_id")


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    s = p.select("video_id", F.col("event_id").alias("semantic_event_id"), F.array("event_id", F.col("event_id") + 1).alias("source_event_ids"))
    return gr.semantic_edges(s, p.where("event_id % 5 <> 0"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    evidence = p.where("event_id % 7 <> 0").select("video_id", F.col("event_id").alias("evidence_id"), (F.col("event_id") + 1).alias("frame_id"), "track_id")
    events = p.select("video_id", "event_id", F.array("event_id", F.col("event_id") + 10_000_000).alias("evidence_ids"))
    return gr.evidence_edges(evidence, events, p.where("event_id % 4 <> 0").select(F.col("event_id").alias("frame_id")), p.where("track_id % 3 <> 0"))


_X = "x AS (SELECT p.video_id, p.event_id AS s, e.event_id AS t FROM p CROSS JOIN (VALUES (0), (1)) k(k) JOIN p e ON e.event_id = p.event_id + k WHERE e.event_id % 5 <> 0)"
_V = "v AS (SELECT event_id AS ev, event_id + 1 AS fr, track_id, EXISTS (FROM p f WHERE f.event_id = p.event_id + 1 AND f.event_id % 4 <> 0) AS seen FROM p WHERE event_id % 7 <> 0)"


@query("gra5_semantic_edges", f"WITH {ad.POINTS}, {_X} SELECT video_id, 'DERIVED_FROM' AS relationship, 'semantic_event:' || s AS source_node_id, 'event:' || t AS target_node_id FROM x UNION ALL SELECT video_id, 'SUPPORTS_SEMANTIC_EVENT', 'event:' || t, 'semantic_event:' || s FROM x")
def gra5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir).select("video_id", *_ENDS)


@query("gra6_evidence_edges", f"WITH {ad.POINTS}, {_V} SELECT 'REFERENCES' AS relationship, 'evidence:' || ev AS source_node_id, 'frame:' || fr AS target_node_id FROM v WHERE seen UNION ALL SELECT 'REFERENCES', 'evidence:' || ev, 'track:' || track_id FROM v WHERE track_id % 3 <> 0 UNION ALL SELECT 'SUPPORTED_BY', 'event:' || ev, 'evidence:' || ev FROM v")
def gra6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select(*_ENDS)


@query("gra7_ordered_pairs", f"WITH {ad.POINTS}, i AS (SELECT event_id, pts AS s, pts + value / 100 AS e FROM p) SELECT a.event_id AS a_id, b.event_id AS b_id, CASE WHEN a.e < b.s THEN 'PRECEDES' ELSE 'FOLLOWS' END AS relationship FROM i a JOIN i b ON b.event_id = a.event_id + 1 WHERE a.e < b.s OR b.e < a.s")
def gra7(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = ad.intervals(spark, sf_dir)
    return gr.ordered_pairs(i, i.select(F.col("event_id").alias("a_id"), (F.col("event_id") + 1).alias("b_id")))


@query("gra17_trace_chain", f"""WITH {ad.POINTS}, {_X}, {_V}, c AS (SELECT DISTINCT s, v.* FROM x JOIN v ON ev = t)
SELECT 'semantic_event:' || event_id AS "start", 'semantic_event' AS level, 'semantic_event:' || event_id AS node_id FROM p UNION ALL SELECT DISTINCT 'semantic_event:' || s, 'event', 'event:' || t FROM x
UNION ALL SELECT DISTINCT 'semantic_event:' || s, 'evidence', 'evidence:' || ev FROM c UNION ALL (SELECT 'semantic_event:' || s, 'source', 'frame:' || fr FROM c WHERE seen UNION SELECT 'semantic_event:' || s, 'source', 'track:' || track_id FROM c WHERE track_id % 3 <> 0)""")
def gra17(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ad.trajectory_points(spark, sf_dir).select(ex.node_id("semantic_event", F.col("event_id")).alias("node_id"))
    return gr.trace_chain(_semantic(spark, sf_dir).unionByName(_cited(spark, sf_dir)), ids)


# ---- named lookups

_T = "t AS (SELECT video_id, track_id, floor(min(pts) * 100) / 100 AS a, floor(max(pts) * 100) / 100 AS b FROM p GROUP BY ALL)"


@query("inv3_tracks", f"WITH {ad.POINTS}, {_T} SELECT event_id AS request_id, round(b - a, 2) AS duration, a IS NOT NULL AS found FROM p LEFT JOIN (SELECT * FROM t WHERE track_id % 4 <> 0) t ON t.track_id = p.track_id + 5")
def inv3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    t = tr.track_table(p).select("track_id", *((F.floor(F.col(c) * 100) / 100).alias(c) for c in ("first_seconds", "last_seconds")))
    r = p.select(F.col("event_id").alias("request_id"), (F.col("track_id") + 5).alias("track_id"))
    return en.lookup_tracks(r, t.where("track_id % 4 = 1"), t.where("track_id % 4 IN (2, 3)")).select("request_id", "duration", "found")


@query("inv4_objects", f"""WITH {ad.POINTS}, {_T}, d AS (SELECT track_id AS video_id, event_id, 'Kind' || (event_id % 12) AS c FROM p WHERE event_id % 2 = 0)
SELECT p.event_id AS request_id, 'detection' AS kind, d.event_id::VARCHAR AS object_id, c AS class_name FROM p JOIN d USING (event_id) WHERE p.event_id % 3 <> 0 UNION ALL SELECT event_id, 'track', t.track_id::VARCHAR, 'whole' FROM p JOIN t ON t.track_id = event_id WHERE event_id % 3 <> 0 AND event_id % 2 = 1
UNION ALL SELECT p.event_id, 'detection', d.event_id::VARCHAR, c FROM p JOIN d ON d.video_id = p.track_id WHERE p.event_id % 3 = 0 AND contains(lower(c), 'kind1')""")
def inv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    d = p.where("event_id % 2 = 0").select(F.col("track_id").alias("video_id"), F.col("event_id").alias("detection_id"), F.concat(F.lit("Kind"), (F.col("event_id") % 12).cast("string")).alias("class_name"))
    r = p.select(F.col("event_id").alias("request_id"), F.col("track_id").alias("video_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("object_id"), F.lit("KIND1").alias("class_part"))
    return en.lookup_objects(r, d, p.select("track_id", F.lit("whole").alias("class_name")).distinct())


@query("inv5_frames", f"WITH {ad.POINTS} SELECT DISTINCT p.event_id AS request_id, f.event_id AS frame_id, f.pts FROM p CROSS JOIN (VALUES (0), (3), (1000000000)) k(k) JOIN p f ON f.event_id = p.event_id + k")
def inv5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    e = F.col("event_id")
    return en.lookup_frames(p.select(e.alias("request_id"), F.array(e, e + 3, e + 1_000_000_000, e).alias("frame_ids")), p.select(e.alias("frame_id"), "pts"))


@query("inv6_evidence", f"WITH {ad.POINTS}, w AS (SELECT event_id AS request_id, event_id + 2 AS e FROM p WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_id + k FROM p CROSS JOIN (VALUES (0), (1)) k(k) WHERE event_id % 2 = 1) SELECT request_id, p.event_id AS evidence_id, pts FROM w JOIN p ON p.event_id = e AND p.event_id % 7 <> 0")
def inv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    e = F.col("event_id")
    r = p.select(e.alias("request_id"), F.when(e % 2 == 0, e + 2).alias("evidence_id"), "event_id")
    return en.lookup_evidence(r, p.where("event_id % 7 <> 0").select(e.alias("evidence_id"), "pts"), p.select("event_id", F.array(e, e + 1).alias("evidence_ids")))


@query("inv8_transcript", f"""WITH {ad.SEGMENTS} SELECT r.video_id * 1000 + r.segment_id AS request_id, s.segment_id FROM s r JOIN s USING (video_id) WHERE s."start" <= r."start" + 5 AND s."end" >= r."start" - 1""")
def inv8(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ad.transcript_segments(spark, sf_dir)
    r = s.select((F.col("video_id") * 1000 + F.col("segment_id")).alias("request_id"), "video_id", (F.col("start") - 1).alias("w_start"), (F.col("start") + 5).alias("w_end"))
    return lo.search_window(r, s, ("start", "end")).select("request_id", "segment_id")


@query("inv9_scenes", "SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 3 <> 0 THEN round(((o_custkey % 7) + 0.25) * 1.5, 2)::DOUBLE END AS duration, o_custkey % 3 <> 0 AS found FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def inv9(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    scenes = ad.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(k.alias("scene_id"), F.lit(10.0).alias("start"), (10 + (k % 7 + 0.25) * 1.5).alias("end"))
    r = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("scene_id"))
    return en.lookup_scenes(r, scenes).select("request_id", "duration", "found")


@query("inv10_query_graph", f"""WITH {ad.POINTS}, n AS (SELECT track_id AS video_id, 'event:' || event_id AS node_id FROM p WHERE contains(event_type, 'c')), r AS (SELECT DISTINCT track_id AS v FROM p)
SELECT v AS request_id, node_id FROM (SELECT v, node_id, row_number() OVER (PARTITION BY v ORDER BY node_id) AS i FROM r JOIN n ON n.video_id = v) WHERE i <= 50""")
def inv10(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = ad.intervals(spark, sf_dir).withColumn("video_id", F.col("track_id"))
    nodes = gr.union_all(gr.nodes_from(i, "event", "event_id", F.col("event_type")), gr.nodes_from(i.select("video_id", "track_id").distinct(), "track", "track_id", F.lit("click")))
    r = i.select("track_id").distinct().select(F.col("track_id").alias("request_id"), F.col("track_id").alias("video_id"), F.lit("event").alias("node_type"), F.lit("C").alias("label"))
    return en.query_graph(r, nodes).select("request_id", "node_id")


# ---- bundles and results


@query("sem8_bundle_crops", f"""WITH {ad.POINTS}, k AS (SELECT track_id AS c, frame_number // 3 AS position, frame_number FROM p WHERE frame_number % 3 = 0), h AS (SELECT c AS candidate_id, m.track_id, position, k.frame_number, row_number() OVER (PARTITION BY c ORDER BY position, m.track_id) AS r FROM k JOIN p m ON m.frame_number = k.frame_number AND (m.track_id = c OR m.track_id = c + 10))
SELECT candidate_id, track_id, position, frame_number FROM h WHERE r <= 6""")
def sem8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    t = F.col("track_id")
    c = p.select("video_id", "track_id").distinct().select("video_id", t.alias("candidate_id"), F.array(t, t + 10).alias("track_ids"))
    k = p.where("frame_number % 3 = 0").select("video_id", t.alias("candidate_id"), F.floor(F.col("frame_number") / 3).alias("position"), "frame_number")
    return co.bundle_crops(c, k, p, 100_000.0, 100_000.0).select("candidate_id", "track_id", "position", "frame_number")


@query("sem9_tokens", r"""SELECT doc_id, (400 + 320 * (doc_id % 6) + floor(20 * ((doc_id % 50) / 4.0)) + 2 * len(string_split_regex(trim(coalesce(text, '')), '[ \t\n\x0B\f\r]+')) + 30 * (doc_id % 3))::BIGINT AS tokens FROM documents""")
def sem9(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    b = ad.table(spark, sf_dir, "documents").select(d, (d % 6).alias("n_crops"), F.lit(0.0).alias("start"), (d % 50 / 4.0).alias("end"), F.array(F.coalesce("text", F.lit(""))).alias("texts"), (d % 3).alias("n_trajectories"))
    return ra.estimate_tokens(b).select("doc_id", "tokens")


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    e = F.col("event_id")
    b = p.where("event_id % 11 <> 0").select(e.alias("candidate_id"), F.array(e).alias("evidence_ids"), F.array(e).alias("event_ids"), F.col("pts").alias("start"), (F.col("pts") + 1).alias("end"))
    r = p.select(
        e.alias("candidate_id"), F.array(F.when(e % 3 == 0, e + 1).otherwise(e)).alias("evidence_ids"), F.array(F.when(e % 4 == 0, e + 1).otherwise(e)).alias("event_ids"), (F.col("pts") + (e % 5 - 2) * 0.3).alias("start"), (F.col("pts") + 1 + (e % 7) * 0.2).alias("end"),
        (e % 110 / 100).alias("score"), F.when(e % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("participant_ids"), F.lit("walk").alias("label"),
    )
    return ra.validate_results(r, b)


_RESULTS = """r AS (SELECT *, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'unknown_candidate' END, CASE WHEN event_id % 11 <> 0 AND event_id % 3 = 0 THEN 'unknown_evidence' END, CASE WHEN event_id % 11 <> 0 AND event_id % 4 = 0 THEN 'unknown_event' END,
  CASE WHEN event_id % 11 <> 0 AND (event_id % 5 = 0 OR event_id % 7 >= 3) THEN 'outside_window' END, CASE WHEN event_id % 110 > 100 THEN 'score_range' END, CASE WHEN event_id % 13 = 0 THEN 'no_participants' END) AS errors FROM p)"""


@query("sem13_validate_results", f"WITH {ad.POINTS}, {_RESULTS} SELECT event_id AS candidate_id, errors, CASE WHEN errors = '' THEN (event_id % 110) / 100 ELSE 0 END::DOUBLE AS score FROM r")
def sem13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("candidate_id", F.array_join("errors", ",").alias("errors"), "score")


@query("sem14_semantic_events", f"""WITH {ad.POINTS}, {_RESULTS}, q AS (SELECT *, ((event_id % 110) / 100)::DOUBLE AS score FROM r WHERE errors = '')
SELECT video_id, sha256(event_id || '|walk') AS semantic_event_id, 'walk' AS event_type, CASE WHEN score >= 0.7 THEN 'confirmed' ELSE 'candidate' END AS status, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS severity, event_id AS source FROM q""")
def sem14(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir).select(F.col("event_id").alias("candidate_id"), "video_id", F.col("pts").alias("start"), F.col("pts").alias("end"))
    return ra.semantic_events(_validated(spark, sf_dir), p).select("video_id", "semantic_event_id", "event_type", "status", "severity", F.element_at("source_event_ids", 1).alias("source"))


# ---- notes

_NOTES = """c AS (SELECT conv_id AS video_id, turn, CASE turn % 6 WHEN 0 THEN '\\frac{a}{b}' WHEN 3 THEN 'a{b' ELSE text END AS text, turn % 3 = 0 AS formula, turn % 4 = 0 AS bare, turn * 4.0 + 3 + (length(text) % 5) * 0.5 AS e, CASE WHEN conv_id % 5 <> 0 THEN 20.0 END AS d FROM conversations)"""


def _notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = ad.transcript_segments(spark, sf_dir)
    t = F.col("segment_id")
    items = s.select("video_id", F.when(t % 3 == 0, "formula").otherwise("item").alias("kind"), F.when(t % 6 == 0, r"\frac{a}{b}").when(t % 6 == 3, "a{b").otherwise(F.col("text")).alias("text"), "end", F.when(t % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(t.cast("string"))).alias("evidence_ids"))
    return items, s.select("video_id").distinct().where("video_id % 5 <> 0").withColumn("duration_seconds", F.lit(20.0))


@query("cmp4_uncertainties", f"""WITH c AS (SELECT conv_id AS video_id, turn, text, turn * 100.0::DOUBLE AS a, turn * 100.0::DOUBLE + 9 AS e, ((turn * 37 + conv_id) % 100) / 100 AS conf FROM conversations), v AS (SELECT video_id, sum(len({_WORDS})) AS w, max(e) - min(a) AS span FROM c GROUP BY 1)
SELECT video_id, turn AS segment_id, 'low_confidence' AS issue FROM c WHERE conf < 0.4 UNION ALL SELECT video_id, turn, 'noise' FROM c WHERE contains(lower(text), 'the ') OR contains(lower(text), 'der ') UNION ALL SELECT video_id, -1, 'abridged' FROM v WHERE span >= 300 AND w / (span / 60) < 50""")
def cmp4(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("segment_id")
    s = ad.transcript_segments(spark, sf_dir).withColumn("start", t * 100.0).withColumn("end", t * 100.0 + 9).withColumn("confidence", (t * 37 + F.col("video_id")) % 100 / 100)
    return le.uncertainties(s, noise=("the ", "der ")).fillna(-1, ["segment_id"])


@query("cmp7_validate_notes", f"WITH {_NOTES} SELECT video_id, count(*) FILTER (NOT bare) AS grounded, count(*) FILTER (bare) AS unsupported, coalesce(bool_and(CASE WHEN formula THEN turn % 6 = 0 END), true) AS formulas_ok, bool_and(e <= d + 5) AS times_ok FROM c GROUP BY 1")
def cmp7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return le.validate_notes(*_notes(spark, sf_dir))


@query("cmp8_evaluate_notes", f"""WITH {_NOTES}, k AS (SELECT video_id, count(DISTINCT k) AS held FROM c JOIN (VALUES ('the'), ('frac'), ('zzz')) k(k) ON contains(lower(text), k) GROUP BY 1),
a AS (SELECT video_id, round(count(*) FILTER (bare) / count(*), 4) AS unsupported_rate, CASE WHEN count(*) FILTER (formula) > 0 THEN round(count(*) FILTER (turn % 6 = 0) / count(*) FILTER (formula), 4) ELSE 1 END AS formula_fidelity, round(count(*) FILTER (e <= d + 5) / count(*), 4) AS time_accuracy, round((count(*) - count(DISTINCT lower(text))) / count(*), 4) AS duplicate_rate FROM c GROUP BY 1)
SELECT a.*, round(coalesce(held, 0) / 3, 4) AS concept_coverage, unsupported_rate <= 0.05 AND formula_fidelity >= 0.95 AND round(coalesce(held, 0) / 3, 4) >= 0.7 AS accept FROM a LEFT JOIN k USING (video_id)""")
def cmp8(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, videos = _notes(spark, sf_dir)
    concepts = items.select("video_id").distinct().select("video_id", F.explode(F.array(*map(F.lit, ("The", "FRAC", "zzz")))).alias("concept"))
    return le.evaluate_notes(items, concepts, videos)


@query("cmp9_topics", f"""WITH {ad.SEGMENTS}, i AS (SELECT DISTINCT video_id, kind, k FROM s JOIN (VALUES ('example', 'the'), ('term', 'ing'), ('term2', 'the')) r(kind, k) ON contains(lower(text), k)) SELECT k AS concept, video_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM i GROUP BY ALL""")
def cmp9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("example", 1, "the"), ("term", 1, "ing"), ("term2", 1, "the")], "kind string, rule_no int, keyword string")
    return le.topic_index(le.extract_items(ad.transcript_segments(spark, sf_dir), rules)).withColumn("kinds", F.array_join("kinds", ","))


@query("cmp10_rollup", "SELECT doc_id % 20 AS playlist, count(*) AS total, count(*) FILTER (quality = 1) AS complete, 0::BIGINT AS partial, count(*) FILTER (quality = 0 AND toxic = 1) AS failed, 0::BIGINT AS awaiting_transcript, count(*) FILTER (quality = 0 AND toxic = 0) AS pending FROM labels GROUP BY 1")
def cmp10(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = ad.table(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("playlist"), F.when(F.col("quality") == 1, "complete").when(F.col("toxic") == 1, "failed").otherwise("pending").alias("status"))
    return le.job_rollup(jobs, ["playlist"])


@query("cmp11_playlist", r"""SELECT doc_id % 500 AS position, doc_id AS video_id, source || ' ' || lang AS title, CASE WHEN n_chars >= 3600 THEN printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) ELSE printf('%02d:%02d', n_chars // 60, n_chars % 60) END AS duration, lang AS status,
CASE WHEN doc_id % 2 = 0 THEN printf('%03d-', doc_id % 500) || regexp_replace(lower(source || ' ' || lang), '[\s_-]+', '-', 'g') END AS note_key FROM documents""")
def cmp11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    jobs = ad.table(spark, sf_dir, "documents").select((d % 500).alias("position"), d.alias("video_id"), F.concat("source", F.lit(" "), "lang").alias("title"), F.col("n_chars").alias("duration_seconds"), F.col("lang").alias("status"))
    return le.playlist_index(jobs, jobs.where("video_id % 2 = 0"))


# ---- evidence, events, timing


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ad.transcript_segments(spark, sf_dir)
    return s.select("video_id", F.col("segment_id").alias("observation_id"), F.col("start").alias("first_seconds"), "text", F.struct((F.col("segment_id") % 5 / 3.0).alias("mean")).alias("confidence_summary"), F.col("segment_id").alias("first_frame"), F.col("segment_id").alias("last_frame"))


@query("evd3_text_evidence", f"""WITH {ad.SEGMENTS} SELECT video_id, sha256('ocr|' || video_id || '|' || segment_id) AS evidence_id, segment_id::VARCHAR AS source_id, round(least(1, (segment_id % 5) / 3), 6) AS confidence, 'Text: ' || text AS description FROM s""")
def evd3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vd.text_evidence(_texts(spark, sf_dir)).select("video_id", "evidence_id", "source_id", F.round("confidence", 6).alias("confidence"), "description")


@query("evd5_all_evidence", f"""WITH {ad.SEGMENTS}, {ad.POINTS} SELECT video_id, 'ocr' AS evidence_type, count(*) AS n, max("start") AS last FROM s GROUP BY 1 UNION ALL SELECT video_id, 'transcript', count(*), max("start") FROM s GROUP BY 1 UNION ALL SELECT video_id, 'event', count(*), max(pts) FROM p GROUP BY 1""")
def evd5(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = vd.all_evidence(vd.text_evidence(_texts(spark, sf_dir)), vd.transcript_evidence(ad.transcript_segments(spark, sf_dir)), vd.event_evidence(ad.intervals(spark, sf_dir)))
    return every.groupBy("video_id", "evidence_type").agg(F.count("*").alias("n"), F.max("timestamp_seconds").alias("last"))


@query("prj20_event_filters", f"WITH {ad.POINTS} SELECT event_id, event_type FROM p WHERE event_type IN ('click', 'view') AND track_id % 4 = 1 AND track_id % 3 = 1")
def prj20(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("track_id")
    e = ad.intervals(spark, sf_dir).withColumn("participants", F.array((t % 4).cast("string"), F.lit("x"))).withColumn("track_ids", F.array((t % 3).cast("string")))
    return ev.events_with_track(ev.events_with_participant(ev.events_of_type(e, "click", "view"), "1"), "1").select("event_id", "event_type")


@query("evt9_conform", f"""WITH {ad.POINTS} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'end_before_start' END AS issue, CASE WHEN event_id % 5 = 0 THEN pts ELSE pts + 1 END AS "end", 'a,t' || track_id AS participants, event_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',x' || event_id END AS evidence_ids,
CASE WHEN event_id % 4 = 0 THEN 'given' ELSE replace(event_type, '_', ' ') || ' at ' || round(pts::DECIMAL(18, 3), 2)::DECIMAL(18, 2) || 's' END AS description FROM p""")
def evt9(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = F.col("event_id"), F.concat(F.lit("t"), F.col("track_id").cast("string"))
    i = ad.intervals(spark, sf_dir).select(
        "event_id", "event_type", "start", F.when(e % 5 == 0, F.col("start") - 1).otherwise(F.col("start") + 1).alias("end"), F.array(F.lit("a"), t).alias("participants"), F.array(t).alias("track_ids"), F.array(e.cast("string")).alias("evidence_ids"),
        F.when(e % 3 != 0, F.array(F.struct(F.concat(F.lit("x"), e.cast("string")).alias("evidence_id")))).alias("event_evidence"), F.when(e % 4 == 0, "given").alias("description"),
    )
    return ev.conform_events(i).select("event_id", "issue", "end", F.array_join("participants", ",").alias("participants"), F.array_join("evidence_ids", ",").alias("evidence_ids"), "description")


@query("tim5_timing_plan", "SELECT doc_id AS video_id, CASE WHEN doc_id % 3 = 0 THEN 'explicit' WHEN lang = 'de' OR coalesce(doc_id % 7 = 0, false) OR n_chars % 4 < 2 THEN 'exact' ELSE 'cfr' END AS timing_plan FROM documents")
def tim5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars") % 4
    v = ad.table(spark, sf_dir, "documents").select(d.alias("video_id"), (d % 3 == 0).alias("has_explicit_pts"), F.when(F.col("lang") == "de", "exact").otherwise("fast").alias("timing_mode"), F.when(d % 2 == 0, d % 7 == 0).otherwise(F.when(d % 7 == 0, True)).alias("is_vfr"), F.when(n == 1, 0.0).when(n > 1, 30.0).alias("fps"))
    return ti.timing_plan(v).select("video_id", "timing_plan")


@query("prj13_conform", f"WITH {ad.POINTS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'derived' ELSE 'given' END AS timestamp_source, CASE WHEN event_id % 3 = 0 THEN frame_number / 30.0::DOUBLE ELSE pts END AS pts, 'k' || track_id AS class_name FROM p")
def prj13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    old = p.select("event_id", "frame_number", F.when(F.col("event_id") % 3 != 0, F.col("pts")).alias("timestamp_seconds"), F.concat(F.lit("k"), F.col("track_id").cast("string")).alias("class_label"))
    return co.conform(old).select("event_id", "timestamp_source", "pts", "class_name")


@query("prj9_normalize_transcript")
def prj9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; SQL has no NFKC, so tests hold the expression to Python's."""
    return ad.table(spark, sf_dir, "documents").select("doc_id", ex.normalize_transcript(F.col("text")).alias("t"))


@query("prj10_normalize_eval")
def prj10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; SQL has no NFKC, so tests hold the expression to Python's."""
    return ad.table(spark, sf_dir, "documents").select("doc_id", ex.normalize_eval(F.col("text"), strip_punctuation=True).alias("t"))


# ---- annotation checks


@query("eva4_boundary", f"""WITH {ad.POINTS} SELECT track_id % 10 AS video_id, count(*) AS n, round(avg(((event_id % 3) * 0.25 + (event_id % 5) * 0.5) / 2), 4)::DOUBLE AS mean_boundary_error FROM p WHERE event_id % 2 = 0 GROUP BY 1""")
def eva4_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ad.intervals(spark, sf_dir).select("video_id", F.col("event_id").alias("id"), "start", "end")
    p = g.withColumn("start", F.col("start") + F.col("id") % 3 * 0.25).withColumn("end", F.col("end") - F.col("id") % 5 * 0.5)
    m = g.where("id % 2 = 0").select("video_id", F.col("id").alias("g_id"), F.col("id").alias("p_id"))
    return va.boundary_error(m, g, p)


@query("eva10_lint", f"""WITH {ad.POINTS}, b AS (SELECT track_id AS v, event_id AS id, frame_number AS f, pts + CASE WHEN event_id % 4 = 0 THEN 0.06 ELSE 0 END AS t, track_id % 5 AS c, x, y, w, h FROM p WHERE event_id % 9 <> 0 UNION ALL SELECT track_id, event_id + 10000000, frame_number, pts, track_id % 5, x, y, w, h FROM p WHERE event_id % 9 <> 0 AND event_id % 6 = 0),
f AS (SELECT track_id AS v, frame_number AS f, pts, frame_number % 17 = 0 AS neg FROM p WHERE frame_number % 10 <> 9), j AS (SELECT b.*, f.pts, neg FROM b LEFT JOIN f USING (v, f))
SELECT 'unknown_frame' AS issue, count(*) AS n FROM j WHERE pts IS NULL HAVING n > 0 UNION ALL SELECT 'timestamp_mismatch', count(*) AS n FROM j WHERE abs(t - pts) > 0.05 HAVING n > 0 UNION ALL SELECT 'unknown_class', count(*) AS n FROM j WHERE c = 4 HAVING n > 0
UNION ALL SELECT 'box_outside', count(*) AS n FROM j WHERE pts IS NOT NULL AND (x + w > 300 OR y + h > 300) OR x < 0 OR y < 0 HAVING n > 0 UNION ALL SELECT 'box_on_negative_frame', count(*) AS n FROM j WHERE neg HAVING n > 0
UNION ALL SELECT 'duplicate_box', count(*) AS n FROM p WHERE event_id % 9 <> 0 AND event_id % 6 = 0 HAVING n > 0 UNION ALL SELECT 'missing_frame', count(*) AS n FROM p WHERE event_id % 9 = 0 AND frame_number % 10 <> 9 AND frame_number % 17 <> 0 HAVING n > 0""")
def eva10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir).withColumn("video_id", F.col("track_id"))
    b = p.where("event_id % 9 <> 0").select("video_id", F.col("event_id").alias("id"), "frame_number", (F.col("pts") + F.when(F.col("event_id") % 4 == 0, 0.06).otherwise(0.0)).alias("t"), F.concat(F.lit("c"), (F.col("track_id") % 5).cast("string")).alias("class_name"), "bbox")
    again = p.where("event_id % 9 <> 0 AND event_id % 6 = 0").select("video_id", (F.col("event_id") + 10_000_000).alias("id"), "frame_number", F.col("pts").alias("t"), F.concat(F.lit("c"), (F.col("track_id") % 5).cast("string")).alias("class_name"), "bbox")
    f = p.where("frame_number % 10 <> 9").select("video_id", "frame_number", "pts", F.lit(300.0).alias("width"), F.lit(300.0).alias("height"), (F.col("frame_number") % 17 == 0).alias("is_negative"))
    return va.lint_annotations(b.unionByName(again), f, ["c0", "c1", "c2", "c3"]).groupBy("issue").agg(F.count("*").alias("n"))


@query("eva11_lint_corpus", f"""WITH {ad.POINTS}, c AS (SELECT track_id AS v, count(*) AS n FROM p GROUP BY 1), d AS (SELECT *, 640 + CASE WHEN v % 7 = 0 THEN 1 ELSE 0 END AS w, n + CASE WHEN v % 5 = 0 THEN 1 ELSE 0 END AS m FROM c WHERE v % 11 <> 0)
SELECT v AS video_id, 'size_mismatch' AS issue FROM d WHERE w <> 640 UNION ALL SELECT v, 'frame_count_mismatch' FROM d WHERE m <> n UNION ALL SELECT v, 'fps_mismatch' FROM d WHERE v % 13 = 0 UNION ALL SELECT v, 'unknown_clip' FROM c WHERE v % 11 = 0 UNION ALL SELECT DISTINCT track_id, 'negative_frame_not_empty' FROM p WHERE frame_number % 17 = 0 AND event_id % 2 = 0""")
def eva11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir).withColumn("video_id", F.col("track_id"))
    v = F.col("video_id")
    found = p.groupBy("video_id").agg(F.count("*").alias("n_frames")).withColumn("width", F.lit(640)).withColumn("height", F.lit(480)).withColumn("fps", F.lit(30.0))
    clips = found.where("video_id % 11 <> 0").select("video_id", (F.lit(640) + F.when(v % 7 == 0, 1).otherwise(0)).alias("width"), "height", F.when(v % 13 == 0, 25.0).otherwise(30.0).alias("fps"), (F.col("n_frames") + F.when(v % 5 == 0, 1).otherwise(0)).alias("n_frames"))
    frames = p.select("video_id", "frame_number", (F.col("frame_number") % 17 == 0).alias("is_negative"))
    return va.lint_corpus(found, clips, frames, p.where("event_id % 2 = 0"))


@query("eva12_contract", f"""WITH {ad.POINTS}, i AS (SELECT track_id AS v, pts AS s, pts + value / 100 - CASE WHEN event_id % 8 = 0 THEN 50 ELSE 0 END AS e FROM p), u AS (SELECT DISTINCT track_id AS v, k FROM p JOIN (VALUES (0), (1)) k(k) ON k = 0 OR track_id % 50 = 0)
SELECT v AS video_id, 'bad_interval' AS issue, count(*) AS n FROM i WHERE e < s OR s < 0 GROUP BY 1 UNION ALL SELECT v, 'after_the_end', count(*) FROM i JOIN u USING (v) WHERE e > 200.5 GROUP BY 1 UNION ALL SELECT v, 'repeated_video', 1 FROM u WHERE k = 1
UNION ALL SELECT doc_id, 'answer_missing', 1 FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 'annotated_without_items', 1 FROM labels WHERE quality = 1 AND doc_id % 3 = 0 UNION ALL SELECT doc_id, 'items_without_annotation', 1 FROM labels WHERE quality = 0 AND doc_id % 3 <> 0 AND toxic > 0""")
def eva12(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = ad.intervals(spark, sf_dir).select(F.col("track_id").alias("video_id"), "start", (F.col("end") - F.when(F.col("event_id") % 8 == 0, 50).otherwise(0)).alias("end"))
    once = i.select("video_id").distinct()
    videos = once.unionByName(once.where("video_id % 50 = 0")).withColumn("duration_seconds", F.lit(200.0))
    d = F.col("doc_id")
    qa = ad.table(spark, sf_dir, "documents").select(d.alias("video_id"), (d % 2 == 0).alias("is_answerable"), F.when(d % 6 == 0, "  ").otherwise("x").alias("reference_answer"))
    status = ad.table(spark, sf_dir, "labels").select(d.alias("video_id"), F.lit("qa").alias("modality"), F.when(F.col("quality") == 1, "annotated").otherwise("not_annotated").alias("status"), F.when(d % 3 != 0, F.col("toxic")).alias("n"))
    return co.contract_issues(status, i, qa, videos).groupBy("video_id", "issue").agg(F.count("*").alias("n"))
