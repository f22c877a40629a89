"""Queries of routing, bundles, integrity, audits and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import conform as co
from tracelake.operators import evaluation as va
from tracelake.operators import lectures as le
from tracelake.operators import lookups as lo
from tracelake.operators import ranking as ra
from tracelake.plans.queries import query
from tracelake.sources import adapters as ad


@query("prj15_route", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'p1' WHEN source = 'src0' THEN 'p2' ELSE 'p0' END AS provider FROM documents")
def prj15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("language", "de", "p1"), ("script", "src0", "p2")], "kind string, value string, provider string")
    d = ad.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("script"))
    return co.route(d, rules, "p0").select("doc_id", "provider")


@query("sem7_bundles", f"""WITH {ad.SEGMENTS}, c AS (SELECT video_id, segment_id AS candidate_id, "start" - 2 AS a, "end" + 2 AS b FROM s WHERE segment_id % 2 = 0), j AS (SELECT c.video_id, candidate_id, s.segment_id FROM c JOIN s ON c.video_id = s.video_id AND s."start" <= b AND s."end" >= a)
SELECT video_id, candidate_id, count(*) AS n, count(*) FILTER (segment_id % 3 = 1) AS n_texts FROM j GROUP BY ALL""")
def sem7(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ad.transcript_segments(spark, sf_dir)
    c = s.where("segment_id % 2 = 0").select("video_id", F.col("segment_id").alias("candidate_id"), (F.col("start") - 2).alias("start"), (F.col("end") + 2).alias("end"))
    texts = s.where("segment_id % 3 = 1").select("video_id", F.col("segment_id").alias("observation_id"), F.col("start").alias("first_seconds"), F.col("end").alias("last_seconds"))
    return ra.bundles(c, texts, s).select("video_id", "candidate_id", F.size("segment_ids").cast("long").alias("n"), F.coalesce(F.size("text_ids"), F.lit(0)).cast("long").alias("n_texts"))


@query("sem11_dedup", f"""WITH RECURSIVE {ad.POINTS}, q AS (SELECT track_id, event_id, pts, row_number() OVER (PARTITION BY track_id ORDER BY pts, event_id) AS i FROM p), k AS (
  SELECT * FROM q WHERE i = 1 UNION ALL SELECT n.* FROM k JOIN q n ON n.track_id = k.track_id AND n.i = (SELECT min(x.i) FROM q x WHERE x.track_id = k.track_id AND x.i > k.i AND x.pts - k.pts >= 60 - 1e-9))
SELECT event_id AS candidate_id FROM k""")
def sem11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    c = p.select("video_id", F.col("event_id").alias("candidate_id"), F.col("pts").alias("start"), F.array(F.col("track_id").cast("string")).alias("participant_ids"))
    return ra.dedup_candidates(c).select("candidate_id")


@query("eva7_integrity", f"""WITH {ad.POINTS}, c AS (SELECT video_id, CASE WHEN event_id % 7 = 0 THEN event_id + 5000000 WHEN event_id % 11 = 0 THEN event_id + 1 ELSE event_id END AS evidence_id FROM p)
SELECT c.video_id, count(*) AS n, count(*) FILTER (p.video_id IS NULL) AS missing, count(*) FILTER (p.video_id <> c.video_id) AS cross_video, round(1 - (count(*) FILTER (p.video_id IS NULL) + count(*) FILTER (p.video_id <> c.video_id)) / count(*), 4) AS rate FROM c LEFT JOIN p ON p.event_id = c.evidence_id GROUP BY 1""")
def eva7(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir).select("video_id", F.col("event_id").alias("evidence_id"))
    wrong = F.when(F.col("evidence_id") % 7 == 0, F.col("evidence_id") + 5_000_000).when(F.col("evidence_id") % 11 == 0, F.col("evidence_id") + 1).otherwise(F.col("evidence_id"))
    return va.reference_integrity(p.withColumn("evidence_id", wrong), p)


@query("eva8_metric_status", """WITH a AS (SELECT doc_id AS video_id, 'qa' AS modality, CASE quality WHEN 1 THEN 'annotated' ELSE 'annotation_incomplete' END AS status FROM labels), q AS (SELECT doc_id AS video_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 - 1 END AS n FROM documents WHERE doc_id % 5 <> 0)
SELECT a.video_id, modality, CASE WHEN status = 'annotation_incomplete' THEN status WHEN q.video_id IS NULL THEN 'missing_video' WHEN n IS NULL THEN 'missing_modality' WHEN n = 0 THEN 'empty_predictions' ELSE 'available' END AS metric_status FROM a LEFT JOIN q USING (video_id)""")
def eva8(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video_id"), F.lit("qa").alias("modality"), F.when(F.col("quality") == 1, "annotated").otherwise("annotation_incomplete").alias("status"))
    p = ad.table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("video_id"), F.lit("qa").alias("modality"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 - 1).alias("n"))
    return va.metric_status(a, p)


@query("eva14_audit", f"""WITH {ad.POINTS} SELECT 'no_evidence' AS issue, count(*) AS n FROM p WHERE event_id % 9 = 0 UNION ALL SELECT 'ungrounded_evidence', count(*) FROM p WHERE event_id % 9 <> 0 AND event_id % 7 = 0 UNION ALL SELECT 'end_before_start', count(*) FROM p WHERE event_id % 5 = 0
UNION ALL SELECT 'unknown_event', count(*) FROM p WHERE event_id % 13 = 0 UNION ALL SELECT 'score_range', count(*) FROM p WHERE event_id % 120 > 100""")
def eva14(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir)
    ids = F.when(F.col("event_id") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("event_id").cast("string")))
    e = p.select("event_id", F.col("pts").alias("start"), (F.col("pts") + F.when(F.col("event_id") % 5 == 0, -1).otherwise(1)).alias("end"), ids.alias("evidence_ids"))
    evidence = p.where("event_id % 7 <> 0").select(F.col("event_id").cast("string").alias("evidence_id"))
    source = F.when(F.col("event_id") % 13 == 0, F.col("event_id") + 10_000_000).otherwise(F.col("event_id"))
    c = e.select(F.col("event_id").alias("candidate_id"), F.array(source).alias("source_event_ids"), (F.col("event_id") % 120 / 100).alias("saliency_score"))
    return va.audit_run(e, c, evidence).groupBy("issue").agg(F.count("*").alias("n"))


@query("inv2_lookup", "SELECT o_orderkey AS request_id, c_name, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON c.c_custkey = o_custkey")
def inv2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), "c_name")
    r = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("event_id"))
    return lo.lookup(r, c.where("event_id % 4 = 1"), "event_id", c.where("event_id % 4 IN (2, 3)")).select("request_id", "c_name", "found")


@query("cmp3_sections", f"""WITH {ad.SEGMENTS}, q AS (SELECT *, segment_id // 3 AS win FROM s), t AS (SELECT video_id, win, bool_or(contains(lower(text), 'the')) AS en, bool_or(contains(lower(text), 'ing')) AS item FROM q GROUP BY ALL),
m AS (SELECT video_id, win, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, win ORDER BY "start", segment_id) AS r, count(*) OVER (PARTITION BY video_id, win) AS n FROM q) WHERE r = n // 2 + 1)
SELECT video_id, win AS "window", min("start") AS "start", max("end") AS "end", count(*) AS n_segments, CASE WHEN any_value(en) THEN 'English' ELSE 'Part ' || (win + 1) END AS title, CASE WHEN NOT any_value(item) THEN any_value(m.segment_id) END AS fallback_segment FROM q JOIN t USING (video_id, win) JOIN m USING (video_id, win) GROUP BY video_id, win""")
def cmp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ad.transcript_segments(spark, sf_dir).withColumn("window", F.floor(F.col("segment_id") / 3))
    rules = spark.createDataFrame([(1, "the", "English")], "rule_no int, keyword string, title string")
    items = le.extract_items(w, spark.createDataFrame([("example", 1, "ing")], "kind string, rule_no int, keyword string"))
    return le.sections(w, items, rules).select("video_id", "window", "start", "end", "n_segments", "title", "fallback_segment")


@query("cmp6_note_status", f"""WITH {ad.SEGMENTS}, v AS (SELECT conv_id AS video_id, 40.0 AS d FROM conversations UNION SELECT doc_id, 40.0 FROM documents), q AS (SELECT video_id, sum("end" - "start") AS sp FROM s GROUP BY 1)
SELECT video_id, round(least(100, 100 * sp / d), 2)::DOUBLE AS coverage, CASE WHEN sp IS NULL THEN 'awaiting_transcript' WHEN 100 * sp / d >= 90 THEN 'complete' ELSE 'partial' END AS status FROM v LEFT JOIN q USING (video_id)""")
def cmp6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ad.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id")).union(ad.table(spark, sf_dir, "documents").select("doc_id")).distinct()
    return le.note_status(ad.transcript_segments(spark, sf_dir), ids.withColumn("duration_seconds", F.lit(40.0)))


@query("cmp10_pending", "SELECT doc_id AS video_id FROM documents WHERE lang <> 'de' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def cmp10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.when(F.col("lang") == "de", "private").alias("availability"))
    jobs = ad.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video_id"), F.when(F.col("quality") == 1, "complete").otherwise("failed").alias("status"))
    return le.pending_videos(d, jobs).select("video_id")


_IV = "i AS (SELECT track_id AS video_id, event_id, event_type, pts AS s, pts + value / 100 AS e FROM p)"


@query("eva2_event_pairs", f"""WITH {ad.POINTS}, {_IV}, j AS (SELECT g.video_id, g.event_id AS g_id, d.event_id AS p_id, greatest(least(g.e, d.e + 0.5) - greatest(g.s, d.s + 0.5), 0) AS b, greatest(g.e, d.e + 0.5) - least(g.s, d.s + 0.5) AS u FROM i g JOIN i d ON g.video_id = d.video_id AND g.event_type = d.event_type AND g.s <= d.e + 0.5 AND d.s + 0.5 <= g.e)
SELECT video_id, g_id, p_id, round(b / u, 4) AS weight FROM j WHERE u > 0 AND b / u >= 0.5""")
def eva2(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = ad.intervals(spark, sf_dir).select(F.col("track_id").alias("video_id"), F.col("event_id").alias("id"), "event_type", "start", "end")
    moved = i.withColumn("start", F.col("start") + 0.5).withColumn("end", F.col("end") + 0.5)
    return va.event_pairs(i, moved).select("video_id", "g_id", "p_id", F.round("weight", 4).alias("weight"))


@query("eva9_aggregate", """WITH c AS (SELECT doc_id % 20 AS v, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels GROUP BY 1),
r AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 4) AS p, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 4) AS rc FROM c)
SELECT sum(tp)::BIGINT AS tp, round(avg(p), 3) AS macro_precision, round(sum(tp) / (sum(tp) + sum(fp)), 4) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 4) AS micro_recall, count(*) AS n_videos FROM r""")
def eva9(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 20).alias("video_id")).agg(*(F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(n) for n, q, t in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))))
    p = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))), 4)
    r = c.withColumn("precision", p("tp", "fp")).withColumn("recall", p("tp", "fn")).withColumn("f1", p("tp", "fp"))
    return va.aggregate_metrics(r).select("tp", F.round("macro_precision", 3).alias("macro_precision"), "micro_precision", "micro_recall", "n_videos")


@query("evt14_explain", f"""WITH {ad.POINTS} SELECT event_id, event_type || ' in z' AS what, round(pts::DECIMAL(18, 3), 2)::DECIMAL(18, 2) || 's-' || round(pts::DECIMAL(18, 3), 2)::DECIMAL(18, 2) || 's' AS "when", 'a' || track_id AS who FROM p""")
def evt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.operators.events import explain_events

    e = ad.table(spark, sf_dir, "events").select("event_id", "event_type")
    p = ad.trajectory_points(spark, sf_dir).join(e, "event_id")
    rows = p.select("video_id", "event_id", "event_type", F.lit("z").alias("zone_name"), F.col("pts").alias("start"), F.col("pts").alias("end"), F.array(F.concat(F.lit("a"), F.col("track_id").cast("string"))).alias("participants"), F.array(F.struct(F.lit("e").alias("evidence_id"), "frame_number")).alias("event_evidence"), F.lit("m").alias("source_module"))
    return explain_events(rows).select("event_id", "what", "when", "who")


@query("prj8_normalize_text")
def prj8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; SQL has no NFKC, so tests hold the expression to Python's."""
    from tracelake.functions.exprs import normalize_ocr

    return ad.table(spark, sf_dir, "documents").select("doc_id", normalize_ocr(F.col("text")).alias("t"))


@query("src4_resolve", "SELECT doc_id % 100 AS video_id, min(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END) AS best, count(*) AS n FROM (SELECT *, min(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END) OVER (PARTITION BY doc_id % 100) AS b FROM documents) WHERE b = CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END GROUP BY 1")
def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.sources.io import resolve_transcripts

    d = ad.table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("video_id"), F.col("lang").alias("provider"))
    rank = F.when(F.col("provider") == "en", 1).when(F.col("provider") == "de", 2).when(F.col("provider") == "fr", 3).otherwise(4)
    return resolve_transcripts(d, ("en", "de", "fr")).groupBy("video_id").agg(F.min(rank).alias("best"), F.count("*").alias("n"))


@query("eva9_rates", """WITH c AS (SELECT doc_id % 20 AS v, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (quality = toxic) AS same, count(*) AS n FROM labels GROUP BY 1),
m AS (SELECT v, 'detection_precision' AS metric, tp AS part, t AS whole FROM c UNION ALL SELECT v, 'qa_abstention_accuracy', same, n FROM c UNION ALL SELECT v, 'ocr_cer', 3 * t, n FROM c),
a AS (SELECT metric, sum(part) AS part, sum(whole)::BIGINT AS n, coalesce(avg(CASE WHEN whole > 0 THEN part / whole END), 0) AS mean, count(*) AS n_videos, count(CASE WHEN whole > 0 THEN 1 END) AS n_values FROM m WHERE v % 7 <> 3 GROUP BY 1),
w AS (SELECT *, part / n AS p, n::DOUBLE AS d FROM a), i AS (SELECT *, (p + 1.96 * 1.96 / (2 * d)) / (1 + 1.96 * 1.96 / d) AS mid, 1.96 * sqrt(p * (1 - p) / d + 1.96 * 1.96 / (4 * d * d)) / (1 + 1.96 * 1.96 / d) AS half FROM w WHERE metric <> 'ocr_cer')
SELECT w.metric, round(w.p, 4) AS micro, round(w.mean, 4) AS macro, w.n AS sample_size, w.n_videos, w.n_values, CASE WHEN mid IS NOT NULL THEN round(greatest(mid - half, 0), 4)::DOUBLE END AS low, CASE WHEN mid IS NOT NULL THEN round(least(mid + half, 1), 4)::DOUBLE END AS high FROM w LEFT JOIN i USING (metric)""")
def eva9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of three kinds by video; the videos of one rest are not available."""
    c = ad.table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 20).alias("video_id")).agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("tp"), F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("quality") == F.col("toxic")).alias("same"), F.count("*").alias("n"))
    each = [F.struct(F.lit(m).alias("metric"), p.alias("part"), F.col(w).alias("whole")) for m, p, w in (("detection_precision", F.col("tp"), "t"), ("qa_abstention_accuracy", F.col("same"), "n"), ("ocr_cer", 3 * F.col("t"), "n"))]
    m = c.select("video_id", F.explode(F.array(*each)).alias("m")).select("video_id", "m.*")
    status = F.when(F.col("video_id") % 7 == 3, "missing_modality").otherwise("available")
    return va.aggregate_rates(m.select("*", status.alias("status"), F.when(F.col("whole") > 0, F.col("part") / F.col("whole")).alias("value")))


@query("eva14_references", f"""WITH {ad.POINTS}, e AS (SELECT track_id AS v, event_id, frame_number AS i, pts - CASE WHEN event_id % 9 = 0 THEN 1000 ELSE 0 END AS s FROM p)
SELECT 'non_monotonic' AS issue, event_id::VARCHAR AS id FROM (SELECT event_id, s, coalesce(lag(s) OVER (PARTITION BY v ORDER BY i, event_id), -1) AS ahead FROM e) WHERE s < ahead
UNION ALL SELECT 'negative_evidence_time', event_id::VARCHAR FROM p WHERE event_id % 6 = 0 UNION ALL SELECT 'ungrounded_track', event_id::VARCHAR FROM p WHERE event_id % 4 = 0 UNION ALL SELECT 'ungrounded_text', event_id::VARCHAR FROM p WHERE event_id % 7 = 0 UNION ALL SELECT 'ungrounded_segment', event_id::VARCHAR FROM p WHERE event_id % 5 = 0""")
def eva14_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = ad.trajectory_points(spark, sf_dir), F.col("event_id")
    e = p.select(F.col("track_id").alias("video_id"), "event_id", F.col("frame_number").alias("position"), (F.col("pts") - F.when(i % 9 == 0, 1000).otherwise(0)).alias("start"))
    track = F.when(i % 4 == 0, F.lit(-1)).when(i % 4 != 1, F.col("track_id"))
    cites = p.select("event_id", track.alias("track_id"), i.alias("observation_id"), F.when(i % 5 == 0, -1).otherwise(i).alias("segment_id"), (F.col("pts") - F.when(i % 6 == 0, 1e9).otherwise(0)).alias("timestamp_seconds"))
    return va.audit_references(e, cites, p, p.where(i % 7 != 0).select(i.alias("observation_id")), p.select(i.alias("segment_id")))


@query("sem7_evidence", f"""WITH {ad.SEGMENTS}, c AS (SELECT video_id AS v, segment_id AS k, "start" - 2 AS a, "end" + 2 AS b FROM s WHERE segment_id % 2 = 0),
src AS (SELECT v, k, 1 AS i, k + 1 AS g FROM c UNION ALL SELECT v, k, 2, k FROM c UNION ALL SELECT v, k, 3, k + 1 FROM c), sup AS (SELECT src.* FROM src JOIN s ON video_id = v AND segment_id = g),
ids AS (SELECT v, k, 0 AS o, 'e1' AS id FROM c UNION ALL SELECT v, k, i * 10, 'e' || (g % 6) FROM sup UNION ALL SELECT v, k, i * 10 + 1, 'e' || (g % 4) FROM sup),
ev AS (SELECT v, k, string_agg(id, ',' ORDER BY o) AS evidence_ids FROM (SELECT v, k, id, min(o) AS o FROM ids GROUP BY ALL) GROUP BY ALL),
seen AS (SELECT v, k, 0 AS o, "start" AS t, segment_id::VARCHAR AS id, 'note ' || (segment_id % 4) AS x FROM c JOIN s ON video_id = v AND "start" <= b AND "start" + 1 >= a WHERE segment_id % 2 = 1),
told AS (SELECT v, k, 1 AS o, min(i)::DOUBLE AS t, arg_min(v || ':' || g, i) AS id, 'note ' || (g % 4) AS x FROM sup WHERE g % 3 = 0 AND NOT EXISTS (FROM seen WHERE seen.v = sup.v AND seen.k = sup.k AND seen.x = 'note ' || (g % 4)) GROUP BY v, k, g % 4),
tx AS (SELECT v, k, string_agg(id || '=' || x, ',' ORDER BY o, t, id) AS texts FROM (FROM seen UNION ALL FROM told) GROUP BY ALL),
zo AS (SELECT v, k, string_agg(z, ',' ORDER BY z) AS zones FROM (SELECT DISTINCT v, k, 'z' || (g % 2) AS z FROM sup WHERE g % 5 = 0) GROUP BY ALL)
SELECT c.v || ':' || c.k AS candidate_id, coalesce(texts, '') AS texts, coalesce(zones, '') AS zones, evidence_ids FROM c JOIN ev USING (v, k) LEFT JOIN tx USING (v, k) LEFT JOIN zo USING (v, k)""")
def sem7_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second turn is a candidate that names its follower, itself and its follower again as sources."""
    s, g = ad.transcript_segments(spark, sf_dir), F.col("segment_id")
    text = lambda *c: F.concat(*(x.cast("string") for x in c))
    at = lambda n: text(F.col("video_id"), F.lit(":"), n)
    note = text(F.lit("note "), g % 4)
    e = s.select(at(g).alias("event_id"), F.when(g % 3 == 0, note).alias("text"), F.lit(None).cast("string").alias("speech_text"), F.when(g % 5 == 0, text(F.lit("z"), g % 2)).alias("zone_name"), F.array(text(F.lit("e"), g % 6), text(F.lit("e"), g % 4)).alias("evidence_ids"))
    c = s.where(g % 2 == 0).select("video_id", at(g).alias("candidate_id"), (F.col("start") - 2).alias("start"), (F.col("end") + 2).alias("end"), F.array(at(g + 1), at(g), at(g + 1)).alias("source_event_ids"), F.array(F.lit("e1")).alias("evidence_ids"))
    seen = s.where(g % 2 == 1).select("video_id", g.alias("observation_id"), F.col("start").alias("first_seconds"), (F.col("start") + 1).alias("last_seconds"), note.alias("text"))
    out = ra.bundle_evidence(c, e, seen, s.limit(0))
    return out.select("candidate_id", F.array_join(F.transform("texts", lambda x: F.concat(x["id"], F.lit("="), x["text"])), ",").alias("texts"), F.array_join("zones", ",").alias("zones"), F.array_join("evidence_ids", ",").alias("evidence_ids"))
