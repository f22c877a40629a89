"""Queries of ranking, lookups, evaluation, lectures and text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import exprs as ex
from tracelake.functions.shared import shared_folder
from tracelake.operators import evaluation as va
from tracelake.operators import lectures as le
from tracelake.operators import lookups as lo
from tracelake.operators import ranking as ra
from tracelake.plans.queries import query
from tracelake.sources import adapters as ad
from tracelake.sources import io
from tracelake.sources.versions import VersionedTable

_IV = "i AS (SELECT track_id, event_id, event_type, pts AS s, pts + value / 100 AS e, confidence FROM p)"
_CL = """cl AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY s, e, event_id) AS cluster
  FROM (SELECT *, max(e) OVER (PARTITION BY track_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i))"""
_TYPES = [("purchase", 0.9), ("signup", 0.7), ("click", 0.4), ("view", 0.2)]


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.intervals(spark, sf_dir).withColumn("video_id", F.col("track_id"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ra.cluster_events(_intervals(spark, sf_dir)).withColumn("severity", F.when(F.col("event_id") % 5 == 0, "high").otherwise("low")).withColumn("source_module", F.when(F.col("event_id") % 3 == 0, "audio").otherwise("vision"))
    return ra.score_clusters(e, spark.createDataFrame(_TYPES, "event_type string, type_weight double"), spark.createDataFrame([("high", 0.8), ("low", 0.3)], "severity string, severity_weight double"))


_SC = f"""sc AS (
  SELECT track_id AS video_id, cluster, min(s) AS s, max(e) AS e, count(*) AS n_events,
    round(least(1.0, 0.4 * max(CASE WHEN event_id % 5 = 0 THEN 0.8 ELSE 0.3 END) + 0.3 * max(CASE event_type {' '.join(f"WHEN '{t}' THEN {w}" for t, w in _TYPES)} ELSE 0.3 END) + 0.3 * avg(confidence)
      + CASE WHEN count(DISTINCT event_id % 3 = 0) > 1 THEN 0.25 ELSE 0 END + least(0.15, 0.03 * (count(*) - 1)))::DOUBLE + 1e-9, 4) AS saliency_score FROM cl GROUP BY ALL
)"""


@query("sem1_clusters", f'WITH {ad.POINTS}, {_IV}, {_CL} SELECT track_id AS video_id, cluster::BIGINT AS cluster, count(*) AS n, min(s) AS "start", max(e) AS "end" FROM cl GROUP BY ALL')
def sem1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.cluster_events(_intervals(spark, sf_dir)).groupBy("video_id", "cluster").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("sem2_saliency", f"WITH {ad.POINTS}, {_IV}, {_CL}, {_SC} SELECT video_id, cluster::BIGINT AS cluster, n_events, saliency_score FROM sc")
def sem2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("video_id", "cluster", "n_events", "saliency_score")


@query("sem3_query_relevance", """WITH q AS (SELECT 1 AS query_id, ['the', 'lost'] AS w UNION ALL SELECT 2, ['die', 'eine', 'blue'])
SELECT doc_id AS video_id, 0 AS cluster, query_id, round(len(list_filter(w, lambda x: contains(lower(text), x))) / len(w), 4) AS query_relevance_score FROM documents, q""")
def sem3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.lit(0).alias("cluster"), F.col("text").alias("corpus"))
    return ra.query_relevance(c, spark.createDataFrame([(1, "the lost and the"), (2, "Die eine, blue!")], "query_id int, query string"), ["and"])


@query("sem4_candidates", f"""WITH {ad.POINTS}, {_IV}, {_CL}, {_SC}, c AS (SELECT *, CASE WHEN saliency_score >= 0.8 THEN 1 WHEN saliency_score >= 0.6 THEN 2 ELSE 3 END AS priority FROM sc WHERE saliency_score >= 0.4)
SELECT video_id, cluster::BIGINT AS cluster, priority, row_number() OVER (PARTITION BY video_id ORDER BY priority, saliency_score DESC, s, cluster) AS rank, CASE WHEN priority = 1 THEN 'critical' ELSE 'salient' END AS reason FROM c""")
def sem4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.gate(ra.candidates(_scored(spark, sf_dir))).select("video_id", "cluster", "priority", "rank", "reason")


@query("sem6_keyframes", f"""WITH {ad.POINTS}, {_IV}, {_CL}, {_SC}, t AS (SELECT video_id, cluster, s, e FROM sc)
SELECT video_id, cluster::BIGINT AS candidate_id, k AS position, CASE k WHEN 0 THEN s WHEN 1 THEN round((s + e) / 2 + 1e-9, 3) ELSE e END AS t FROM t, (VALUES (0), (1), (2)) v(k) WHERE k = 0 OR e - s > 0.1""")
def sem6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _scored(spark, sf_dir).withColumnRenamed("cluster", "candidate_id")
    return ra.keyframe_targets(c)


@query("sem10_usage", f"WITH {ad.POINTS} SELECT event_id AS request_id, count(*) OVER w AS window_requests, sum(100 + event_id % 50) OVER w AS window_tokens FROM p WINDOW w AS (PARTITION BY track_id ORDER BY pts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)")
def sem10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir).select(F.col("track_id").alias("budget_key"), F.col("event_id").alias("request_id"), F.col("pts").alias("t"), (100 + F.col("event_id") % 50).alias("tokens"))
    return ra.usage_snapshot(p).select("request_id", "window_requests", "window_tokens")


@query("sem10_admit", f"""WITH RECURSIVE {ad.POINTS}, q AS (SELECT track_id, event_id, pts, row_number() OVER (PARTITION BY track_id ORDER BY pts, event_id) AS k FROM p), r AS (
  SELECT track_id, event_id, k, pts, [pts] AS held, true AS ok FROM q WHERE k = 1
  UNION ALL
  SELECT q.track_id, q.event_id, q.k, q.pts, CASE WHEN len(list_filter(held, lambda t: q.pts - t < 60)) < 5 THEN list_append(list_filter(held, lambda t: q.pts - t < 60), q.pts) ELSE list_filter(held, lambda t: q.pts - t < 60) END, len(list_filter(held, lambda t: q.pts - t < 60)) < 5
  FROM r JOIN q ON q.track_id = r.track_id AND q.k = r.k + 1)
SELECT event_id AS request_id, ok AS admitted FROM r""")
def sem10_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir).select(F.col("track_id").alias("budget_key"), F.col("event_id").alias("request_id"), F.col("pts").alias("t"), F.lit(1).cast("long").alias("tokens"))
    return ra.admit(p, max_requests=5).select("request_id", "admitted")


@query("sem12_reuse", f"""WITH {ad.POINTS}, q AS (SELECT event_id, track_id AS f, pts AS t FROM p WHERE event_id % 2 = 0), r AS (SELECT event_id AS result_id, track_id AS f, pts AS t FROM p WHERE event_id % 2 = 1)
SELECT q.event_id AS request_id, arg_max(result_id, r.t * 1000000 + result_id / 1000000.0) AS result_id FROM q LEFT JOIN r ON q.f = r.f AND q.t - r.t >= 0 AND q.t - r.t < 30 GROUP BY 1""")
def sem12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.trajectory_points(spark, sf_dir).select("event_id", F.col("track_id").alias("fingerprint"), F.col("pts").alias("t"))
    return ra.reuse_results(p.where("event_id % 2 = 0").withColumnRenamed("event_id", "request_id"), p.where("event_id % 2 = 1").withColumnRenamed("event_id", "result_id"), 30.0).select("request_id", "result_id")


# ---- lookups


@query("inv1_search_events", f"""WITH {ad.POINTS}, {_IV} SELECT q.track_id AS request_id, count(*) AS n FROM (SELECT DISTINCT track_id, 20.0 AS a, 60.0 AS b FROM p) q JOIN i ON i.track_id = q.track_id AND s <= b AND e >= a AND event_type = 'click' GROUP BY 1""")
def inv1(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _intervals(spark, sf_dir)
    r = i.select("video_id").distinct().select(F.col("video_id").alias("request_id"), "video_id", F.lit(20.0).alias("w_start"), F.lit(60.0).alias("w_end"), F.lit("click").alias("wanted_type"))
    return lo.search_events(r, i).groupBy("request_id").agg(F.count("*").alias("n"))


@query("inv14_seek", f"""WITH {ad.POINTS}, q AS (SELECT DISTINCT track_id, 100.3 AS t FROM p), j AS (SELECT q.track_id AS request_id, frame_number AS frame_id, row_number() OVER (PARTITION BY q.track_id ORDER BY abs(pts - t), frame_number) AS r, pts FROM q JOIN p USING (track_id))
SELECT q.track_id AS request_id, frame_id, pts FROM q LEFT JOIN (SELECT * FROM j WHERE r = 1) x ON x.request_id = q.track_id""")
def inv14(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ad.trajectory_points(spark, sf_dir).select(F.col("track_id").alias("video_id"), F.col("frame_number").alias("frame_id"), "pts")
    r = f.select("video_id").distinct().select(F.col("video_id").alias("request_id"), "video_id", F.lit(100.3).alias("t"))
    return lo.seek(r, f).select("request_id", "frame_id", "pts")


@query("prj16_questions", r"""SELECT doc_id AS request_id, CASE WHEN regexp_matches(q, 'ocr|text|license plate|sign|words appeared') THEN 'ocr' WHEN regexp_matches(q, 'transcript|said|speech|spoken|audio|hear') THEN 'audio' WHEN regexp_matches(q, 'interact|why|intent|suspicious|fighting|stealing|weapon') THEN 'semantic'
  WHEN regexp_matches(q, '\btrack(_id)?\b\s*[:#]?\s*([a-z0-9_-]+)\b|track ') THEN 'track' WHEN regexp_matches(q, '(between|from)\s+\d+(\.\d+)?\s+(and|to)\s+\d|seconds|timeline') THEN 'temporal' WHEN regexp_matches(q, 'spatial|near|next to|overlap|zone|vicinity') THEN 'spatial'
  WHEN regexp_matches(q, 'related|neighbor|follow|precede|before event|after') THEN 'relational' WHEN contains(q, 'event') THEN 'event' WHEN regexp_matches(q, 'car|vehicle|person|dog|object') THEN 'object' ELSE 'general' END AS category,
  nullif(regexp_extract(text, '(?i)\btrack(?:_id)?\b\s*[:#]?\s*([a-zA-Z0-9_-]+)\b', 1), '') AS track_id, nullif(regexp_extract(text, '(?i)\bevent(?:_id)?\b\s*[:#]?\s*([a-zA-Z0-9_-]+)\b', 1), '') AS event_id FROM (SELECT doc_id, text, lower(coalesce(text, '')) AS q FROM documents)""")
def prj16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("question"))
    return lo.classify_questions(d).select("request_id", "category", "track_id", "event_id")


# ---- evaluation

_MATCH = """g AS (SELECT video_id, event_id AS id, pts AS t, (track_id % 5)::VARCHAR AS c, x, y, w, h FROM p WHERE event_id % 10 <> 0), d AS (SELECT video_id, event_id + 1000000 AS id, pts AS t, (track_id % 5)::VARCHAR AS c, x + event_id % 7 AS x, y, w, h FROM p WHERE event_id % 11 <> 0), pr AS (
  SELECT *, i / (a - i) AS weight FROM (SELECT g.video_id, g.c, g.id AS g_id, d.id AS p_id, greatest(least(g.x + g.w, d.x + d.w) - greatest(g.x, d.x), 0) * greatest(least(g.y + g.h, d.y + d.h) - greatest(g.y, d.y), 0) AS i, g.w * g.h + d.w * d.h AS a FROM g JOIN d ON g.video_id = d.video_id AND g.c = d.c AND abs(g.t - d.t) <= 0.1) WHERE i / (a - i) >= 0.5
)"""


def _truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = ad.detections(spark, sf_dir).select("video_id", F.col("detection_id").alias("id"), F.col("pts").alias("t"), "class_name", "bbox")
    moved = d.where("id % 11 <> 0").withColumn("bbox", F.col("bbox").withField("x", F.col("bbox.x") + F.col("id") % 7)).withColumn("id", F.col("id") + 1_000_000)
    return d.where("id % 10 <> 0"), moved


@query("eva1_detection_pairs", f"WITH {ad.POINTS}, {_MATCH} SELECT video_id, g_id, p_id, round(weight, 4) AS weight FROM pr")
def eva1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.detection_pairs(*_truth(spark, sf_dir)).select("video_id", "g_id", "p_id", F.round("weight", 4).alias("weight"))


@query("eva3_match_optimal")
def eva3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.match_detections(*_truth(spark, sf_dir), "optimal").select("video_id", "g_id", "p_id")


@query("eva4_prf")
def eva4(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _truth(spark, sf_dir)
    return va.prf(va.match_detections(g, p), g, p)


@query("eva5_char_errors")
def eva5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next, whole texts; SQL counts edits in bytes, so tests hold the operator to brute force."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("ref"), F.lead("text").over(w).alias("hyp")).where("hyp IS NOT NULL")
    return va.error_rates(t).select("conv_id", "turn", "n_ref", "substitutions", "deletions", "insertions", F.round("error_rate", 6).alias("error_rate"))


@query("eva6_qa_abstention", """WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn, count(*) FILTER (quality = 1 AND toxic = 0) AS tn FROM labels)
SELECT tp, fp, fn, tn, 0::BIGINT AS missing, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1,
round((((tp + tn) / n + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt((tp + tn) / n * (1 - (tp + tn) / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS low, round((((tp + tn) / n + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt((tp + tn) / n * (1 - (tp + tn) / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS high FROM (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM c)""")
def eva6(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ad.table(spark, sf_dir, "labels")
    return va.qa_abstention(labels.select(F.col("doc_id").alias("qa_id"), (F.col("quality") == 1).alias("is_answerable")), labels.select(F.col("doc_id").alias("qa_id"), (F.col("toxic") == 1).alias("did_abstain"))).withColumns({"low": F.col("accuracy_ci.low"), "high": F.col("accuracy_ci.high")}).drop("accuracy_ci", "precision_ci", "recall_ci")


@query("eva13_latency", """SELECT event_type, count(*) AS n, round(avg(value), 2) AS mean, round(quantile_cont(value, 0.5), 2) AS median, round(quantile_cont(value, 0.95), 2) AS p95, round(min(value), 2) AS min, round(max(value), 2) AS max, round(stddev_samp(value), 2) AS stdev, round(1000 * count(*) / sum(value), 2) AS throughput FROM events GROUP BY 1""")
def eva13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.latency_stats(ad.table(spark, sf_dir, "events"), ["event_type"], "value")


@query("eva15_corpus_report", f"WITH {ad.POINTS} SELECT video_id, count(*) AS detections, count(DISTINCT track_id) AS tracks FROM p GROUP BY 1")
def eva15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.detections(spark, sf_dir)
    return va.corpus_report(detections=d, tracks=d.select("video_id", "track_id").distinct())


@query("prj17_wilson", """WITH k AS (SELECT doc_id % 50 AS g, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM labels GROUP BY 1), w AS (SELECT g, n, k, k / n AS p, 1.96 AS z FROM k)
SELECT g, round(greatest(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 4) AS low, round(least(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 4) AS high FROM w""")
def prj17(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ad.table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 50).alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    return k.select("g", ex.wilson(F.col("k"), F.col("n")).alias("w")).select("g", "w.low", "w.high")


# ---- lectures


@query("cmp1_windows", f"""WITH RECURSIVE {ad.SEGMENTS}, k AS (
  SELECT video_id, min(segment_id) AS segment_id, min("start") AS a FROM s GROUP BY 1
  UNION ALL
  SELECT k.video_id, n.segment_id, n."start" FROM k JOIN s n ON n.video_id = k.video_id AND n.segment_id = (SELECT min(q.segment_id) FROM s q WHERE q.video_id = k.video_id AND q."start" - k.a >= 12)
) SELECT s.video_id, s.segment_id, (SELECT count(*) FROM k WHERE k.video_id = s.video_id AND k.a <= s."start") - 1 AS "window" FROM s""")
def cmp1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return le.lecture_windows(ad.transcript_segments(spark, sf_dir), 12.0).select("video_id", "segment_id", "window")


@query("cmp2_items", f"""WITH {ad.SEGMENTS}, r AS (SELECT * FROM (VALUES ('definition', 1, 'the'), ('definition', 2, 'die'), ('example', 1, 'ing')) v(kind, rule_no, keyword))
SELECT video_id, segment_id, kind, arg_min(keyword, rule_no) AS keyword FROM s, r WHERE contains(lower(text), keyword) GROUP BY ALL""")
def cmp2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("definition", 1, "the"), ("definition", 2, "die"), ("example", 1, "ing")], "kind string, rule_no int, keyword string")
    return le.extract_items(ad.transcript_segments(spark, sf_dir), rules).select("video_id", "segment_id", "kind", "keyword")


@query("cmp5_audit", f"""WITH {ad.SEGMENTS}, q AS (SELECT video_id, "start" AS a, "end" AS b, trim(text) AS t, "start" - max("end") OVER (PARTITION BY video_id ORDER BY "start", "end", segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM s)
SELECT video_id, count(*) AS n_segments, max(b) - min(a) AS span, count(*) FILTER (gap > 2) AS gaps, count(*) FILTER (gap < -0.5) AS overlaps, count(*) FILTER (t = '') AS empty, round(least(1, sum(b - a) / (max(b) - min(a))), 4) AS coverage, sum(len(regexp_split_to_array(t, '\\s+')))::BIGINT AS words FROM q GROUP BY 1""")
def cmp5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return le.audit_transcripts(ad.transcript_segments(spark, sf_dir)).select("video_id", "n_segments", "span", "gaps", "overlaps", "empty", "coverage", "words")


@query("prj12_links", r"""SELECT coalesce(nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{11})(?:[&#]|$)', 1), ''), nullif(regexp_extract(url, 'youtu\.be/([A-Za-z0-9_-]{11})(?:[?&#/]|$)', 1), ''), nullif(regexp_extract(url, '/(?:embed|shorts|live)/([A-Za-z0-9_-]{11})(?:[?&#/]|$)', 1), ''), nullif(regexp_extract(url, '^([A-Za-z0-9_-]{11})$', 1), '')) AS video_id,
  nullif(regexp_extract(url, '[?&]list=([A-Za-z0-9_-]+)', 1), '') AS playlist_id, count(*) AS n_links FROM pages GROUP BY 1, 2""")
def prj12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.link_catalog(ad.table(spark, sf_dir, "pages"))


@query("prj22_slug", r"""SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s_-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 120) AS slug FROM documents""")
def prj22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "documents").select("doc_id", ex.slug(F.col("text")).alias("slug"))


@query("prj11_time_text", f"""WITH {ad.POINTS} SELECT event_id, CASE WHEN pts * 60 >= 3600 THEN printf('%02d:%02d:%02d', (floor(pts * 60)::BIGINT // 3600), (floor(pts * 60)::BIGINT % 3600) // 60, floor(pts * 60)::BIGINT % 60) ELSE printf('%02d:%02d', floor(pts * 60)::BIGINT // 60, floor(pts * 60)::BIGINT % 60) END AS label, floor(pts * 60)::DOUBLE AS back FROM p""")
def prj11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = ex.fmt_ts(F.col("pts") * 60)
    return ad.trajectory_points(spark, sf_dir).select("event_id", label.alias("label"), ex.parse_ts(label).alias("back"))


@query("src7_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def src7(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 3 = 0")
    writes = new.select("o_orderkey", F.lit("new").alias("status"), F.lit(2).alias("at")).unionByName(new.select("o_orderkey", F.lit("overwritten").alias("status"), F.lit(1).alias("at")))
    return io.upsert_by_key(o, writes, "o_orderkey", "at")


@query("str6_versions", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'v4' WHEN o_orderkey % 4 = 0 THEN 'v3' WHEN o_orderkey % 3 = 0 THEN 'v2' WHEN o_orderkey % 2 = 0 THEN 'v1' ELSE o_orderstatus END AS status FROM orders""")
def str6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, then four epochs that each rewrite every second to fifth order, merged on the way."""
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    t = VersionedTable(spark, shared_folder(spark, "versions"), "o_orderkey", buckets=8, fanout=2)
    t.put(o, 0)
    for epoch in range(1, 5):
        t.put(o.where(F.col("o_orderkey") % (epoch + 1) == 0).withColumn("status", F.lit(f"v{epoch}")), epoch)
    return t.read()


def _json_lines(df: DataFrame) -> str:
    """Writes df's rows as JSON lines and returns the folder."""
    path = shared_folder(df.sparkSession, "json")
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).write.text(path)
    return path


def _hundreds(spark: SparkSession, sf_dir: str, items: Column) -> DataFrame:
    """(video_id, block, items): the turns of each conversation by the hundred."""
    c = ad.transcript_segments(spark, sf_dir).withColumn("block", F.floor(F.col("segment_id") / 100))
    return c.groupBy(F.col("video_id").cast("string").alias("video_id"), "block").agg(F.collect_list(items).alias("items"))


@query("src1_annotations", f"WITH {ad.SEGMENTS} SELECT video_id::VARCHAR AS video_id, segment_id::VARCHAR AS transcript_id, \"start\" AS start_seconds, \"end\" AS end_seconds, text AS reference_text FROM s")
def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("segment_id").cast("string").alias("transcript_id"), F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), F.col("text").alias("reference_text"))
    docs = _hundreds(spark, sf_dir, item).select(F.array(F.struct("video_id", F.struct(F.lit("annotated").alias("status"), "items").alias("transcripts"))).alias("videos"))
    return io.read_annotations(spark, _json_lines(docs), lines=True)["transcripts"]


@query("src1_status", """WITH v AS (SELECT DISTINCT conv_id AS v, turn // 100 AS b FROM conversations), m AS (SELECT unnest(['detections', 'events', 'qa', 'ocr', 'transcripts']) AS modality)
SELECT v::VARCHAR AS video_id, modality, CASE WHEN modality = 'ocr' AND v % 2 = 0 THEN 'annotated' WHEN modality = 'ocr' THEN 'pending' ELSE 'not_annotated' END AS status, CASE WHEN modality = 'ocr' AND v % 2 = 0 THEN 0 END AS n FROM v, m""")
def src1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A modality annotated as empty, one pending without items and four that are missing stay apart."""
    none = F.array().cast("array<struct<ocr_id:string>>")
    even = F.col("video_id").cast("long") % 2 == 0
    ocr = F.when(even, F.struct(F.lit("annotated").alias("status"), none.alias("items"))).otherwise(F.struct(F.lit("pending").alias("status"), F.lit(None).cast("array<struct<ocr_id:string>>").alias("items")))
    docs = _hundreds(spark, sf_dir, F.lit(1)).select(F.array(F.struct("video_id", ocr.alias("ocr"))).alias("videos"))
    return io.read_annotations(spark, _json_lines(docs), lines=True)["status"]


@query("src2_predictions", f"WITH {ad.SEGMENTS} SELECT video_id::VARCHAR AS video_id, segment_id::VARCHAR AS event_id, CASE WHEN segment_id % 3 = 0 THEN 0.25 ELSE 1 END::DOUBLE AS confidence, \"start\" AS start_seconds FROM s")
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes: a list for even ids, a map for odd ones; a missing confidence is 1."""
    item = F.struct(F.col("segment_id").cast("string").alias("event_id"), F.when(F.col("segment_id") % 3 == 0, 0.25).alias("confidence"), F.col("start").alias("start_seconds"))
    v, even = _hundreds(spark, sf_dir, item), F.col("video_id").cast("long") % 2 == 0
    listed = v.where(even).select(F.array(F.struct("video_id", F.col("items").alias("events"))).alias("videos"))
    path = _json_lines(listed)
    v.where(~even).select(F.to_json(F.create_map("video_id", F.struct(F.col("items").alias("events"))))).write.mode("append").text(path)
    return io.read_predictions(spark, path, lines=True)["events"].select("video_id", "event_id", "confidence", "start_seconds")


@query("src5_catalog", "SELECT 'doc-' || doc_id AS video_id, n_chars / 10.0::DOUBLE AS duration_seconds, doc_id % 2 = 0 AS has_audio, (doc_id % 4)::INT AS n_scenes FROM documents")
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = F.slice(F.array(*(F.struct(F.lit(i).alias("scene_index")) for i in range(3))), 1, (F.col("doc_id") % 4).cast("int"))
    video = F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("filename"), (F.col("n_chars") / 10.0).alias("duration_seconds"), (F.col("doc_id") % 2 == 0).alias("has_audio"), scenes.alias("scenes"))
    docs = ad.table(spark, sf_dir, "documents").select(F.array(video).alias("videos"))
    return io.video_catalog(spark, _json_lines(docs), lines=True).select("video_id", "duration_seconds", "has_audio", "n_scenes")
