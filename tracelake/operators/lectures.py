"""Lecture transcripts: windows, items, audits, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.exprs import fmt_ts, latex_ok, slug
from tracelake.functions.keywords import keyword_matches
from tracelake.functions.ordered import islands, thin

WINDOW_SECONDS, GAP, OVERLAP, MIN_WPM = 240.0, 2.0, 0.5, 50.0


def lecture_windows(segments: DataFrame, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """segments (video_id, segment_id, start, end, text) with window: a new one at the first segment at least seconds after its window's first."""
    starts = thin(segments.select("video_id", "segment_id", "start"), ["video_id"], "start", ["segment_id"], seconds).select("video_id", "segment_id", F.lit(True).alias("_new"))
    w = Window.partitionBy("video_id").orderBy("start", "segment_id")
    return segments.join(starts, ["video_id", "segment_id"], "left").withColumn("window", islands(F.coalesce("_new", F.lit(False)), w) - 1).drop("_new")


def extract_items(segments: DataFrame, rules: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Items that a rule table (kind, rule_no, keyword) finds in segments: the first rule of a kind that fires, with the segment as evidence.

    All rules are searched in one pass over each text, see keyword_matches. Null texts have no items; rows that repeat a segment count as one.
    """
    found = keyword_matches(segments.select("video_id", "segment_id", "start", "end", "text"), rules, word_boundary=word_boundary).join(rules.select("kind", "rule_no", "keyword"), "keyword")
    return found.groupBy("video_id", "segment_id", "kind").agg(F.min_by("keyword", F.struct("rule_no", "keyword")).alias("keyword"), F.min("text").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))


def sections(windows: DataFrame, items: DataFrame, title_rules: DataFrame) -> DataFrame:
    """One row per window: bounds, title by the first rule (rule_no, keyword, title) that fires, opening and closing text, and the middle segment where no item was found."""
    o = F.struct("start", "segment_id")
    s = windows.groupBy("video_id", "window").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("text", o).alias("opening"), F.max_by("text", o).alias("closing"), F.count("*").alias("n_segments"))
    fired = keyword_matches(windows.select("video_id", "window", "text"), title_rules).join(title_rules.select("rule_no", "keyword", "title"), "keyword")
    titles = fired.groupBy("video_id", "window").agg(F.min_by("title", F.struct("rule_no", "title")).alias("title"))
    mid = windows.withColumn("_r", F.row_number().over(Window.partitionBy("video_id", "window").orderBy("start", "segment_id"))).withColumn("_n", F.count("*").over(Window.partitionBy("video_id", "window"))).where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select("video_id", "window", F.col("segment_id").alias("middle"))
    has = windows.join(items.select("video_id", "segment_id").distinct(), ["video_id", "segment_id"], "left_semi").select("video_id", "window").distinct()
    bare = mid.join(has, ["video_id", "window"], "left_anti").withColumnRenamed("middle", "fallback_segment")
    return s.join(titles, ["video_id", "window"], "left").join(bare, ["video_id", "window"], "left").withColumn("title", F.coalesce("title", F.concat(F.lit("Part "), (F.col("window") + 1).cast("string"))))


def uncertainties(segments: DataFrame, min_confidence: float = 0.40, noise: tuple[str, ...] = ("[inaudible]", "[noise]", "[music]")) -> DataFrame:
    """(video_id, segment_id, issue): unsure or noisy segments, and recordings of 5 minutes on with under MIN_WPM words a minute (segment_id null)."""
    noisy = F.exists(F.array(*map(F.lit, noise)), lambda n: F.contains(F.lower("text"), n))
    c = segments.select("video_id", "segment_id", F.explode(F.filter(F.array(F.when(F.col("confidence") < min_confidence, F.lit("low_confidence")), F.when(noisy, F.lit("noise"))), lambda x: x.isNotNull())).alias("issue"))
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    v = segments.groupBy("video_id").agg(F.sum(words).alias("w"), (F.max("end") - F.min("start")).alias("span")).where((F.col("span") >= 300) & (F.col("w") / (F.col("span") / 60) < MIN_WPM))
    return c.unionByName(v.select("video_id", F.lit(None).cast(segments.schema["segment_id"].dataType).alias("segment_id"), F.lit("abridged").alias("issue")))


def audit_transcripts(segments: DataFrame, videos: DataFrame | None = None, expected_wpm: float = 130.0) -> DataFrame:
    """Per video: span, coverage, words, density, gaps over 2 s, overlaps over 0.5 s, empty and repeated segments, and a verdict."""
    w = Window.partitionBy("video_id").orderBy("start", "end", "segment_id")
    gap = F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    text = F.trim(F.coalesce("text", F.lit("")))
    s = segments.select("video_id", "start", "end", text.alias("text"), gap.alias("gap"), (F.lag(text).over(w) == text).alias("again"), F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+"))).alias("words"))
    a = s.groupBy("video_id").agg(
        F.count("*").alias("n_segments"), (F.max("end") - F.min("start")).alias("span"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start")).alias("spoken"), F.sum("words").alias("words"),
        F.count_if(F.col("gap") > GAP).alias("gaps"), F.count_if(F.col("gap") < -OVERLAP).alias("overlaps"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("again") & (F.col("text") != "")).alias("repeated"),
    )
    a = a.withColumn("duration", F.col("span")) if videos is None else a.join(videos.select("video_id", "duration_seconds"), "video_id", "left").withColumn("duration", F.coalesce("duration_seconds", "span")).drop("duration_seconds")
    expected = F.floor(F.col("duration") / 60 * expected_wpm)
    a = a.withColumn("coverage", F.round(F.least(F.lit(1.0), F.when(F.col("duration") > 0, F.col("spoken") / F.col("duration"))), 4)).withColumn("wpm", F.round(F.when(F.col("duration") > 0, F.col("words") / (F.col("duration") / 60)), 2)).withColumn("density", F.round(F.when(expected > 0, F.col("words") / expected), 4))
    return a.withColumn("verdict", F.when((F.col("coverage") >= 0.9) & (F.col("gaps") == 0), "complete").when(F.col("coverage") >= 0.5, "partial").otherwise("sparse"))


def note_status(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Coverage in per cent of each video (video_id, duration_seconds) and complete (from 90), partial or awaiting_transcript."""
    s = segments.groupBy("video_id").agg(F.sum(F.col("end") - F.col("start")).alias("spoken"))
    j = videos.join(s, "video_id", "left").withColumn("coverage", F.round(F.least(F.lit(100.0), 100 * F.col("spoken") / F.col("duration_seconds")), 2))
    return j.select("video_id", "coverage", F.when(F.col("spoken").isNull(), "awaiting_transcript").when(F.col("coverage") >= 90, "complete").otherwise("partial").alias("status"))


def validate_notes(items: DataFrame, videos: DataFrame) -> DataFrame:
    """Per note: items with and without evidence, whether formulas are well formed and times within the recording (and 5 s)."""
    j = items.join(videos.select("video_id", "duration_seconds"), "video_id", "left")
    return j.groupBy("video_id").agg(F.count_if(F.size("evidence_ids") > 0).alias("grounded"), F.count_if(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0).alias("unsupported"), F.coalesce(F.bool_and(F.when(F.col("kind") == "formula", latex_ok(F.col("text")))), F.lit(True)).alias("formulas_ok"), F.bool_and(F.col("end") <= F.col("duration_seconds") + 5).alias("times_ok"))


def evaluate_notes(items: DataFrame, concepts: DataFrame, videos: DataFrame) -> DataFrame:
    """Per note: unsupported rate, formula fidelity, time accuracy, concept coverage, duplicate rate and whether to accept it. concepts: video_id, concept."""
    j = items.join(videos.select("video_id", "duration_seconds"), "video_id", "left")
    rate = lambda c, n: F.round(c / n, 4)
    a = j.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0).alias("u"), F.count_if(F.col("kind") == "formula").alias("nf"), F.count_if((F.col("kind") == "formula") & latex_ok(F.col("text"))).alias("f"), F.count_if(F.col("end") <= F.col("duration_seconds") + 5).alias("t"), F.count_distinct(F.lower("text")).alias("d"))
    texts = items.select("video_id", F.lower("text").alias("text"))
    held = concepts.join(texts, "video_id").where(F.contains("text", F.lower("concept"))).select("video_id", "concept").distinct().groupBy("video_id").agg(F.count("*").alias("held"))
    wanted = concepts.groupBy("video_id").agg(F.count_distinct("concept").alias("wanted"))
    a = a.join(wanted, "video_id", "left").join(held, "video_id", "left")
    out = a.select("video_id", rate(F.col("u"), F.col("n")).alias("unsupported_rate"), F.when(F.col("nf") > 0, rate(F.col("f"), F.col("nf"))).otherwise(1.0).alias("formula_fidelity"), rate(F.col("t"), F.col("n")).alias("time_accuracy"), F.when(F.col("wanted") > 0, rate(F.coalesce("held", F.lit(0)), F.col("wanted"))).otherwise(1.0).alias("concept_coverage"), rate(F.col("n") - F.col("d"), F.col("n")).alias("duplicate_rate"))
    return out.withColumn("accept", (F.col("unsupported_rate") <= 0.05) & (F.col("formula_fidelity") >= 0.95) & (F.col("concept_coverage") >= 0.7))


def topic_index(items: DataFrame) -> DataFrame:
    """(concept, video_id, kinds): the notes of each concept with their item kinds, sorted; one row a note, as a concept may be in all of them."""
    return items.groupBy(F.lower("keyword").alias("concept"), "video_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def pending_videos(catalog: DataFrame, jobs: DataFrame, retry: bool = False) -> DataFrame:
    """Videos to work on: not private or deleted, and not complete already unless retried."""
    open_ = catalog.where(~F.coalesce(F.col("availability").isin("private", "deleted"), F.lit(False)))
    return open_ if retry else open_.join(jobs.where("status = 'complete'").select("video_id").distinct(), "video_id", "left_anti")


def job_rollup(jobs: DataFrame, keys: list[str]) -> DataFrame:
    states = ("complete", "partial", "failed", "awaiting_transcript", "pending")
    return jobs.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in states))


def playlist_index(jobs: DataFrame, notes: DataFrame) -> DataFrame:
    """Position, title, duration label, status and note key of each video of a playlist."""
    j = jobs.join(notes.select("video_id", F.lit(True).alias("_has")), "video_id", "left")
    return j.select("position", "video_id", "title", fmt_ts(F.col("duration_seconds")).alias("duration"), "status", F.when(F.col("_has"), F.concat(F.format_string("%03d-", "position"), slug(F.col("title")))).alias("note_key"))
