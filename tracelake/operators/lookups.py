"""Lookups over a table of requests, claims from their results, and claim checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.keywords import keyword_matches
from tracelake.functions.ordered import range_join

#: Question categories in the order in which their rules are tried: words that the lower-case question contains (fixed values).
QUESTION_RULES = [
    ("ocr", ["ocr", "text", "license plate", "sign", "words appeared"]),
    ("audio", ["transcript", "said", "speech", "spoken", "audio", "hear"]),
    ("semantic", ["interact", "interaction", "why", "intent", "suspicious", "fighting", "stealing", "weapon"]),
    ("track", ["track "]),
    ("temporal", ["seconds", "timeline"]),
    ("spatial", ["spatial", "near", "next to", "overlap", "zone", "vicinity"]),
    ("relational", ["related", "neighbor", "follow", "precede", "before event", "after"]),
    ("event", ["event"]),
    ("object", ["car", "vehicle", "person", "dog", "object"]),
]
#: Patterns of a time window, and of the track and event that a question names (fixed values); a question that has one is of that category too.
WINDOW = r"(?i)(?:between|from)\s+(\d+(?:\.\d+)?)\s+(?:and|to)\s+(\d+(?:\.\d+)?)\s*(?:s|sec|seconds)?"
TRACK = r"(?i)\btrack(?:_id)?\b\s*[:#]?\s*([a-zA-Z0-9_\-]+)\b"
EVENT = r"(?i)\bevent(?:_id)?\b\s*[:#]?\s*([a-zA-Z0-9_\-]+)\b"
PATTERNS = {"track": TRACK, "temporal": WINDOW, "event": EVENT}
#: Labels of what a claim rests on (fixed values).
OBSERVED, ASSOCIATED, MODELLED, NOTHING = "deterministically observed", "heuristically associated", "VLM inferred", "insufficient evidence"
HEURISTIC, SEMANTIC = ("heuristic", "heuristic_association"), ("semantic_inference", "vlm_inference", "inferred")


def classify_questions(questions: DataFrame) -> DataFrame:
    """questions (request_id, question) with category (first rule that fires, else general), time window, track and event id if named.

    A null question is general and names nothing.
    """
    q = F.lower("question")
    category = F.lit("general")
    for name, parts in reversed(QUESTION_RULES):
        fires = reduce(lambda a, b: a | b, (F.contains(q, F.lit(p)) for p in parts))
        category = F.when(fires | q.rlike(PATTERNS[name]) if name in PATTERNS else fires, name).otherwise(category)
    found = lambda pattern, group: F.nullif(F.regexp_extract("question", pattern, group), F.lit(""))
    return questions.select("*", category.alias("category"), found(WINDOW, 1).try_cast("double").alias("window_start"), found(WINDOW, 2).try_cast("double").alias("window_end"), found(TRACK, 1).alias("track_id"), found(EVENT, 1).alias("event_id"))


def epistemic(derivation: Column) -> Column:
    """What a derivation amounts to: inferred by a model, associated heuristically, else (null too) observed."""
    return F.when(derivation.isin(*SEMANTIC), MODELLED).when(derivation.isin(*HEURISTIC), ASSOCIATED).otherwise(OBSERVED)


def search_window(requests: DataFrame, rows: DataFrame, span: tuple[str, str], match: Column | None = None, limit: int | None = None, key: str = "node_id") -> DataFrame:
    """Rows whose interval meets a request's (request_id, video_id, w_start, w_end), optionally matching, the first `limit` of each request by key."""
    out = range_join(requests, rows, ["video_id"], ("w_start", "w_end"), span, bucket=30.0)
    out = out if match is None else out.where(match)
    if limit is None:
        return out
    w = Window.partitionBy("request_id").orderBy(key)
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def search_events(requests: DataFrame, events: DataFrame) -> DataFrame:
    """requests may name an event_type (wanted_type null: any)."""
    return search_window(requests, events, ("start", "end"), F.col("wanted_type").isNull() | (F.col("wanted_type") == F.col("event_type")))


def search_text(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that are seen in a request's window and hold its `contains` in any case (null: any text).

    The parts of all requests are searched in one pass over the texts; rows meet by video, part and time.
    """
    span = ("first_seconds", "last_seconds")
    parts = requests.where("contains IS NOT NULL").withColumn("keyword", F.lower("contains"))
    held = range_join(parts, keyword_matches(texts, parts), ["video_id", "keyword"], ("w_start", "w_end"), span, bucket=30.0).drop("keyword")
    return held.unionByName(search_window(requests.where("contains IS NULL"), texts, span))


def lookup(requests: DataFrame, rows: DataFrame, key: str, fallback: DataFrame | None = None) -> DataFrame:
    """requests (request_id, key) with the row of that key, from rows, else from fallback (same columns), and whether any was found."""
    first = requests.join(rows.withColumn("_hit", F.lit(True)), key, "left")
    if fallback is not None:
        names = [c for c in rows.columns if c != key]
        second = fallback.select(key, *(F.col(c).alias(f"_f_{c}") for c in names), F.lit(True).alias("_f_hit"))
        first = first.join(second, key, "left").select(key, *requests.drop(key).columns, *(F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_f_{c}")).alias(c) for c in names), F.coalesce("_hit", "_f_hit").alias("_hit"))
    return first.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def seek(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """The frame of its video nearest to each request's t (request_id, video_id, t), however far, the first by id of those as near; null where the video has none.

    The last frame before and the first after come from running windows over requests and
    frames together, of which each frame at one time with the smallest id is enough.
    """
    at = frames.where("pts IS NOT NULL").groupBy("video_id", "pts").agg(F.min("frame_id").alias("frame_id"))
    rows = at.select("video_id", F.col("pts").alias("_t"), F.struct("pts", "frame_id").alias("_f"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"))
    rows = rows.unionByName(requests.where("t IS NOT NULL").select("video_id", F.col("t").alias("_t"), F.lit(None).cast(rows.schema["_f"].dataType).alias("_f"), "request_id"))
    w = Window.partitionBy("video_id").orderBy("_t")
    near = rows.withColumn("_a", F.last("_f", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_b", F.first("_f", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))).where("request_id IS NOT NULL")
    apart = lambda f: F.abs(F.col(f"{f}.pts") - F.col("_t"))
    later = F.col("_a").isNull() | (apart("_b") < apart("_a")) | ((apart("_b") == apart("_a")) & (F.col("_b.frame_id") < F.col("_a.frame_id")))
    best = near.select("request_id", F.when(later & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col("_a")).alias("f"))
    return requests.join(best, "request_id", "left").select(*requests.columns, F.col("f.frame_id").alias("frame_id"), F.col("f.pts").alias("pts"))


def compare_frames(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """pairs (a_id, b_id) with the gap in seconds (3 decimals) and whether the second follows the first."""
    f = frames.select("frame_id", "video_id", "frame_number", "pts")
    j = pairs.join(f.toDF("a_id", "a_video", "a_frame", "a_pts"), "a_id").join(f.toDF("b_id", "b_video", "b_frame", "b_pts"), "b_id")
    return j.select("a_id", "b_id", F.round(F.abs(F.col("b_pts") - F.col("a_pts")), 3).alias("gap"), ((F.col("a_video") == F.col("b_video")) & (F.col("b_frame") == F.col("a_frame") + 1)).alias("sequential"))


def build_claims(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results as claims, and an abstention for each request (request_id, video_id, question, category) that gets none.

    results: request_id, kind, result_id, label, class_name, start, end, duration, speaker,
    confidence, evidence_ids, event_ids, participant_ids. Kinds and their texts and default
    confidences are below; other kinds make no claim, nor do events found for a semantic
    question, which are its background only. Text and speech without evidence cite themselves.
    """
    k, label, none = F.col("kind"), F.coalesce("label", F.lit("")), F.array().cast("array<string>")
    related, heard = k.isin("related_event", "temporal_neighbor", "spatial_neighbor"), k.isin("text", "speech")
    own = F.col("result_id").cast("string")
    texts = {
        "event": F.format_string("Observed event '%s' at %.1fs - %.1fs", F.coalesce("label", F.concat(F.lit("Event "), F.col("class_name"))), F.coalesce("start", F.lit(0.0)), F.coalesce("end", "start", F.lit(0.0))),
        "event_detail": F.format_string("Event %s (%s): %s", own, F.col("class_name"), label),
        "track": F.format_string("Track %s (%s) tracked for %.2fs", own, F.col("class_name"), F.coalesce("duration", F.lit(0.0))),
        "text": F.concat(F.lit('Detected on-screen text: "'), label, F.lit('"')),
        "speech": F.concat(F.lit("Spoken text detected"), F.coalesce(F.concat(F.lit(" by "), F.col("speaker")), F.lit("")), F.lit(': "'), label, F.lit('"')),
        "semantic": F.concat(F.lit("VLM semantic analysis: "), label),
    }
    text = F.when(related, F.concat(F.lit("Graph relation identified for "), own, F.lit(": "), F.coalesce("label", own)))
    for kind, x in texts.items():
        text = F.when(k == kind, x).otherwise(text)
    default = F.when(k == "semantic", 0.82).when(related, 0.88).when(heard, 0.9).otherwise(0.95)
    confidence = F.when(related, 0.88).when(k == "track", 0.95).otherwise(F.coalesce("confidence", default))
    evidence = F.when(heard & (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0), F.array(own)).otherwise(F.coalesce("evidence_ids", none))
    events = F.when(k.isin("event", "event_detail") | related, F.array(own)).otherwise(F.coalesce("event_ids", none))
    r = results.join(requests.select("request_id", "video_id", "category"), "request_id").where(~((k == "event") & (F.col("category") == "semantic")))
    status = F.when((k == "semantic") & (F.size(evidence) == 0), "insufficient_evidence").otherwise("supported")
    made = r.select(
        "request_id", "video_id", F.concat_ws(":", "kind", own).alias("claim_id"), text.alias("claim_text"), confidence.alias("confidence"), F.when(k == "semantic", MODELLED).when(related, ASSOCIATED).otherwise(OBSERVED).alias("epistemic_status"),
        status.alias("status"), evidence.alias("evidence_ids"), events.alias("event_ids"), F.when(k == "track", F.array(own)).otherwise(F.coalesce("participant_ids", none)).alias("participant_ids"), F.when(k != "semantic", F.col("start")).alias("start"), F.when(k != "semantic", F.coalesce("end", "start")).alias("end"),
    ).where("claim_text IS NOT NULL")
    left = requests.join(made.select("request_id").distinct(), "request_id", "left_anti")
    sorry = F.format_string("No canonical evidence or events found in video '%s' satisfying query '%s'", F.col("video_id").cast("string"), F.col("question"))
    nothing = left.select("request_id", "video_id", F.lit("abstention").alias("claim_id"), sorry.alias("claim_text"), F.lit(0.0).alias("confidence"), F.lit("unsupported assertion").alias("epistemic_status"), F.lit("insufficient_evidence").alias("status"), none.alias("evidence_ids"), none.alias("event_ids"), none.alias("participant_ids"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
    return made.unionByName(nothing)


def gate_claims(claims: DataFrame, evidence: DataFrame, events: DataFrame, tracks: DataFrame) -> DataFrame:
    """claims (claim_id, video_id, epistemic_status, evidence_ids, event_ids, participant_ids, start, end) with status and the first rule that fails.

    evidence (evidence_id, video_id) holds every id that may be cited: evidence, texts,
    segments, frames; events (event_id, video_id) and tracks (track_id) likewise, as
    strings. Rules in order: a label; something cited; each evidence id, then each event
    id, known and of the claim's video; times not negative and in order; participants
    known. What is unknown or missing is insufficient_evidence, what is of another video
    or at a wrong time is rejected; reason is null for supported claims.
    """
    none = F.array().cast("array<string>")

    def cited(column: str, rule: int, known: DataFrame, key: str, name: str) -> DataFrame:
        each = claims.select("claim_id", "video_id", F.posexplode(column).alias("pos", "id"))
        at = known.groupBy(F.col(key).cast("string").alias("id")).agg((F.min("video_id") if "video_id" in known.columns else F.lit(None).cast("long")).alias("v"), F.lit(True).alias("there"))
        j = each.join(at, "id", "left").select("claim_id", "pos", F.when(F.col("there").isNull(), f"{name}_unknown").when(F.col("v") != F.col("video_id"), f"{name}_of_other_video").alias("reason"))
        return j.where("reason IS NOT NULL").select("claim_id", F.lit(rule).alias("rule"), "pos", "reason")

    size = lambda c: F.size(F.coalesce(c, none))
    plain = F.when(F.coalesce("epistemic_status", F.lit("")) == "", F.struct(F.lit(1).alias("rule"), F.lit("no_label").alias("reason"))).when(size("evidence_ids") + size("event_ids") == 0, F.struct(F.lit(2).alias("rule"), F.lit("nothing_cited").alias("reason"))).when((F.col("start") < 0) | (F.col("end") < 0), F.struct(F.lit(5).alias("rule"), F.lit("negative_time").alias("reason"))).when(F.col("start") > F.col("end"), F.struct(F.lit(5).alias("rule"), F.lit("inverted_time").alias("reason")))
    issues = claims.select("claim_id", plain.alias("p")).where("p IS NOT NULL").select("claim_id", "p.rule", F.lit(0).alias("pos"), "p.reason")
    issues = reduce(DataFrame.unionByName, (issues, cited("evidence_ids", 3, evidence, "evidence_id", "evidence"), cited("event_ids", 4, events, "event_id", "event"), cited("participant_ids", 6, tracks.select("track_id"), "track_id", "participant")))
    first = issues.groupBy("claim_id").agg(F.min(F.struct("rule", "pos", "reason"))["reason"].alias("reason"))
    bad = F.col("reason").isin("negative_time", "inverted_time") | F.endswith("reason", F.lit("of_other_video"))
    return claims.drop("status", "reason").join(first, "claim_id", "left").withColumn("status", F.when(F.col("reason").isNull(), "supported").when(bad, "rejected").otherwise("insufficient_evidence"))


def validate_claims(claims: DataFrame, evidence: DataFrame | None = None, events: DataFrame | None = None, participants: DataFrame | None = None, allowed: tuple[str, ...] = (OBSERVED, ASSOCIATED, MODELLED, NOTHING)) -> DataFrame:
    """claims with every error found, in the order of the rules; those with any are rejected and their confidence is 0.

    claims: claim_id, video_id, expected_video_id, confidence, epistemic_status, status,
    start, end, evidence_ids, event_ids, participant_ids. evidence (evidence_id), events
    (event_id) and participants (participant_id) are the known ids as strings; what is not
    given is not checked. Supported claims have to cite evidence. A null confidence is out of range.
    """
    j = claims
    for column, known in (("evidence_ids", evidence), ("event_ids", events), ("participant_ids", participants)):
        name = f"_lost_{column}"
        if known is None:
            j = j.withColumn(name, F.lit(None).cast("long"))
        else:
            lost = claims.select("claim_id", F.explode(column).alias("id")).join(known.select(F.col(known.columns[0]).cast("string").alias("id")).distinct(), "id", "left_anti")
            j = j.join(lost.groupBy("claim_id").agg(F.count("*").alias(name)), "claim_id", "left")
    supported = F.col("status") == "supported"
    rules = {
        "other_video": ~F.col("video_id").eqNullSafe(F.col("expected_video_id")), "confidence_range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "no_label": F.coalesce("epistemic_status", F.lit("")) == "",
        "bad_label": (F.coalesce("epistemic_status", F.lit("")) != "") & ~F.col("epistemic_status").isin(*allowed), "negative_time": F.col("start") < 0, "inverted_time": F.col("end") < F.col("start"),
        "nothing_cited": supported & (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0), "unknown_evidence": supported & (F.col("_lost_evidence_ids") > 0), "unknown_event": F.col("_lost_event_ids") > 0, "unknown_participant": F.col("_lost_participant_ids") > 0,
    }
    errors = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    j = j.withColumn("errors", errors)
    bad = F.size("errors") > 0
    return j.withColumn("confidence", F.when(bad, 0.0).otherwise(F.col("confidence"))).withColumn("status", F.when(bad, "rejected").otherwise(F.col("status"))).withColumn("epistemic_status", F.when(bad & (F.coalesce("epistemic_status", F.lit("")) == ""), NOTHING).otherwise(F.col("epistemic_status"))).drop("_lost_evidence_ids", "_lost_event_ids", "_lost_participant_ids")


def claim_summary(claims: DataFrame) -> DataFrame:
    """Per request: mean confidence, whether all claims are supported or any lacks evidence, and the answer text in claim order."""
    return claims.groupBy("request_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.bool_and(F.col("status") == "supported").alias("fully_supported"), F.bool_or(F.col("status") == "insufficient_evidence").alias("any_insufficient"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "claim_text"))), lambda x: x["claim_text"]), " ").alias("answer"))
