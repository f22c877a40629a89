"""Ranking clusters of events for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.keywords import keyword_matches
from tracelake.functions.ordered import islands, ordered_fold, range_join, thin

CLUSTER_GAP, MIN_SALIENCY, MIN_RELEVANCE = 2.5, 0.4, 0.5
MAX_REQUESTS, MAX_TOKENS, BUDGET_SECONDS, RESULT_TTL = 60, 100_000, 60.0, 300.0


def cluster_events(events: DataFrame, gap: float = CLUSTER_GAP) -> DataFrame:
    """events with cluster: a new one where an event starts over gap after everything before it has ended."""
    w = Window.partitionBy("video_id").orderBy("start", "end", "event_id")
    reach = F.max(F.coalesce("end", "start")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("cluster", islands(F.coalesce(F.col("start") > reach + gap, F.lit(True)), w))


def score_clusters(events: DataFrame, type_weights: DataFrame, severity_weights: DataFrame) -> DataFrame:
    """Saliency of clusters: severity, type weight and confidence, with boosts for several modules, text and density; at most 1.

    events: video_id, cluster, event_id, event_type, severity, source_module, start, end, confidence. The weight tables are small.
    """
    e = events.join(F.broadcast(type_weights), "event_type", "left").join(F.broadcast(severity_weights), "severity", "left")
    c = e.groupBy("video_id", "cluster").agg(
        F.min("start").alias("start"), F.max(F.coalesce("end", "start")).alias("end"), F.count("*").alias("n_events"), F.max(F.coalesce("severity_weight", F.lit(0.2))).alias("sev"), F.max(F.coalesce("type_weight", F.lit(0.3))).alias("typ"),
        F.avg("confidence").alias("conf"), F.count_distinct("source_module").alias("modules"), F.bool_or(F.col("event_type").startswith("text")).alias("has_text"), F.array_sort(F.collect_set("event_id")).alias("event_ids"),
    )
    boosts = F.when(F.col("modules") > 1, 0.25).otherwise(0.0) + F.when(F.col("has_text"), 0.15).otherwise(0.0) + F.least(F.lit(0.15), 0.03 * (F.col("n_events") - 1))
    saliency = F.least(F.lit(1.0), 0.4 * F.col("sev") + 0.3 * F.col("typ") + 0.3 * F.col("conf") + boosts)
    why = F.filter(F.array(F.when(F.col("modules") > 1, F.lit("cross_modal")), F.when(F.col("has_text"), F.lit("text")), F.when(F.col("n_events") > 1, F.lit("density"))), lambda x: x.isNotNull())
    return c.select("video_id", "cluster", "start", "end", "n_events", "event_ids", F.round(saliency + 1e-9, 4).alias("saliency_score"), why.alias("reasons"))


def query_relevance(clusters: DataFrame, queries: DataFrame, stop_words: list[str], all_pairs: bool = True) -> DataFrame:
    """Share of the distinct words of each query (query_id, query) that a cluster's text holds (video_id, cluster, corpus; ids unique and not null).

    The words of all queries are searched in one pass over each text. all_pairs=False gives the
    pairs with a share above 0 only: use it with many queries, as all pairs are by definition
    clusters times queries. A pair left out is no candidate unless its cluster has a saliency of 1.
    A query without words has 1 with every cluster and is in both forms.
    """
    every = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))
    useful = F.array_except(every, F.array(*map(F.lit, stop_words)).cast("array<string>"))
    words = F.coalesce(F.when(F.size(useful) > 0, useful).otherwise(every), F.array().cast("array<string>"))
    q = queries.select("query_id", words.alias("words"))
    each = q.select("query_id", F.explode("words").alias("keyword"), F.size("words").alias("_n"))
    keys = ["video_id", "cluster"]
    found = keyword_matches(clusters.select(*keys, "corpus"), each, "corpus").select(*keys, "keyword")
    hits = found.join(each, "keyword").groupBy(*keys, "query_id").agg(F.round(F.count("*") / F.first("_n"), 4).alias("query_relevance_score"))
    bare = clusters.select(*keys).crossJoin(q.where(F.size("words") == 0).select("query_id")).withColumn("query_relevance_score", F.lit(1.0))
    if all_pairs:
        pairs = clusters.select(*keys).crossJoin(q.where(F.size("words") > 0).select("query_id"))
        hits = pairs.join(hits, [*keys, "query_id"], "left").withColumn("query_relevance_score", F.coalesce("query_relevance_score", F.lit(0.0)))
    return hits.unionByName(bare)


def candidates(scored: DataFrame, relevance: DataFrame | None = None) -> DataFrame:
    """Clusters worth a review, with priority and rank: saliency of MIN_SALIENCY on, or with a query a blend or relevance of MIN_RELEVANCE on."""
    c = scored.withColumn("query_relevance_score", F.lit(1.0)) if relevance is None else scored.join(relevance, ["video_id", "cluster"])
    blend = 0.5 * F.col("saliency_score") + 0.5 * F.col("query_relevance_score")
    c = c.where(F.col("saliency_score") >= MIN_SALIENCY) if relevance is None else c.where((blend >= MIN_RELEVANCE) | (F.col("query_relevance_score") >= MIN_RELEVANCE))
    priority = F.when(F.col("saliency_score") >= 0.8, 1).when(F.col("saliency_score") >= 0.6, 2).when(F.col("saliency_score") >= 0.4, 3).otherwise(4)
    w = Window.partitionBy("video_id").orderBy("priority", F.desc("saliency_score"), F.desc("query_relevance_score"), "start", "cluster")
    return c.withColumn("priority", priority).withColumn("rank", F.row_number().over(w))


def gate(candidates: DataFrame) -> DataFrame:
    """Routing decision with its reason: critical ones always go on, then query mismatches and dull ones are held back."""
    rel, sal = F.col("query_relevance_score"), F.col("saliency_score")
    d = F.when(F.col("priority") == 1, F.struct(F.lit("route").alias("decision"), F.lit("critical").alias("reason"))).when(rel < 0.3, F.struct(F.lit("skip").alias("decision"), F.lit("query_mismatch").alias("reason"))).when(sal < MIN_SALIENCY, F.struct(F.lit("skip").alias("decision"), F.lit("low_saliency").alias("reason"))).otherwise(F.struct(F.lit("route").alias("decision"), F.lit("salient").alias("reason")))
    return candidates.withColumn("_d", d).select("*", "_d.decision", "_d.reason").drop("_d")


def keyframe_targets(candidates: DataFrame) -> DataFrame:
    """Times to look at: one of a candidate of up to 0.1 s, else its start, middle (3 decimals) and end."""
    s, e = F.col("start"), F.col("end")
    targets = F.when(e - s <= 0.1, F.array(s)).otherwise(F.array(s, F.round((s + e) / 2 + 1e-9, 3), e))
    return candidates.select("video_id", "candidate_id", F.posexplode(targets).alias("position", "t"))


def bundles(candidates: DataFrame, texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Texts seen and speech heard during each candidate (video_id, candidate_id, start, end), ends included."""
    c = candidates.select("video_id", "candidate_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    seen = range_join(c, texts.select("video_id", F.col("observation_id").alias("oid"), F.col("first_seconds").alias("t0"), F.col("last_seconds").alias("t1")), ["video_id"], ("c_start", "c_end"), ("t0", "t1")).groupBy("video_id", "candidate_id").agg(F.sort_array(F.collect_set("oid")).alias("text_ids"))
    heard = range_join(c, segments.select("video_id", F.col("segment_id").alias("sid"), F.col("start").alias("s0"), F.col("end").alias("s1")), ["video_id"], ("c_start", "c_end"), ("s0", "s1")).groupBy("video_id", "candidate_id").agg(F.sort_array(F.collect_set("sid")).alias("segment_ids"))
    return candidates.join(seen, ["video_id", "candidate_id"], "left").join(heard, ["video_id", "candidate_id"], "left")


def bundle_evidence(candidates: DataFrame, events: DataFrame, texts: DataFrame, segments: DataFrame) -> DataFrame:
    """(candidate_id, texts, speech, zones, evidence_ids): what a candidate's window and its source events tell.

    candidates: video_id, candidate_id (unique), start, end, source_event_ids, evidence_ids; events:
    event_id, text, speech_text, zone_name, evidence_ids; texts: video_id, observation_id,
    first_seconds, last_seconds, text; segments: video_id, segment_id, start, end, text.
    texts and speech (id, text) hold what meets the window, ends included, by start and id, and then the
    words of source events that are not among these, by the event's place. zones are sorted; evidence
    ids are the candidate's, then those of its events as they first come. Unknown events, null or empty
    words and zones give nothing; arrays without entries are empty.
    """
    support = candidates.select("candidate_id", F.posexplode("source_event_ids").alias("_pos", "event_id")).join(events.select("event_id", "text", "speech_text", "zone_name", F.col("evidence_ids").alias("_ids")), "event_id")
    windows = candidates.select("video_id", "candidate_id", F.col("start").alias("_w0"), F.col("end").alias("_w1"))

    def words(rows: DataFrame, key: str, span: tuple[str, str], told: str, name: str) -> DataFrame:
        rows = rows.select("video_id", F.col(key).cast("string").alias("id"), F.col(span[0]).alias("_t0"), F.col(span[1]).alias("_t1"), "text")
        met = range_join(windows, rows, ["video_id"], ("_w0", "_w1"), ("_t0", "_t1")).select("candidate_id", F.lit(0).alias("late"), F.col("_t0").alias("at"), "id", "text")
        of_events = support.where(F.col(told) != "").groupBy("candidate_id", F.col(told).alias("text")).agg(F.min(F.struct(F.col("_pos").cast("double").alias("at"), F.col("event_id").cast("string").alias("id"))).alias("e"))
        more = of_events.join(met.select("candidate_id", "text").distinct(), ["candidate_id", "text"], "left_anti").select("candidate_id", F.lit(1).alias("late"), "e.at", "e.id", "text")
        in_order = F.sort_array(F.collect_list(F.struct("late", "at", "id", "text")))
        return met.unionByName(more).groupBy("candidate_id").agg(F.transform(in_order, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias(name))

    told = support.groupBy("candidate_id").agg(F.sort_array(F.collect_set(F.nullif("zone_name", F.lit("")))).alias("zones"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_ids"))), lambda x: F.coalesce(x["_ids"], F.array().cast("array<string>")))).alias("_more"))
    out = candidates.select("candidate_id", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("_own")).join(told, "candidate_id", "left")
    out = out.join(words(texts, "observation_id", ("first_seconds", "last_seconds"), "text", "texts"), "candidate_id", "left").join(words(segments, "segment_id", ("start", "end"), "speech_text", "speech"), "candidate_id", "left")
    none = F.array().cast("array<string>")
    pairs = F.array().cast("array<struct<id:string,text:string>>")
    return out.select("candidate_id", F.coalesce("texts", pairs).alias("texts"), F.coalesce("speech", pairs).alias("speech"), F.coalesce("zones", none).alias("zones"), F.concat("_own", F.array_except(F.coalesce("_more", none), "_own")).alias("evidence_ids"))


def estimate_tokens(bundles: DataFrame) -> DataFrame:
    """Tokens that a bundle (n_crops, start, end, texts, n_trajectories) takes in a request."""
    words = F.aggregate("texts", F.lit(0), lambda n, t: n + 2 * F.size(F.split(F.trim(t), r"\s+")))
    return bundles.withColumn("tokens", (400 + 320 * F.col("n_crops") + F.floor(20 * (F.col("end") - F.col("start"))) + words + 30 * F.col("n_trajectories")).cast("long"))


def usage_snapshot(requests: DataFrame, seconds: float = BUDGET_SECONDS) -> DataFrame:
    """requests (budget_key, t, tokens) with requests and tokens of the seconds up to each."""
    w = Window.partitionBy("budget_key").orderBy("t").rangeBetween(-int(seconds), 0)
    return requests.select("*", F.count("*").over(w).alias("window_requests"), F.sum("tokens").over(w).alias("window_tokens"))


def admit(requests: DataFrame, max_requests: int = MAX_REQUESTS, max_tokens: int = MAX_TOKENS, seconds: float = BUDGET_SECONDS) -> DataFrame:
    """requests (budget_key, request_id, t, tokens) with admitted: a request is refused if it and those admitted in the seconds before exceed a limit."""

    def step(state, row):
        held = [(t, n) for t, n in state if row.t - t < seconds]
        ok = len(held) + 1 <= max_requests and sum(n for _, n in held) + row.tokens <= max_tokens
        return held + [(row.t, row.tokens)] if ok else held, [(row.budget_key, row.request_id, row.t, row.tokens, ok)]

    kind = requests.schema["budget_key"].dataType.simpleString()
    return ordered_fold(requests.select("budget_key", "request_id", "t", "tokens"), ["budget_key"], ["t", "request_id"], list, step, f"budget_key {kind}, request_id long, t double, tokens long, admitted boolean")


def dedup_candidates(candidates: DataFrame, seconds: float = 60.0) -> DataFrame:
    """The first of candidates with the same video and participants, and then those at least seconds after the last one kept."""
    sign = candidates.withColumn("signature", F.unhex(F.sha2(F.concat_ws("|", F.col("video_id").cast("string"), F.array_join(F.array_sort("participant_ids"), ",")), 256))).drop("participant_ids")
    return thin(sign, ["signature"], "start", ["candidate_id"], seconds).withColumn("signature", F.lower(F.hex("signature")))


def reuse_results(requests: DataFrame, results: DataFrame, ttl: float = RESULT_TTL) -> DataFrame:
    """requests (request_id, fingerprint, t) with the newest earlier result (result_id, fingerprint, t) that is younger than ttl."""
    r = results.select("fingerprint", "result_id", F.col("t").alias("made"))
    age = F.col("t") - F.col("made")
    found = requests.join(r, "fingerprint").where((age >= 0) & (age < ttl)).groupBy("request_id").agg(F.max_by("result_id", F.struct("made", "result_id")).alias("result_id"))
    return requests.join(found, "request_id", "left")


def validate_results(results: DataFrame, bundles: DataFrame, slack: float = 0.5) -> DataFrame:
    """results with errors (array) and the score of rejected ones at 0: cited ids in the bundle, times inside it, score in [0, 1], someone taking part."""
    b = bundles.select("candidate_id", F.col("evidence_ids").alias("b_evidence"), F.col("event_ids").alias("b_events"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    j = results.join(b, "candidate_id", "left")
    bad = {
        "unknown_candidate": F.col("b_start").isNull(), "unknown_evidence": F.size(F.array_except("evidence_ids", "b_evidence")) > 0, "unknown_event": F.size(F.array_except("event_ids", "b_events")) > 0,
        "outside_window": (F.col("start") < F.col("b_start") - slack) | (F.col("end") > F.col("b_end") + slack), "score_range": (F.col("score") < 0) | (F.col("score") > 1), "no_participants": F.size("participant_ids") == 0,
    }
    errors = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in bad.items())), lambda x: x.isNotNull())
    return j.withColumn("errors", errors).withColumn("score", F.when(F.size("errors") > 0, 0.0).otherwise(F.col("score"))).drop("b_evidence", "b_events", "b_start", "b_end")


def semantic_events(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Valid results as events, with status and severity by score."""
    j = results.where(F.size("errors") == 0).join(candidates.select("candidate_id", "video_id", F.col("start").alias("c_start"), F.col("end").alias("c_end")), "candidate_id")
    return j.select("video_id", F.sha2(F.concat_ws("|", "candidate_id", "label"), 256).alias("semantic_event_id"), F.col("label").alias("event_type"), F.coalesce("start", "c_start").alias("start"), F.coalesce("end", "c_end").alias("end"), F.col("score").alias("confidence"), F.when(F.col("score") >= 0.7, "confirmed").otherwise("candidate").alias("status"), F.when(F.col("score") >= 0.85, "high").when(F.col("score") >= 0.6, "medium").otherwise("low").alias("severity"), F.col("event_ids").alias("source_event_ids"))
