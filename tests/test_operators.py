"""Hand-made worlds for the observation operators, and invariance of results."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.functions import exprs as ex
from tracelake.operators import evaluation as va
from tracelake.operators import events as ev
from tracelake.operators import fusion as fu
from tracelake.operators import graph as gr
from tracelake.operators import lectures as le
from tracelake.operators import lookups as lo
from tracelake.operators import timeindex as ti
from tracelake.sources import io

BOX = ex.BOX


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 60
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


def test_repair_reasons(spark):
    rows = [("a", 0, None), ("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, 0.1), ("a", 4, None), ("a", 5, 9.0)]
    df = spark.createDataFrame([(1, n, p) for _, n, p in rows] + [(2, 0, 0.0), (2, 1, 1.0)], "video_id long, frame_number long, pts double")
    got = {(r.video_id, r.frame_number): (round(r.pts, 4), r.repair_reason) for r in ti.repair_timestamps(df, 10.0).collect()}
    assert got[(1, 0)] == (0.0, "missing_start_pts") and got[(1, 2)] == (0.6, "duplicate_pts") and got[(1, 3)] == (0.7, "non_monotonic_pts") and got[(1, 4)] == (0.8, "missing_pts") and got[(1, 5)] == (9.0, None)
    assert got[(2, 1)] == (1.0, None)


def test_zone_jitter_is_one_entry(spark):
    rows = [(1, 7, i, i * 0.04, (99.5 if i % 2 else 100.5) - 1, 10.0) for i in range(10)]
    p = spark.createDataFrame(rows, "video_id long, track_id long, frame_number long, pts double, x double, y double").withColumn("bbox", ex.box("x", "y", F.lit(2.0), F.lit(2.0)))
    z = spark.range(1).select(F.lit("z").alias("zone_id"), ex.rect_zone(0, 0, 100, 100).alias("polygon"))
    kinds = [r.event_type for r in ev.zone_events(p, z).collect()]
    assert kinds.count("zone_entered") <= 1 and kinds.count("zone_exited") <= 1


@pytest.mark.parametrize("x,y,inside", [(5, 5, True), (15, 5, False), (5, 15, False), (-1, 5, False)])
def test_polygon(spark, x, y, inside):
    assert spark.range(1).select(ex.in_polygon(F.lit(float(x)), F.lit(float(y)), ex.rect_zone(0, 0, 10, 10))).first()[0] is inside


def test_greedy_and_optimal_matching(spark):
    pairs = spark.createDataFrame([(1, "c", 0, 0, 0.0, 0.0, 0.9), (1, "c", 1, 0, 0.0, 0.0, 0.8), (1, "c", 0, 1, 0.0, 0.0, 0.7), (1, "c", 5, 5, 9.0, 9.0, 0.6)], "video_id long, class string, g_id long, p_id long, t double, t_end double, weight double")
    assert {(r.g_id, r.p_id) for r in va.match_pairs(pairs, "greedy").collect()} == {(0, 0), (5, 5)}
    assert {(r.g_id, r.p_id) for r in va.match_pairs(pairs, "optimal").collect()} == {(1, 0), (0, 1), (5, 5)}


def test_error_rates(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "x"), ("", ""), ("ab", "abcdef")], "ref string, hyp string")
    got = [(r.substitutions, r.deletions, r.insertions, round(r.error_rate, 4)) for r in va.error_rates(df).collect()]
    assert got == [(2, 0, 1, 0.5), (0, 0, 1, 1.0), (0, 0, 0, 0.0), (0, 0, 4, 2.0)]


def test_text_normalisation(spark):
    df = spark.createDataFrame([("ＡB​  c d",), ("क‍ष",), ("a‍b",)], "t string")
    assert [r[0] for r in df.select(ex.normalize_ocr(F.col("t"))).collect()] == ["ab c d", "क‍ष", "ab"]


def test_fused_text_follows_places(spark):
    rows = [(1, 1, 0, 0.0, "A", "a", 0.5, 0.0), (1, 2, 1, 0.1, "A", "a", 0.9, 5.0), (1, 3, 1, 0.1, "a", "a", 0.4, 500.0), (1, 4, 20, 2.0, "A", "a", 0.7, 0.0)]
    df = spark.createDataFrame(rows, "video_id long, observation_id long, frame_number long, pts double, text string, normalized_text string, confidence double, x double").withColumn("bbox", ex.box("x", F.lit(0.0), F.lit(20.0), F.lit(10.0)))
    got = sorted((tuple(r.supporting_observation_ids), r.text) for r in fu.fuse_text(df).collect())
    assert got == [((1, 2), "A"), ((3,), "a"), ((4,), "A")]


def test_paths_and_issues(spark):
    edges = spark.createDataFrame([(f"e{a}{b}", a, b, "R", 1, 0.5, "d") for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"))], "edge_id string, source_node_id string, target_node_id string, relationship string, video_id long, confidence double, derivation string")
    pairs = spark.createDataFrame([("a", "c"), ("b", "b")], "source string, target string")
    got = {(r.source, r.target, tuple(r.path)) for r in gr.find_paths(edges, pairs).collect()}
    assert got == {("a", "c", ("eac",)), ("a", "c", ("eab", "ebc")), ("b", "b", ())}
    nodes = spark.createDataFrame([(1, "a", "t", None, 2.0, 1.0, 1.5), (1, "b", "t", "d", -1.0, 1.0, 0.5), (2, "c", "t", "d", 0.0, 1.0, 0.5), (1, "z", "t", "d", 0.0, 1.0, 0.5)], "video_id long, node_id string, node_type string, derivation string, timestamp_start double, timestamp_end double, confidence double")
    assert {(r.issue, r.id) for r in gr.graph_issues(nodes, edges).collect()} == {("empty_provenance", "a"), ("inverted_time", "a"), ("confidence_range", "a"), ("negative_time", "b"), ("orphan_node", "z"), ("cross_video_edge", "ebc"), ("cross_video_edge", "eac"), ("cross_video_edge", "eca")}


def test_formulas(spark):
    rows = [(r"\begin{a}x\end{a}", True), (r"\begin{a}x\end{b}", False), ("$x$", True), ("$x", False), (r"\$x", True), ("(a[b]{c})", True), ("(a]", False)]
    assert [(r.t, r.ok) for r in spark.createDataFrame(rows, "t string, want boolean").select("t", ex.latex_ok(F.col("t")).alias("ok")).collect()] == rows


def test_captions(spark, tmp_path):
    (tmp_path / "v1.srt").write_text("1\n00:00:00,000 --> 00:00:15,500\nHello <i>there</i>\n\n2\n00:00:15,500 --> 00:00:45,000\nmore\nlines\n")
    (tmp_path / "v2.json").write_text('{"segments": [{"start_seconds": 1, "text": "a"}, {"start": 3, "duration": 2, "text": "b"}, {"start": 9, "text": " "}]}')
    (tmp_path / "v3.txt").write_text("[00:10] first\nplain\n")
    got = sorted((r.video_id, r.start, r.end, r.text) for r in io.ingest_captions(spark, str(tmp_path)).collect())
    assert got == [("v1", 0.0, 15.5, "Hello there"), ("v1", 15.5, 45.0, "more lines"), ("v2", 1.0, 6.0, "a"), ("v2", 3.0, 5.0, "b"), ("v3", 10.0, 15.0, "first"), ("v3", 10.0, 20.0, "plain")]


def test_predictions_keep_null_from_empty(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"videos": [{"video_id": "x", "detections": [{"class_label": "car", "timestamp_pts": 1}], "events": []}]}')
    (tmp_path / "b.json").write_text('{"y": {"ocr": ["t"]}}')
    got = io.read_predictions(spark, str(tmp_path))
    assert [r.confidence for r in got["detections"].collect()] == [1.0] and [r.text for r in got["ocr"].collect()] == ["t"]
    status = {(r.video_id, r.modality): r.n for r in got["status"].collect()}
    assert status[("x", "events")] == 0 and status[("x", "qa")] is None and status[("y", "ocr")] == 1


def test_claims(spark):
    kind = "claim_id string, video_id long, epistemic_status string, evidence_ids array<string>, event_ids array<string>, participant_ids array<string>, start double, end double, status string"
    rows = [("c1", 1, "x", ["e1"], [], [], 0.0, 1.0, "old"), ("c2", 1, "x", [], None, [], 0.0, 1.0, None), ("c3", 1, "x", ["e1", "e9", "f1"], [], [], 0.0, 1.0, None), ("c4", 2, "x", ["e1"], [], [], 0.0, 1.0, None), ("c5", 1, "x", None, ["v1"], ["t1"], 2.0, 1.0, None), ("c6", 1, None, ["e9"], [], [], 0.0, 1.0, None), ("c7", 1, "x", [], ["v1"], ["t9"], None, None, None), ("c8", 1, "x", [], ["v1"], ["t1"], None, None, None)]
    evidence = spark.createDataFrame([("e1", 1), ("e1", 1), ("f1", 2)], "evidence_id string, video_id long")
    events, tracks = spark.createDataFrame([("v1", 1)], "event_id string, video_id long"), spark.createDataFrame([("t1",)], "track_id string")
    got = {r.claim_id: (r.reason, r.status) for r in lo.gate_claims(spark.createDataFrame(rows, kind), evidence, events, tracks).collect()}
    lost, bad, fine = "insufficient_evidence", "rejected", "supported"
    assert got == {"c1": (None, fine), "c2": ("nothing_cited", lost), "c3": ("evidence_unknown", lost), "c4": ("evidence_of_other_video", bad), "c5": ("inverted_time", bad), "c6": ("no_label", lost), "c7": ("participant_unknown", lost), "c8": (None, fine)}
    assert lo.gate_claims(spark.createDataFrame([], kind), evidence, events, tracks).count() == 0


def test_seek_finds_the_nearest_frame_however_far(spark):
    frames = spark.createDataFrame([(1, 5, 10.0), (1, 3, 10.0), (1, 9, 20.0), (1, 1, 500.0), (2, 7, None)], "video_id long, frame_id long, pts double")
    asked = spark.createDataFrame([(1, 1, 15.0), (2, 1, 9999.0), (3, 1, -50.0), (4, 2, 0.0), (5, 3, 0.0), (6, 1, None), (7, 1, 15.1)], "request_id long, video_id long, t double")
    assert {r.request_id: r.frame_id for r in lo.seek(asked, frames).collect()} == {1: 3, 2: 1, 3: 3, 4: None, 5: None, 6: None, 7: 9}


def test_upsert_keeps_the_last_write(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string")
    batch = spark.createDataFrame([(9, "last", 2), (9, "first", 1), (2, "c", 1)], "v0 long, v string, at int").withColumnRenamed("v0", "id")
    assert sorted(map(tuple, io.upsert_by_key(old, batch, "id", "at").collect()), key=str) == [(1, "a"), (2, "c"), (9, "last"), (None, "n")]
    assert io.upsert_by_key(old, batch.limit(0), "id", "at").count() == 3


def test_null_keys_are_one_key_of_a_fold(spark):
    from tracelake.functions.ordered import thin

    rows = spark.createDataFrame([(None, float(i), i) for i in range(6)] + [(1, 0.0, 9)], "k long, t double, i long")
    assert sorted(r.i for r in thin(rows, ["k"], "t", ["i"], 3.0).collect()) == [0, 3, 9]


def test_edits_against_brute_force(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    rows = [("".join(rng.choice("abé ") for _ in range(rng.randrange(30))), "".join(rng.choice("abé ") for _ in range(rng.randrange(30)))) for _ in range(60)] + [("", "x"), ("x", ""), ("", ""), (None, "ab")]
    for r in va.error_rates(spark.createDataFrame(rows, "ref string, hyp string")).collect():
        a, b = r.ref or "", r.hyp or ""
        assert r.substitutions + r.deletions + r.insertions == distance(a, b) and r.insertions - r.deletions == len(b) - len(a)


def test_normalized_text_against_python(spark):
    import re
    import unicodedata

    from tracelake.functions.exprs import normalize_ocr

    texts = ["ﬁne  Ⅳ\u200b x", "½ ＡＢＣ\tÉ", "e\u0301 \ufeffz", "", None, "  plain text  ", "a\u200db"]
    want = [None if t is None else re.sub(r"\s+", " ", re.sub("[\u200b\ufeff\u200c\u200d]", "", unicodedata.normalize("NFKC", t))).strip().lower() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.n for r in df.select("i", normalize_ocr(F.col("t")).alias("n")).orderBy("i").collect()] == want



def test_windows_do_not_depend_on_partitions(spark):
    rows = [(v, i, i * 7.0, i * 7.0 + 5, f"t{i}") for v in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "video_id long, segment_id long, start double, end double, text string")
    seen = [sorted((r.video_id, r.segment_id, r.window) for r in le.lecture_windows(df.repartition(n), 60.0).collect()) for n in (1, 4, 16)]
    assert seen[0] == seen[1] == seen[2] and max(w for _, _, w in seen[0]) == 6


def test_streams_agree_with_batch(spark, tmp_path):
    from tracelake.streaming.streams import stream_clusters

    base = pd.Timestamp("2024-01-01")
    rows = [(1, (base + pd.Timedelta(seconds=s)).to_pydatetime()) for s in (0, 1, 2.5, 5, 20, 60, 200)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "video_id long, event_time timestamp").coalesce(1).write.parquet(src)
    q = stream_clusters(spark.readStream.schema("video_id long, event_time timestamp").parquet(src)).writeStream.format("memory").queryName("clusters").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = sorted(r.n_events for r in spark.table("clusters").collect())
    assert got == [1, 1, 4]


def test_named_lookups(spark):
    from tracelake.operators import entities as en

    tracks = spark.createDataFrame([(1, 2.0, 3.456, "car"), (2, None, None, "dog")], "track_id long, first_seconds double, last_seconds double, class_name string")
    asked = spark.createDataFrame([(10, 1), (11, 2), (12, 9), (13, None)], "request_id long, track_id long")
    assert {(r.request_id, r.duration, r.found) for r in en.lookup_tracks(asked, tracks).collect()} == {(10, 1.46, True), (11, 0.0, True), (12, None, False), (13, None, False)}
    assert en.lookup_tracks(asked.limit(0), tracks).count() == 0
    d = spark.createDataFrame([(7, 5, "RedCar"), (7, 6, "tree"), (8, 7, "car")], "video_id long, detection_id long, class_name string")
    r = spark.createDataFrame([(1, 7, "5", None), (2, 7, "1", None), (3, 7, None, "car"), (4, 8, None, None), (5, 9, None, "car"), (6, 7, "99", None)], "request_id long, video_id long, object_id string, class_part string")
    assert {tuple(x) for x in en.lookup_objects(r, d, tracks).collect()} == {(1, "detection", "5", "RedCar"), (2, "track", "1", "car"), (3, "detection", "5", "RedCar"), (4, "detection", "7", "car")}
    nodes = spark.createDataFrame([(7, f"n{i:03d}", "event", "Walk" if i % 2 else None) for i in range(200)], "video_id long, node_id string, node_type string, label string")
    q = spark.createDataFrame([(1, 7, None, None), (2, 7, "event", "WAL"), (3, 7, "track", None), (4, None, None, None)], "request_id long, video_id long, node_type string, label string")
    got = {}
    for x in en.query_graph(q, nodes).collect():
        got.setdefault(x.request_id, []).append(x.node_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: [f"n{i:03d}" for i in range(50)], 2: [f"n{i:03d}" for i in range(1, 100, 2)]}


def test_normal_forms(spark):
    import re
    import unicodedata

    texts = ["", None, "ﬁne​  x⁠", " A b ", "Ça, va?", "﻿q　w"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: (r.a, r.b) for r in df.select("i", ex.normalize_transcript(F.col("text")).alias("a"), ex.normalize_eval(F.col("text"), strip_punctuation=True).alias("b")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] == (None, None)
            continue
        n = unicodedata.normalize("NFKC", t)
        a = " ".join(re.sub("[​﻿⁠]", "", n).split())
        b = " ".join("".join(c for c in n.lower() if not unicodedata.category(c).startswith("P")).split())
        assert got[i] == (a, b), t


def test_lint_corpus(spark):
    from tracelake.operators.evaluation import lint_corpus, qa_abstention

    found = spark.createDataFrame([(1, 10, 10, 30.0, 5), (2, 10, 11, 30.0, 6), (3, 10, 10, None, 5), (3, 10, 10, None, 5)], "video_id long, width int, height int, fps double, n_frames int")
    clips = spark.createDataFrame([(1, 10, 10, 30.0, 5), (2, 10, 10, 29.97, 5)], "video_id long, width int, height int, fps double, n_frames int")
    frames = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, None)], "video_id long, frame_number int, is_negative boolean")
    boxes = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 0), (None, 0)], "video_id long, frame_number int")
    assert sorted(tuple(r) for r in lint_corpus(found, clips, frames, boxes).collect()) == [(1, "negative_frame_not_empty"), (2, "fps_mismatch"), (2, "frame_count_mismatch"), (2, "size_mismatch"), (3, "unknown_clip")]
    gt = spark.createDataFrame([(1, True), (2, False), (3, True)], "qa_id long, is_answerable boolean")
    pred = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, True)], "qa_id long, position int, did_abstain boolean")
    r = qa_abstention(gt, pred).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.missing, r.accuracy) == (1, 0, 0, 1, 1, 1.0) and r.recall_ci.high == 1.0


def test_rates_and_references(spark):
    rows = [(1, "event_recall", "available", 3, 4, 0.75), (2, "event_recall", "available", 0, 0, None), (3, "event_recall", "missing_modality", 9, 9, 1.0), (1, "asr_wer", "available", 6, 4, 1.5), (2, "asr_wer", "available", None, None, None), (1, "ocr_cer", "not_annotated", 1, 1, 1.0), (1, "event_f1", "available", 0, 0, None)]
    got = {r.metric: tuple(r)[1:] for r in va.aggregate_rates(spark.createDataFrame(rows, "video_id long, metric string, status string, part long, whole long, value double")).collect()}
    assert got == {"event_recall": (0.75, 0.75, 4, 2, 1, 0.3006, 0.9544), "asr_wer": (1.5, 1.5, 4, 2, 1, None, None), "event_f1": (0.0, 0.0, 0, 1, 0, None, None)}
    events = spark.createDataFrame([(1, 10, 0, 5.0), (1, 11, 1, 4.0), (1, 12, 2, 4.0), (2, 13, 0, -2.0), (2, 14, 1, None)], "video_id long, event_id long, position long, start double")
    cites = spark.createDataFrame([(10, 1, None, 3, 0.0), (11, 2, 5, None, -1.0), (12, None, None, None, None)], "event_id long, track_id long, observation_id long, segment_id long, timestamp_seconds double")
    ids = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} long")
    out = va.audit_references(events, cites, ids("track_id", 1, 1), ids("observation_id", 6, None), ids("segment_id"))
    assert sorted(map(tuple, out.collect())) == [("negative_evidence_time", "11"), ("non_monotonic", "11"), ("non_monotonic", "13"), ("ungrounded_segment", "10"), ("ungrounded_text", "11"), ("ungrounded_track", "11")]


def test_bundle_evidence(spark):
    from tracelake.operators import ranking as ra

    c = spark.createDataFrame([(1, "c", 10.0, 20.0, ["e2", "nil", "e1"], ["b", "b"]), (1, "bare", 50.0, 50.0, [], None)], "video_id long, candidate_id string, start double, end double, source_event_ids array<string>, evidence_ids array<string>")
    e = spark.createDataFrame([("e1", "EXIT", "hi", "yard", ["a", "b"]), ("e2", "STOP", "", "", None), ("e3", "no", "no", "no", ["n"])], "event_id string, text string, speech_text string, zone_name string, evidence_ids array<string>")
    x = spark.createDataFrame([(1, 7, 20.0, 30.0, "STOP"), (1, 8, 0.0, 10.0, "GO"), (1, 9, 21.0, 22.0, "EXIT"), (2, 1, 10.0, 20.0, "far")], "video_id long, observation_id long, first_seconds double, last_seconds double, text string")
    s = spark.createDataFrame([(1, 4, 12.0, 13.0, "hi"), (1, 5, 50.0, 51.0, None)], "video_id long, segment_id long, start double, end double, text string")
    got = {r.candidate_id: ([tuple(t) for t in r.texts], [tuple(t) for t in r.speech], r.zones, r.evidence_ids) for r in ra.bundle_evidence(c, e, x, s).collect()}
    assert got == {"c": ([("8", "GO"), ("7", "STOP"), ("e1", "EXIT")], [("4", "hi")], ["yard"], ["b", "b", "a"]), "bare": ([], [("5", None)], [], [])}
