"""Substring lookups and JSON lines against brute force."""

import json
import random

from tracelake.operators import entities as en
from tracelake.operators import lookups as lo
from tracelake.sources import io

ALPHABET = "aBcÄ "


def word(rng, low, high):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(low, high)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_query_graph(spark):
    rng = random.Random(7)
    nodes = [(rng.choice([1, 1, 1, 2, None]), f"n{i:04d}", rng.choice(["event", "track", None]), rng.choice([None, word(rng, 0, 8)])) for i in range(400)]
    asked = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, "event", "track"]), rng.choice([None, "", word(rng, 1, 3)])) for i in range(60)]
    asked += asked[:3]  # repeated requests
    df = spark.createDataFrame(nodes, "video_id long, node_id string, node_type string, label string")
    out = en.query_graph(spark.createDataFrame(asked, "request_id long, video_id long, node_type string, label string"), df, limit=7)
    want = []
    for i, v, t, part in asked:
        hits = [n for w, n, k, label in nodes if v is not None and w == v and (t is None or k == t) and (part is None or label is not None and part.lower() in label.lower())]
        want += [(i, n) for n in sorted(hits)[:7]]
    assert sorted((r.request_id, r.node_id) for r in out.collect()) == sorted(want) and len(want) > 100
    assert set(out.columns) == {"request_id", "video_id", "node_id", "node_type", "label"} and "NestedLoop" not in plan(out)


def test_objects_and_texts(spark):
    rng = random.Random(8)
    found = [(rng.choice([1, 2]), i, rng.choice([None, word(rng, 0, 6)])) for i in range(150)]
    asked = [(i, rng.choice([1, 2, 3]), None, rng.choice([None, "", word(rng, 1, 3)])) for i in range(40)]
    d = spark.createDataFrame(found, "video_id long, detection_id long, class_name string")
    out = en.lookup_objects(spark.createDataFrame(asked, "request_id long, video_id long, object_id string, class_part string"), d, spark.createDataFrame([], "track_id long, class_name string"))
    want = sorted((i, str(n)) for i, v, _, part in asked for w, n, c in found if v == w and (not part or c is not None and part.lower() in c.lower()))
    assert sorted((r.request_id, r.object_id) for r in out.collect()) == want and want
    texts = [(v, n, c, t := rng.randrange(0, 100) * 1.0, t + rng.randrange(0, 50)) for v, n, c in found]
    windows = [(i, v, a := rng.randrange(0, 90) * 1.0, a + 20.0, part) for i, v, _, part in asked]
    out = lo.search_text(spark.createDataFrame(windows, "request_id long, video_id long, w_start double, w_end double, contains string"), spark.createDataFrame(texts, "video_id long, n long, text string, first_seconds double, last_seconds double"))
    want = sorted((i, n) for i, v, a, b, part in windows for w, n, c, s, e in texts if v == w and s <= b and e >= a and (part is None or c is not None and part.lower() in c.lower()))
    assert sorted((r.request_id, r.n) for r in out.collect()) == want and want


def test_json_lines_are_read_by_many_tasks(spark, tmp_path):
    docs = [{"videos": [{"video_id": f"v{i}", "ocr": {"status": "annotated", "items": [{"ocr_id": f"{i}-{j}", "expected_text": "x\n y" * 20} for j in range(i % 3)]}}]} for i in range(300)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        out = io.read_annotations(spark, str(tmp_path / "a.jsonl"), lines=True)
        assert out["ocr"].rdd.getNumPartitions() > 3
        assert sorted((r.video_id, r.ocr_id) for r in out["ocr"].collect()) == sorted((f"v{i}", f"{i}-{j}") for i in range(300) for j in range(i % 3))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.n, r.status) for r in out["status"].where("modality = 'ocr'").collect()} == {(0, "annotated"), (1, "annotated"), (2, "annotated")}
    (tmp_path / "whole.json").write_text(json.dumps({"videos": [d["videos"][0] for d in docs]}, indent=1))
    whole = io.read_annotations(spark, str(tmp_path / "whole.json"))
    assert sorted(map(str, whole["ocr"].collect())) == sorted(map(str, out["ocr"].collect()))
