"""Keyword rules against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions.keywords import keyword_matches
from tracelake.operators import lectures as le
from tracelake.operators import ranking as ra


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcÄß .") for _ in range(rng.randrange(0, 80)))) for i in range(60)] + [(60, None), (61, ""), (62, "ABBA " * 3000), (62, "ABBA " * 3000)]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.mark.parametrize("shard_bytes", [1 << 20, 7])
def test_matches(spark, texts, shard_bytes):
    words = ["a", "ab", "abba", "b a", "äß", ".", "A", "", None, "ab", "zzz"]
    got = keyword_matches(texts, spark.createDataFrame([(w,) for w in words], "keyword string"), shard_bytes=shard_bytes)
    want = sorted((r.id, w) for r in texts.collect() if r.text is not None for w in {x for x in words if x is not None} if w in r.text.lower())
    assert sorted((r.id, r.keyword) for r in got.collect()) == want and len(want) > 60


def test_no_keywords_and_no_texts(spark, texts):
    none = spark.createDataFrame([], "keyword string")
    assert keyword_matches(texts, none).count() == 0 and keyword_matches(texts.limit(0), spark.createDataFrame([("a",)], "keyword string")).count() == 0
    with pytest.raises(ValueError):
        keyword_matches(texts.withColumn("keyword", F.lit(1)), none)


def test_word_boundary(spark):
    texts = spark.createDataFrame([(1, "A limit. Limits? no"), (2, "limits only"), (3, "c++ (x)"), (4, "un limit ed")], "id long, text string")
    rules = spark.createDataFrame([("limit",), ("(x",), ("no",)], "keyword string")
    got = {(r.id, r.keyword) for r in keyword_matches(texts, rules, word_boundary=True).collect()}
    assert got == {(1, "limit"), (1, "no"), (4, "limit")}


def test_ten_thousand_rules(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rules = [(f"k{i % 3}", i, word()) for i in range(10_000)]
    segs = [(v, i, i * 1.0, i + 1.0, " ".join(word() for _ in range(30))) for v in (1, 2) for i in range(20)]
    df = spark.createDataFrame(segs, "video_id long, segment_id long, start double, end double, text string")
    out = le.extract_items(df, spark.createDataFrame(rules, "kind string, rule_no int, keyword string"))
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    want = {}
    for v, i, _, _, t in segs:
        for kind, no, w in rules:
            if w in t and no < want.get((v, i, kind), (10**9,))[0]:
                want[v, i, kind] = (no, w)
    assert {(r.video_id, r.segment_id, r.kind): r.keyword for r in out.collect()} == {k: w for k, (_, w) in want.items()}


def test_titles_without_a_cross_join(spark):
    w = spark.createDataFrame([(1, 0, 0, 0.0, 1.0, "All about Sorting"), (1, 1, 1, 2.0, 3.0, None)], "video_id long, window long, segment_id long, start double, end double, text string")
    rules = spark.createDataFrame([(2, "about", "B"), (1, "sort", "A"), (1, None, "N")], "rule_no int, keyword string, title string")
    out = le.sections(w, le.extract_items(w, spark.createDataFrame([("x", 1, "sort")], "kind string, rule_no int, keyword string")), rules)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert {(r.window, r.title, r.fallback_segment) for r in out.collect()} == {(0, "A", None), (1, "Part 2", 1)}


def test_relevance(spark):
    c = spark.createDataFrame([(1, 0, "the Red car"), (1, 1, None), (2, 0, "blue")], "video_id long, cluster long, corpus string")
    q = spark.createDataFrame([(1, "red and blue car"), (2, "and"), (3, "!"), (4, None), (5, "red red")], "query_id int, query string")
    got = {tuple(r) for r in ra.query_relevance(c, q, ["and"]).collect()}
    share = {1: ["red", "blue", "car"], 2: ["and"], 3: [], 4: [], 5: ["red"]}
    want = {(v, k, i, round(sum(w in (t or "").lower() for w in ws) / len(ws), 4) if ws else 1.0) for v, k, t in [(1, 0, "the Red car"), (1, 1, None), (2, 0, "blue")] for i, ws in share.items()}
    assert got == want
    assert {tuple(r) for r in ra.query_relevance(c, q, ["and"], all_pairs=False).collect()} == {x for x in want if x[3] > 0}
    assert ra.query_relevance(c, q.limit(0), []).count() == 0
