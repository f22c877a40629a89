"""Findings of round 4: what is left on disk and what is carried between tasks."""

import random
import time

import numpy as np


def test_whole_texts_meet_the_rows_to_keep_without_an_exchange(spark):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    rows = spark.range(0, 5000, 1, 3).select(((F.col("id") % 3) * 2**33 + F.col("id") * 7).alias(cp.ROW), F.col("id").cast("string").alias("text"))
    keep = rows.where(F.xxhash64("text") % 3 == 0).select(cp.ROW)
    found = cp.chosen(rows, keep)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.join(keep, cp.ROW).collect()))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_leaves_no_shuffle_files(spark):
    import corpus_pipeline as cp

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {x for x in (files.apply(i).getName() for i in range(files.size())) if x.startswith("shuffle_")}

    before, until = shuffles(), time.time() + 20
    docs = spark.createDataFrame([(i, f"{i % 40} some words of a text that is like others {i % 40}") for i in range(200)], "doc_id long, text string")
    assert cp.near_duplicates(spark, docs, "").count() == 40
    while len(shuffles() - before) and time.time() < until:
        time.sleep(0.5)
    assert not shuffles() - before


def test_families_carry_only_differences_that_recur(spark):
    from tracelake.llm.common import Scratch
    from tracelake.llm.families import differences, family_links, recurring

    rng = random.Random(4)
    draw = lambda n: {rng.randrange(1 << 63) for _ in range(n)}
    base = draw(300)
    sets = {1: base}
    for i in range(2, 30):  # unlike the leader
        sets[i] = draw(300) | set(rng.sample(sorted(base), 5))
    for i in range(30, 60):  # like it, and like each other
        sets[i] = set(rng.sample(sorted(base), 295)) | draw(3)
    sets[60] = sets[2] | draw(4)
    elements = spark.createDataFrame([(i, bytearray(np.array(sorted(x), np.uint64).tobytes())) for i, x in sets.items()], "set_id long, elements binary")
    members = spark.createDataFrame([(i, 1, 2, i % 2) for i in sets], "set_id long, leader long, blocks int, block int")
    rows = recurring(differences(members, elements), Scratch(spark))
    left = {r.set_id: set(np.array(r.extra, np.int64).view(np.uint64).tolist()) for r in rows.collect()}
    assert left == {i: (sets[2] - base if i in (2, 60) else set()) for i in sets}
    got = {r.a: r.k for r in family_links(rows, 80, 0).where("k IS NOT NULL").groupBy("a").agg({"k": "sum"}).toDF("a", "k").collect()}
    want = {i: sum(i != j and 100 * len(x & y) >= 80 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
    assert got == {i: k for i, k in want.items() if k} and want[60] == 1 and want[30] > 10


def test_equal_boxes_are_associated_without_a_row_for_every_pair(monkeypatch):
    from tracelake.functions.matching import greedy
    from tracelake.operators import tracks as tr

    def share(p, q):
        w, h = (min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k]) for k in (0, 1))
        return w * h / (p[2] * p[3] + q[2] * q[3] - w * h) if w > 0 and h > 0 else 0.0

    rng = random.Random(8)
    for most in (0, 1 << 20):
        monkeypatch.setattr(tr, "MAX_PAIRS", most)
        for _ in range(30):
            a, b = ([tuple(map(float, (rng.randrange(6), rng.randrange(6), rng.choice((4, 6)), 5))) for _ in range(rng.randrange(1, 60))] for _ in range(2))
            want = greedy({(i, j): o for i, p in enumerate(a) for j, q in enumerate(b) if (o := share(p, q)) >= 0.2})
            i, j = tr._pairs(np.array(a), np.array(b), 0.2)
            assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want
    sizes, taken = [], tr._taken
    monkeypatch.setattr(tr, "_taken", lambda x, y: sizes.append(len(x)) or taken(x, y))
    frame = [{"detection_id": n, "class_name": "c", "confidence": 0.9, "bbox": {"x": float(n % 5), "y": 0.0, "width": 9.0, "height": 9.0}} for n in range(3000)]
    live = tr.Association()
    first, second = live.step(1, frame), live.step(2, frame)
    assert [x for x, _ in sorted(second)] == list(range(3000)) and sorted(second) == sorted(first)
    assert max([0, *sizes]) <= 1 << 20


def test_components_leave_one_table_of_their_rounds(spark):
    import os

    from tracelake.functions.shared import components, held, shared_folder

    folder = os.path.dirname(shared_folder(spark, "held")).removeprefix("file:")
    tables = lambda: set(os.listdir(folder))
    links, before = held(spark.createDataFrame([(i, i + 1) for i in range(99)], "a long, b long")), tables()
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(100)}
    assert len(tables() - before) == 1


def test_classes_without_rivals_are_matched_at_once(monkeypatch):
    from tracelake.functions import matching

    monkeypatch.setattr(matching.heapq, "heappop", None)  # one end after the other
    left, right = {0: list(range(0, 50)), 1: [100, 101]}, {7: list(range(200, 230)), 8: list(range(300, 360))}
    found = matching.greedy_classes({(0, 7): 0.9, (1, 8): 0.9, (0, 8): 0.8}, left, right)
    want = [*((0, 7, n, 200 + n) for n in range(30)), (1, 8, 100, 300), (1, 8, 101, 301), *((0, 8, n, 272 + n) for n in range(30, 50))]
    assert sorted(found) == sorted(want)
