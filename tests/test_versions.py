"""Upserts into a versioned table against a dict."""

import os
import random
import shutil

import pytest

from tracelake.sources.versions import VersionedTable
from tracelake.streaming import streams as st

SCHEMA = "id long, at int, v string"


def rows(df):
    return {r.id: r.v for r in df.collect()}


def test_last_write_wins_and_reads_stay_bounded(spark, tmp_path):
    t, rng, want = VersionedTable(spark, str(tmp_path / "t"), "id", buckets=4, fanout=3), random.Random(2), {}
    for epoch in range(14):
        batch = [(rng.choice([None, *range(12)]), at, f"{epoch}-{at}") for at in range(6)]
        want |= {k: v for k, _, v in batch}
        t.put(spark.createDataFrame(batch, SCHEMA), epoch, "at")
        levels = [level for _, level, _ in t.runs()]
        assert all(levels.count(x) < 3 for x in levels)
    assert rows(t.read()) == want and t.read().columns == ["id", "v"]
    assert sorted(t.runs())[0] and len(t.runs()) == 14 // 9 + 14 % 9 // 3 + 14 % 3
    asked = spark.createDataFrame([(3,), (None,), (3,), (99,)], "id long")
    assert rows(t.read(asked)) == {k: v for k, v in want.items() if k in (3, None)}
    assert t.vacuum() > 0 and rows(t.read()) == want


def test_ties_empty_batches_and_clashes(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "id", buckets=2)
    with pytest.raises(ValueError):
        t.read()
    t.put(spark.createDataFrame([], SCHEMA), 0)
    assert t.runs() == [] and t.vacuum() == 0
    t.put(spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, None)], SCHEMA), 1, "at")
    assert rows(t.read()) == {1: "b", 2: None}
    with pytest.raises(ValueError):
        t.put(spark.createDataFrame([(1, "x")], "id long, _epoch string"), 2)


def test_repeated_and_broken_writes(spark, tmp_path):
    t = VersionedTable(spark, path := str(tmp_path / "t"), "id", buckets=2, fanout=2)
    t.put(spark.createDataFrame([(1, 0, "a")], SCHEMA), 0)
    t.put(spark.createDataFrame([(1, 0, "again")], SCHEMA), 0)
    assert rows(t.read()) == {1: "again"} and len(t.runs()) == 1
    t.put(spark.createDataFrame([(2, 0, "b")], SCHEMA), 1)
    assert [level for _, level, _ in t.runs()] == [1]
    t.put(spark.createDataFrame([(2, 0, "late copy")], SCHEMA), 1)  # merged already
    assert rows(t.read()) == {1: "again", 2: "b"}
    # a writer that was lost after its run, or within its manifest, changes nothing
    shutil.copytree(f"{path}/runs/{t.runs()[0][0]}", f"{path}/runs/lost")
    os.makedirs(f"{path}/manifests/n=77")
    assert rows(t.read()) == {1: "again", 2: "b"}
    t.put(spark.createDataFrame([(3, 0, "c")], SCHEMA), 2)
    assert rows(t.read()) == {1: "again", 2: "b", 3: "c"} and t.vacuum(1) > 0 and rows(t.read()) == {1: "again", 2: "b", 3: "c"}


def test_stream(spark, tmp_path):
    src, t = str(tmp_path / "u"), VersionedTable(spark, str(tmp_path / "t"), "id", buckets=2, fanout=2)
    for batch in ([(1, 0, "a"), (2, 0, "b")], [(2, 1, "c"), (2, 0, "z")], [(3, 0, "d")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        st.stream_upsert(spark.readStream.schema(SCHEMA).parquet(src), t.path, "id", str(tmp_path / "c"), "at", t).awaitTermination()
    assert rows(t.read()) == {1: "a", 2: "c", 3: "d"} and len(t.runs()) == 2
