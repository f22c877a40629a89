"""Streams give what batches give."""

import time

import pytest
from pyspark.sql import functions as F

from tracelake.functions import exprs as ex
from tracelake.operators import events as ev
from tracelake.streaming import streams as st

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drained(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def points(spark):
    rows = [(1, t, i, i * 1.0, (i // 5 % 2) * 30.0 * i + t, 0.0) for t in range(3) for i in range(30)]
    return spark.createDataFrame(rows, "video_id long, track_id long, frame_number long, pts double, x double, y double")


def test_motion(spark, tmp_path):
    p = points(spark)
    p.where("pts < 14").coalesce(1).write.parquet(src := str(tmp_path / "p"))
    p.where("pts >= 14").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 10).parquet(src)
    got = {tuple(r) for r in drained(st.stream_motion_events(stream), tmp_path, "motion").collect()}
    boxes = p.withColumn("bbox", ex.box("x", "y", F.lit(0.0), F.lit(0.0))).withColumn("confidence", F.lit(0.5))
    want = {(r.video_id, r.track_id, r.event_type, r.start) for r in ev.motion_events(boxes, boxes.select("video_id", "track_id", "confidence").distinct()).collect()}
    assert got == want and want


def test_zone(spark, tmp_path):
    p = points(spark).withColumn("bbox", ex.box("x", "y", F.lit(2.0), F.lit(2.0)))
    zones = spark.range(1).select(F.lit("z").alias("zone_id"), ex.rect_zone(-10, -10, 60, 60).alias("polygon"))
    marked = p.crossJoin(zones).select("zone_id", "video_id", "track_id", "pts", ex.in_polygon(F.col("x") + 1, F.col("y") + 1, F.col("polygon")).alias("inside"))
    marked.coalesce(1).write.parquet(src := str(tmp_path / "z"))
    got = {tuple(r) for r in drained(st.stream_zone_events(spark.readStream.schema(marked.schema).parquet(src)), tmp_path, "zone").collect()}
    want = {(r.zone_id, r.video_id, r.track_id, r.event_type, r.start, r.dwell) for r in ev.zone_events(p, zones).collect()}
    assert got == want and want


def test_upsert(spark, tmp_path):
    src = str(tmp_path / "u")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, v string").parquet(src)
    st.stream_upsert(stream, out := str(tmp_path / "out"), "id", str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(2, "c")], "id long, v string").coalesce(1).write.mode("append").parquet(src)
    st.stream_upsert(stream, out, "id", str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in st.newest(spark.read.parquet(out), "id").collect()} == {(1, "a"), (2, "c")}


def test_budget(spark, tmp_path):
    from tracelake.operators.ranking import admit

    df = spark.createDataFrame([("k", i, i * 0.5, 3000) for i in range(200)], "budget_key string, request_id long, t double, tokens long")
    df.where("t < 40").coalesce(1).write.parquet(src := str(tmp_path / "b"))
    df.where("t >= 40").coalesce(1).write.mode("append").parquet(src)
    got = {tuple(r) for r in drained(st.stream_admit(spark.readStream.schema(df.schema).parquet(src)), tmp_path, "budget").collect()}
    assert got == {(r.budget_key, r.request_id, r.admitted) for r in admit(df).collect()} and {a for _, _, a in got} == {True, False}


def test_text_fusion(spark, tmp_path):
    from tracelake.operators.fusion import fuse_text

    rows = [(1, "a", i, f, x, 0.0, 20.0, 10.0, 0.5 + i / 100) for i, (f, x) in enumerate([(0, 0.0), (1, 5.0), (1, 500.0), (3, 8.0), (20, 0.0), (21, 2.0), (60, 0.0)])]
    df = spark.createDataFrame(rows, "video_id long, normalized_text string, observation_id long, frame_number long, x double, y double, width double, height double, confidence double")
    df.coalesce(1).write.parquet(src := str(tmp_path / "t"))
    got = {tuple(r) for r in drained(st.stream_text_fusion(spark.readStream.schema(df.schema).parquet(src)), tmp_path, "texts").collect()}
    batch = fuse_text(df.withColumn("pts", F.col("frame_number") * 1.0).withColumn("text", F.col("normalized_text")).withColumn("bbox", ex.box("x", "y", "width", "height")))
    want = {(r.video_id, r.normalized_text, r.first_frame, r.last_frame, r.confidence_summary["count"], r.confidence_summary["max"]) for r in batch.collect() if r.last_frame < 60}
    assert got == want and len(want) == 3
    timed = st.stream_text_fusion(spark.readStream.schema(df.schema).parquet(src), 1).writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "flushed")).start()
    for _ in range(60):
        flushed = [r[2] for r in spark.table("flushed").collect()]
        if len(flushed) == 4:
            break
        time.sleep(1)
    timed.stop()
    assert sorted(flushed) == [0, 1, 20, 60]


def test_association(spark, tmp_path):
    """Two triggers give the tracks of the batch; a gap over 30 frames ends every track."""
    from tracelake.operators.tracks import associate_tracks

    boxes = [(v, f, c, 0.9 if f % 3 else 0.3, 100.0 * c + 2 * f, 5.0 * c) for v in (1, 2) for f in [*range(12), 30, 31, 70, 71] for c in (0, 1)]
    rows = [(v, i, f, f"k{c % 2}", s, x, y, 40.0, 40.0) for i, (v, f, c, s, x, y) in enumerate(boxes)]
    df = spark.createDataFrame(rows, "video_id long, detection_id long, frame_number long, class_name string, confidence double, x double, y double, width double, height double")
    batch = {(r.detection_id, r.track_id) for r in associate_tracks(df.withColumn("bbox", ex.box("x", "y", "width", "height"))).collect()}
    frames = {}
    for i, track in batch:
        frames.setdefault(track, []).append(rows[i][2])
    assert len(frames) == 8 and all(max(f) < 70 or min(f) >= 70 for f in frames.values())
    # frame 0 is too unsure to start a track; what follows of the first stretch is one track a class and video
    assert sorted(len(f) for f in frames.values()) == [2] * 4 + [13] * 4
    df.where("frame_number < 8").coalesce(1).write.parquet(src := str(tmp_path / "d"))
    df.where("frame_number >= 8").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    assert {(r.detection_id, r.track_id) for r in drained(st.stream_tracks(stream), tmp_path, "tracks").collect()} == batch
    assert associate_tracks(df.limit(0).withColumn("bbox", ex.box("x", "y", "width", "height"))).count() == 0


def test_event_time_orders_rows_and_drops_late_ones(spark, tmp_path):
    """Shuffled rows over many triggers give what the batch gives for all that the watermark has passed; a row behind it changes nothing."""
    p = points(spark).withColumn("ts", F.timestamp_seconds(F.lit(1_000_000) + F.col("pts")))
    order = [*range(0, 30, 2), *range(1, 30, 2)]
    for part in range(6):  # frames 0..9, then 10..19, then 20..29, each out of order in two files
        mine = [f for f in order if f // 10 == part // 2 and f % 2 == part % 2]
        p.where(F.col("frame_number").isin(mine)).coalesce(1).write.mode("append").parquet(src := str(tmp_path / "p"))
    p.where("frame_number = 3").withColumn("x", F.lit(1e6)).coalesce(1).write.mode("append").parquet(src)  # far too late
    end = p.limit(1).select("video_id", F.lit(99).cast("long").alias("track_id"), "frame_number", "pts", "x", "y", F.timestamp_seconds(F.lit(1_000_100)).alias("ts"))
    end.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = [tuple(r) for r in drained(st.stream_motion_events(stream, event_time="ts", late="10 seconds"), tmp_path, "timed_motion").collect()]
    boxes = p.withColumn("bbox", ex.box("x", "y", F.lit(0.0), F.lit(0.0))).withColumn("confidence", F.lit(0.5))
    want = [(r.video_id, r.track_id, r.event_type, r.start) for r in ev.motion_events(boxes, boxes.select("video_id", "track_id", "confidence").distinct()).collect()]
    assert sorted(got) == sorted(want) and want


def test_event_time_closes_texts(spark, tmp_path):
    """Time in the data closes sightings, also in a query that ends; a pause over idle_ms parts them as the batch's frame gap would."""
    rows = [(1, t, i, f, 0.0, 0.0, 20.0, 10.0, 0.5) for i, (t, f) in enumerate([("a", 0), ("b", 1), ("a", 2), ("a", 1), ("a", 40), ("b", 41), ("z", 100)])]
    df = spark.createDataFrame(rows, "video_id long, normalized_text string, observation_id long, frame_number long, x double, y double, width double, height double, confidence double").withColumn("ts", F.timestamp_seconds(F.lit(5000) + F.col("frame_number")))
    late = df.where("observation_id = 1").withColumn("observation_id", F.lit(99).cast("long"))
    none = df.where("observation_id = 1").withColumn("ts", F.lit(None).cast("timestamp"))
    src = str(tmp_path / "t")
    for part in ("observation_id < 3", "observation_id = 3", "observation_id IN (4, 5)", "observation_id = 6"):
        df.where(part).coalesce(1).write.mode("append").parquet(src)
    late.unionByName(none).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = drained(st.stream_text_fusion(stream, 20_000, "ts", "5 seconds"), tmp_path, "timed_texts").collect()
    assert sorted((r.normalized_text, r.first_frame, r.last_frame, r.n) for r in got) == [("a", 0, 2, 3), ("a", 40, 40, 1), ("b", 1, 1, 1), ("b", 41, 41, 1)]


def test_event_time_zone(spark, tmp_path):
    p = points(spark).withColumn("bbox", ex.box("x", "y", F.lit(2.0), F.lit(2.0)))
    zones = spark.range(1).select(F.lit("z").alias("zone_id"), ex.rect_zone(-10, -10, 60, 60).alias("polygon"))
    marked = p.crossJoin(zones).select("zone_id", "video_id", "track_id", "pts", ex.in_polygon(F.col("x") + 1, F.col("y") + 1, F.col("polygon")).alias("inside"), F.timestamp_seconds(F.lit(1000) + F.col("pts")).alias("ts"))
    src = str(tmp_path / "z")
    for keep in ("pts % 3 = 1", "pts % 3 = 0", "pts % 3 = 2"):
        marked.where(keep).coalesce(1).write.mode("append").parquet(src)
    marked.limit(1).withColumn("track_id", F.lit(99).cast("long")).withColumn("ts", F.timestamp_seconds(F.lit(2000))).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = [tuple(r) for r in drained(st.stream_zone_events(stream, event_time="ts", late="60 seconds"), tmp_path, "timed_zone").collect()]
    want = [(r.zone_id, r.video_id, r.track_id, r.event_type, r.start, r.dwell) for r in ev.zone_events(p, zones).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and want
