"""Readers and sinks: captions, annotations, predictions, catalogues, fingerprints, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.exprs import parse_ts

_BOX = "struct<x:double,y:double,width:double,height:double>"
_ITEMS = {
    "detections": f"detection_id:string,timestamp_pts:double,class_label:string,bbox:{_BOX},frame_index:long,confidence:double",
    "events": "event_id:string,event_type:string,start_seconds:double,end_seconds:double,participants:array<string>,confidence:double",
    "qa": "qa_id:string,question:string,is_answerable:boolean,reference_answer:string,predicted_answer:string,did_abstain:boolean,confidence:double",
    "ocr": "ocr_id:string,timestamp_pts:double,expected_text:string",
    "transcripts": "transcript_id:string,start_seconds:double,end_seconds:double,reference_text:string",
}


def read_annotations(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """One table per modality and `status` (video_id, modality, status, n; n null where items are missing) of ground-truth JSON.

    A file is one document; with lines each of its lines is one, so that many tasks read a large file. A video
    may be spread over documents, and has a status row for each.
    """
    video = "video_id string, duration_seconds double, " + ", ".join(f"{m} struct<status:string,items:array<struct<{f}>>>" for m, f in _ITEMS.items())
    raw = spark.read.text(path, wholetext=not lines).select(F.from_json("value", f"videos array<struct<{video.replace(' string', ':string').replace(' double', ':double').replace(' struct', ':struct')}>>").alias("d"))
    v = raw.select(F.explode("d.videos").alias("v")).select("v.*")
    out = {m: v.select("video_id", F.explode(f"{m}.items").alias("i")).select("video_id", "i.*") for m in _ITEMS}
    status = [v.select("video_id", F.lit(m).alias("modality"), F.coalesce(f"{m}.status", F.lit("not_annotated")).alias("status"), F.when(F.col(f"{m}.items").isNotNull(), F.size(f"{m}.items")).alias("n")) for m in _ITEMS]
    out["status"] = status[0]
    for s in status[1:]:
        out["status"] = out["status"].unionByName(s)
    return out


def read_predictions(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Predictions of either shape, {videos: [...]} or {video_id: {...}}; confidence defaults to 1, null stays apart from empty in `status`.

    lines as in read_annotations.
    """
    kinds = {m: f"array<struct<{_ITEMS[m]}>>" for m in ("detections", "events", "qa")} | {"ocr": "array<string>", "transcripts": "array<string>"}
    fields = ",".join(f"{m}:{k}" for m, k in kinds.items())
    raw = spark.read.text(path, wholetext=not lines)
    listed = raw.select(F.from_json("value", f"videos array<struct<video_id:string,{fields}>>").alias("d")).where("d.videos IS NOT NULL").select(F.explode("d.videos").alias("v")).select("v.*")
    keyed = raw.where(F.get_json_object("value", "$.videos").isNull()).select(F.from_json("value", f"map<string,struct<{fields}>>").alias("m")).select(F.explode("m").alias("video_id", "v")).select("video_id", "v.*")
    v = listed.unionByName(keyed)
    out = {}
    for m in kinds:
        each = v.select("video_id", F.explode(m).alias("i"))
        out[m] = each.select("video_id", "i.*").withColumn("confidence", F.coalesce("confidence", F.lit(1.0))) if m in ("detections", "events", "qa") else each.select("video_id", F.col("i").alias("text"))
    parts = [v.select("video_id", F.lit(m).alias("modality"), F.when(F.col(m).isNotNull(), F.size(m)).alias("n")) for m in kinds]
    out["status"] = parts[0]
    for s in parts[1:]:
        out["status"] = out["status"].unionByName(s)
    return out


def ingest_captions(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, provider, segment_id, start, end, text) of a folder of .json, .vtt, .srt and .txt captions; the file's name is the video."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    files = files.select(F.regexp_extract("file", r"^(.*)\.(\w+)$", 1).alias("video_id"), F.lower(F.regexp_extract("file", r"\.(\w+)$", 1)).alias("provider"), F.replace("value", F.lit("\r"), F.lit("")).alias("value"))
    seg = "struct<start_seconds:double,start:double,end_seconds:double,end:double,duration:double,text:string>"
    js = files.where("provider = 'json'").select("video_id", "provider", F.posexplode(F.from_json("value", f"struct<segments:array<{seg}>>")["segments"]).alias("i", "s"))
    s0 = F.coalesce("s.start_seconds", "s.start", F.lit(0.0))
    js = js.select("video_id", "provider", "i", s0.alias("start"), F.coalesce("s.end_seconds", "s.end", s0 + F.col("s.duration"), s0 + 5).alias("end"), F.col("s.text").alias("text"))
    arrow = r"([\d:.,]+)\s*-->\s*([\d:.,]+)"
    cue = files.where("provider IN ('vtt', 'srt')").select("video_id", "provider", F.posexplode(F.split("value", r"\n\s*\n")).alias("i", "c")).where(F.col("c").rlike(arrow))
    cue = cue.select("video_id", "provider", "i", parse_ts(F.regexp_extract("c", arrow, 1)).alias("start"), parse_ts(F.regexp_extract("c", arrow, 2)).alias("end"), F.regexp_replace(F.regexp_extract("c", r"-->[^\n]*\n([\s\S]*)$", 1), "\n", " ").alias("text"))
    stamp = r"^\[?(\d+(?::\d+){1,2}(?:[.,]\d+)?)\]?[\s\-:]+(.*)$"
    txt = files.where("provider = 'txt'").select("video_id", "provider", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("i", "c"))
    t0 = F.when(F.col("c").rlike(stamp), parse_ts(F.regexp_extract("c", stamp, 1))).otherwise(F.col("i") * 10.0)
    txt = txt.select("video_id", "provider", "i", t0.alias("start"), (t0 + F.when(F.col("c").rlike(stamp), 5.0).otherwise(10.0)).alias("end"), F.when(F.col("c").rlike(stamp), F.regexp_extract("c", stamp, 2)).otherwise(F.col("c")).alias("text"))
    rows = js.unionByName(cue).unionByName(txt).withColumn("text", F.trim(F.regexp_replace("text", r"<[^>]*>", ""))).where("text <> ''").withColumn("end", F.greatest("start", "end"))
    w = Window.partitionBy("video_id", "provider").orderBy("i")
    return rows.select("video_id", "provider", (F.row_number().over(w) - 1).alias("segment_id"), "start", "end", "text")


def resolve_transcripts(segments: DataFrame, priority: tuple[str, ...] = ("json", "vtt", "srt", "txt")) -> DataFrame:
    """The segments of each video's best provider."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("provider"))
    best = segments.groupBy("video_id").agg(F.min_by("provider", F.when(rank > 0, rank).otherwise(len(priority) + 1)).alias("provider"))
    return segments.join(best, ["video_id", "provider"], "left_semi")


def video_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The videos of manifest JSON with their id (the file's name without its ending) and number of scenes (0 where missing); lines as in read_annotations."""
    kinds = "videos array<struct<filename:string,duration_seconds:double,width:int,height:int,fps:double,frame_count:long,has_audio:boolean,is_vfr:boolean,timing_mode:string,scenes:array<struct<scene_index:int,start_frame:long,end_frame:long>>>>"
    v = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", kinds)["videos"]).alias("v")).select("v.*")
    return v.select(F.regexp_extract("filename", r"^(.*?)(\.\w+)?$", 1).alias("video_id"), "*", F.coalesce(F.size("scenes"), F.lit(0)).alias("n_scenes"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verify_fingerprints(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (file, sha256) with OK, MISMATCH or FILE_NOT_FOUND."""
    j = manifest.join(found.select("file", F.col("sha256").alias("actual")), "file", "left")
    return j.withColumn("result", F.when(F.col("actual").isNull(), "FILE_NOT_FOUND").when(F.col("actual") == F.col("sha256"), "OK").otherwise("MISMATCH"))


def upsert_by_key(existing: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """existing with the rows of batch in place of those of the same key: an anti-join and a union, so that existing is not sorted.

    Of a key's rows in the batch the last write wins: the largest by `order`, a column of
    the batch only, which is dropped; ties and a batch without order go by the largest row.
    A null key matches no other row.
    """
    names = existing.columns
    row = F.struct(*(F.col(c) for c in names))
    last = batch.groupBy(key).agg((F.max_by(row, F.struct(order, row)) if order else F.max(row)).alias("_row")).select("_row.*")
    return existing.join(batch.select(key).distinct(), key, "left_anti").select(*names).unionByName(last)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("video_id").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def link_catalog(df: DataFrame, url: str = "url") -> DataFrame:
    """Video and playlist ids of a URL column, one row per pair of ids with the links that have it."""
    u = F.col(url)
    vid = F.coalesce(*(F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in (r"[?&]v=([A-Za-z0-9_-]{11})(?:[&#]|$)", r"youtu\.be/([A-Za-z0-9_-]{11})(?:[?&#/]|$)", r"/(?:embed|shorts|live)/([A-Za-z0-9_-]{11})(?:[?&#/]|$)", r"^([A-Za-z0-9_-]{11})$")))
    lst = F.nullif(F.regexp_extract(u, r"[?&]list=([A-Za-z0-9_-]+)", 1), F.lit(""))
    return df.select(vid.alias("video_id"), lst.alias("playlist_id")).groupBy("video_id", "playlist_id").agg(F.count("*").alias("n_links"))


def with_provider(df: DataFrame, fn, schema: str) -> DataFrame:
    """Observation rows that user code makes of df's rows: fn takes and gives pandas frames; the schema is checked by Spark."""
    return df.mapInPandas(lambda frames: map(fn, frames), schema)
