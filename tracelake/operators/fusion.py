"""Fusing repeated observations of text and speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.ordered import islands, ordered_fold

_BOX = ("x", "y", "width", "height")
FRAME_GAP, MIN_IOU, MAX_DISTANCE, SPEECH_GAP = 5, 0.2, 60.0, 0.5


def compatible(a, b) -> float | None:
    """How well two boxes agree, None if not; a missing box agrees with any."""
    if a is None or b is None:
        return 0.0
    w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    both = max(w, 0.0) * max(h, 0.0)
    union = a["width"] * a["height"] + b["width"] * b["height"] - both
    iou = both / union if union > 0 else 0.0
    dx, dy = a["x"] + a["width"] / 2 - b["x"] - b["width"] / 2, a["y"] + a["height"] / 2 - b["y"] - b["height"] / 2
    return iou if iou >= MIN_IOU or (dx * dx + dy * dy) ** 0.5 <= MAX_DISTANCE else None


class Sightings:
    """The open sightings of one text: each a number, its last frame and its last box. Closed ones are forgotten."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int, object]] = []
        self.made = 0

    def put(self, frame: int, box: object, frame_gap: int) -> int:
        """The number of the sighting that a box joins: the open one that it fits best, the older one of equals, else a new one.

        As `compatible` says, with a box's corners and centre worked out once; boxes that lie well
        beyond MAX_DISTANCE and apart in height are passed over.
        """
        best, at = None, None
        if self.open and any(frame - c[1] > frame_gap for c in self.open):
            self.open = [c for c in self.open if frame - c[1] <= frame_gap]
        far = MAX_DISTANCE * 1.0001
        if box is not None:
            x, y, half_w, half_h = box["x"], box["y"], box["width"] / 2, box["height"] / 2
            right, bottom, area = x + box["width"], y + box["height"], box["width"] * box["height"]
        for i, (_, _, last) in enumerate(self.open):
            if last is None or box is None:
                fit = 0.0
            else:
                left, top, last_right, last_bottom, last_area, cx, cy = last
                dy = cy - y - half_h
                h = (bottom if bottom < last_bottom else last_bottom) - (y if y > top else top)
                if h <= 0 and (dy > far or dy < -far):
                    continue
                w = (right if right < last_right else last_right) - (x if x > left else left)
                both = w * h if w > 0 and h > 0 else 0.0
                union = last_area + area - both
                fit = both / union if union > 0 else 0.0
                if fit < MIN_IOU:
                    dx = cx - x - half_w
                    if not (dx * dx + dy * dy) ** 0.5 <= MAX_DISTANCE:
                        continue
            if best is None or fit > best:
                best, at = fit, i
        kept = None if box is None else (x, y, right, bottom, area, x + half_w, y + half_h)
        if at is None:
            self.open.append((self.made, frame, kept))
            self.made += 1
            return self.made - 1
        number, _, last = self.open[at]
        self.open[at] = (number, frame, kept if kept is not None else last)
        return number


def fuse_text(ocr: DataFrame, frame_gap: int = FRAME_GAP) -> DataFrame:
    """ocr (video_id, observation_id, frame_number, pts, text, normalized_text, confidence, bbox) as one row per sighting of a text in a place.

    The rows of a text stream in order of frame and observation past its open sightings, and each
    joins the one whose last box fits best; a sighting closes frame_gap frames after its last
    row. So a text that stands in every frame takes no more memory than one that is seen once.
    Rows without a frame take no part; a missing box fits any.
    """
    names = ["video_id", "normalized_text", "observation_id", "frame_number", "pts", "text", "confidence"]
    kinds = {f.name: f.dataType.simpleString() for f in ocr.schema}
    seen = ocr.where("frame_number IS NOT NULL").select(*names, *(F.col(f"bbox.{c}").cast("double").alias(c) for c in _BOX))

    def step(state: Sightings, row) -> tuple[Sightings, list[tuple]]:
        box = {"x": row.x, "y": row.y, "width": row.width, "height": row.height}
        return state, [(*row, state.put(int(row.frame_number), None if box["x"] is None or box["x"] != box["x"] else box, frame_gap))]

    keys = names[:2]
    rows = ordered_fold(seen, keys, ["frame_number", "observation_id"], Sightings, step, ", ".join(f"{c} {kinds[c]}" for c in names) + "".join(f", {c} double" for c in _BOX) + ", _cluster long")
    rows = rows.withColumn("bbox", F.when(F.col("x").isNotNull() & ~F.isnan("x"), F.struct(*_BOX)))
    order = F.struct("frame_number", "observation_id")
    return rows.groupBy(*keys, "_cluster").agg(
        F.max_by("text", F.struct("confidence", "frame_number", "observation_id")).alias("text"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"), F.min("pts").alias("first_seconds"), F.max("pts").alias("last_seconds"),
        F.array_sort(F.collect_list("observation_id")).alias("supporting_observation_ids"), F.struct(F.avg("confidence").alias("mean"), F.min("confidence").alias("min"), F.max("confidence").alias("max"), F.count("*").alias("count")).alias("confidence_summary"), F.max_by("bbox", order).alias("last_bbox"),
    ).withColumn("observation_id", F.element_at("supporting_observation_ids", 1)).drop("_cluster")


def fuse_transcripts(segments: DataFrame, gap: float = SPEECH_GAP) -> DataFrame:
    """Adjacent segments of a video as one: same language, at most gap apart, and equal text or overlapping with one text inside the other.

    segments: video_id, segment_id, start, end, text, language, and optionally confidence.
    """
    s = segments if "confidence" in segments.columns else segments.withColumn("confidence", F.lit(None).cast("double"))
    w = Window.partitionBy("video_id").orderBy("start", "end", "segment_id")
    prev = lambda c: F.lag(c).over(w)
    overlaps = F.col("start") < prev("end")
    inside = F.contains("text", prev("text")) | F.contains(prev("text"), F.col("text"))
    joins = (F.col("language") == prev("language")) & (F.col("start") - prev("end") <= gap) & ((F.col("text") == prev("text")) | (overlaps & inside))
    rows = s.withColumn("_island", islands(~F.coalesce(joins, F.lit(False)), w))
    best = F.struct(F.coalesce("confidence", F.lit(0.0)), F.length("text"), -F.col("segment_id"))
    return rows.groupBy("video_id", "_island").agg(F.min("segment_id").alias("segment_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("text", best).alias("text"), F.first("language").alias("language"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_segments")).drop("_island")


def confidence_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("confidence").alias("mean"), F.min("confidence").alias("min"), F.max("confidence").alias("max"), F.count("*").alias("count"))
