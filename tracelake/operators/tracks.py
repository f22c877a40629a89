"""Tracks and trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.exprs import compass8, cx, cy, heading
from tracelake.functions.matching import greedy_classes
from tracelake.functions.ordered import islands, range_join

KEY = ["video_id", "track_id"]


def track_table(points: DataFrame, min_frames: int = 1) -> DataFrame:
    """One row per track: its ends, mean confidence, first and last box; tracks over fewer frames than min_frames are dropped."""
    order = F.struct("frame_number", "pts")
    t = points.groupBy(*KEY).agg(
        F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"), F.min("pts").alias("first_seconds"), F.max("pts").alias("last_seconds"),
        F.round(F.avg("confidence"), 4).alias("confidence"), F.min_by("bbox", order).alias("start_bbox"), F.max_by("bbox", order).alias("end_bbox"), F.count("*").alias("n_points"),
    )
    return t.where(F.col("last_frame") - F.col("first_frame") + 1 >= min_frames)


def _steps(points: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("frame_number", "pts")
    p = points.select(*KEY, "frame_number", "pts", cx(F.col("bbox")).alias("cx"), cy(F.col("bbox")).alias("cy"))
    return p.select("*", (F.col("cx") - F.lag("cx").over(w)).alias("dx"), (F.col("cy") - F.lag("cy").over(w)).alias("dy"), (F.col("pts") - F.lag("pts").over(w)).alias("dt"))


def trajectory_summary(points: DataFrame) -> DataFrame:
    """Displacement, path length, duration, mean speed and direction (from 2 pixels on) of each track."""
    order = F.struct("frame_number", "pts")
    s = _steps(points).groupBy(*KEY).agg(
        F.count("*").alias("n_points"), F.sum(F.hypot("dx", "dy")).alias("path"), F.min("pts").alias("t0"), F.max("pts").alias("t1"),
        F.min_by("cx", order).alias("x0"), F.min_by("cy", order).alias("y0"), F.max_by("cx", order).alias("x1"), F.max_by("cy", order).alias("y1"),
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    duration = F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-6))
    return s.select(*KEY, "n_points", F.hypot(dx, dy).alias("displacement"), F.coalesce("path", F.lit(0.0)).alias("path_length"), duration.alias("duration"), (F.coalesce("path", F.lit(0.0)) / duration).alias("mean_speed"), F.when(F.hypot(dx, dy) >= 2, compass8(heading(dx, dy))).alias("direction"))


def trajectory_in_window(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """Net displacement and velocity of each candidate's tracks inside its interval.

    candidates: video_id, candidate_id, track_id, start, end.
    """
    c = candidates.withColumnRenamed("start", "c_start").withColumnRenamed("end", "c_end")
    p = points.withColumn("pts_end", F.col("pts"))
    inside = range_join(p, c, KEY, ("pts", "pts_end"), ("c_start", "c_end"))
    order = F.struct("frame_number", "pts")
    s = inside.groupBy("video_id", "candidate_id", "track_id").agg(F.count("*").alias("n_points"), F.min_by(F.struct(cx(F.col("bbox")).alias("x"), cy(F.col("bbox")).alias("y"), "pts"), order).alias("a"), F.max_by(F.struct(cx(F.col("bbox")).alias("x"), cy(F.col("bbox")).alias("y"), "pts"), order).alias("b"))
    move = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return s.select("video_id", "candidate_id", "track_id", "n_points", move.alias("displacement"), (move / F.greatest(F.col("b.pts") - F.col("a.pts"), F.lit(0.001))).alias("velocity"))


def filter_detections(detections: DataFrame, min_confidence: float = 0.0, classes: list[str] | None = None, per_frame: int | None = None) -> DataFrame:
    d = detections.where(F.col("confidence") >= min_confidence)
    d = d.where(F.col("class_name").isin(classes)) if classes else d
    if per_frame is None:
        return d
    w = Window.partitionBy("video_id", "frame_number").orderBy(F.desc("confidence"), "detection_id")
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_frame).drop("_r")


HIGH, LOW, BIRTH, MAX_MISSED = 0.5, 0.1, 0.6, 30
FIRST_IOU, SECOND_IOU = 0.2, 0.5


#: Places of boxes that are compared at once.
BLOCK = 1 << 20


def _overlapping(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, overlap) of the boxes (x, y, width, height) that overlap by at least `least`, over 0.

    Boxes of b lie by their corners in cells as large as the largest of them; a box of a looks into
    the cells that it can reach, of which each column is one run of the sorted boxes. Boxes without
    area and ones that are not finite overlap none.
    """
    good = [np.flatnonzero(np.isfinite(m).all(axis=1) & (m[:, 2] > 0) & (m[:, 3] > 0)) for m in (a, b)]
    none = np.empty(0, np.int64)
    if not len(good[0]) or not len(good[1]):
        return none, none, np.empty(0)
    a, b = a[good[0]], b[good[1]]
    low = b[:, :2].min(axis=0)
    span = b[:, :2].max(axis=0) - low
    size = np.maximum(b[:, 2:].max(axis=0) * (1 + 1e-9), span / (1 << 20)) + 1e-300
    cell = np.floor((b[:, :2] - low) / size).astype(np.int64)
    rows = int(cell[:, 1].max()) + 1
    key = cell[:, 0] * rows + cell[:, 1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    last = cell.max(axis=0)
    first_at = np.clip(np.floor((a[:, :2] - low) / size) - 1, 0, last + 1).astype(np.int64)
    last_at = np.clip(np.floor((a[:, :2] + a[:, 2:] - low) / size), -1, last).astype(np.int64)
    found: list[tuple] = []
    for column in range(int((last_at[:, 0] - first_at[:, 0]).max()) + 1):
        mine = np.flatnonzero((first_at[:, 0] + column <= last_at[:, 0]) & (first_at[:, 1] <= last_at[:, 1]))
        base = (first_at[mine, 0] + column) * rows
        start, end = np.searchsorted(key, base + first_at[mine, 1]), np.searchsorted(key, base + last_at[mine, 1], "right")
        total = np.cumsum(end - start)
        cuts = np.searchsorted(total, np.arange(BLOCK, int(total[-1]) if len(total) else 0, BLOCK)) + 1
        for part in np.split(np.arange(len(mine)), np.unique(cuts)):
            n = end[part] - start[part]
            i = np.repeat(mine[part], n)
            j = order[np.repeat(start[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            w = np.minimum(a[i, 0] + a[i, 2], b[j, 0] + b[j, 2]) - np.maximum(a[i, 0], b[j, 0])
            h = np.minimum(a[i, 1] + a[i, 3], b[j, 1] + b[j, 3]) - np.maximum(a[i, 1], b[j, 1])
            k = np.flatnonzero((w > 0) & (h > 0))
            i, j, w, h = i[k], j[k], w[k], h[k]
            o = w * h / (a[i, 2] * a[i, 3] + b[j, 2] * b[j, 3] - w * h)
            k = np.flatnonzero(o >= least)
            found.append((good[0][i[k]], good[1][j[k]], o[k]))
    if not found:
        return none, none, np.empty(0)
    i, j, o = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, o


def _taken(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs that a pass in this order takes, each as long as both of its ends are free.

    A pair that is the first of both its ends is taken in any case; rounds take these all at once and
    drop what they have closed. What long chains leave after some rounds goes one by one.
    """
    at, out = np.arange(len(left)), []
    for _ in range(20):
        if not len(at):
            break
        first = [np.zeros(len(at), bool), np.zeros(len(at), bool)]
        for f, x in zip(first, (left[at], right[at]), strict=True):
            f[np.unique(x, return_index=True)[1]] = True
        now = at[first[0] & first[1]]
        out.append(now)
        at = at[~np.isin(left[at], left[now]) & ~np.isin(right[at], right[now])]
    used: tuple[set, set] = (set(), set())
    for n, g, p in zip(at.tolist(), left[at].tolist(), right[at].tolist(), strict=True):
        if g not in used[0] and p not in used[1]:
            used[0].add(g)
            used[1].add(p)
            out.append(np.array([n]))
    return np.sort(np.concatenate(out)) if out else at


def _alike(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of m's rows with equal rows together, each of these rising, and where each run of equal ones starts (one more entry)."""
    order = np.lexsort(m.T)
    rows = m[order]
    return order, np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1), [True]))) if len(m) else np.zeros(1, np.int64)


#: Pairs of boxes that are sorted at once; if equal boxes make more, they are matched as one with their members.
MAX_PAIRS = 1 << 20


def _pairs(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in a and in b) by falling overlap, ties by place in a, then in b, as long as both are free. Overlaps of equal boxes are worked out once."""
    (order_a, start_a), (order_b, start_b) = _alike(a), _alike(b)
    i, j, o = _overlapping(a[order_a[start_a[:-1]]], b[order_b[start_b[:-1]]], least)
    many_a, many_b = np.diff(start_a)[i], np.diff(start_b)[j]
    n = many_a * many_b
    if n.sum() <= max(MAX_PAIRS, 4 * len(n)):
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        across = np.repeat(many_b, n)
        left, right = order_a[np.repeat(start_a[i], n) + k // across], order_b[np.repeat(start_b[j], n) + k % across]
        order = np.lexsort((right, left, -np.repeat(o, n)))
        taken = order[_taken(left[order], right[order])]
        return left[taken], right[taken]
    members = lambda of, order, start: {x: order[start[x] : start[x + 1]].tolist() for x in np.unique(of).tolist()}
    found = greedy_classes(dict(zip(zip(i.tolist(), j.tolist(), strict=True), o.tolist(), strict=True)), members(i, order_a, start_a), members(j, order_b, start_b))
    return np.array([x for *_, x, _ in found], np.int64), np.array([x for *_, x in found], np.int64)


class Association:
    """The live tracks of a video between frames; holds nothing of tracks that have ended.

    A track is a constant-velocity Kalman filter over centre and size of a box; each of the four runs for itself,
    and as they are updated together they share one covariance. Tracks are rows of arrays, in the order of their birth.
    """

    def __init__(self) -> None:
        self.last: int | None = None
        self.classes: dict = {}
        self.kind, self.missed, self.birth = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)
        self.x, self.v, self.p = np.empty((0, 4)), np.empty((0, 4)), np.empty((0, 4))

    def _keep(self, mask: np.ndarray) -> None:
        for name in ("kind", "missed", "birth", "x", "v", "p"):
            setattr(self, name, getattr(self, name)[mask])

    def _matched(self, tracks: np.ndarray, rows: np.ndarray, kind: np.ndarray, boxes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(tracks, rows) of the pairs of one class by falling overlap; ties by the track's birth, then detection."""
        w, h = np.maximum(self.x[tracks, 2], 1e-3), np.maximum(self.x[tracks, 3], 1e-3)
        own = np.column_stack((self.x[tracks, 0] - self.x[tracks, 2] / 2, self.x[tracks, 1] - self.x[tracks, 3] / 2, w, h))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for k in np.unique(kind[rows]):
            mine, seen = np.flatnonzero(self.kind[tracks] == k), rows[kind[rows] == k]
            if len(mine):
                i, j = _pairs(own[mine], boxes[seen], least)
                found.append((tracks[mine[i]], seen[j]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def step(self, frame: int, rows: list) -> list[tuple]:
        """(detection_id, label) of the frame's detections that are part of a track; label is the frame and the detection that it began with."""
        rows = sorted({(r["detection_id"], r["class_name"]): r for r in rows}.values(), key=lambda r: r["detection_id"])
        boxes = np.array([[r["bbox"][c] for c in ("x", "y", "width", "height")] for r in rows], float).reshape(-1, 4)
        return self.advance(frame, [r["detection_id"] for r in rows], [r["class_name"] for r in rows], np.array([r["confidence"] for r in rows], float), boxes)

    def advance(self, frame: int, ids: list, classes: list, confidence: np.ndarray, boxes: np.ndarray) -> list[tuple]:
        """The same for columns of rows (boxes: x, y, width, height) in the order of their ids."""
        if self.last is None or frame - self.last > MAX_MISSED:
            self._keep(np.zeros(len(self.kind), bool))
        else:
            for _ in range(frame - self.last):
                a, b, c, d = self.p.T
                self.x, self.p = self.x + self.v, np.column_stack((a + b + c + d + 1.0, b + d, c + d, d + 0.1))
            self.missed = self.missed + (frame - self.last)
            self._keep(self.missed <= MAX_MISSED)
        self.last = frame
        kind = np.array([self.classes.setdefault(c, len(self.classes)) for c in classes], np.int64)
        high = np.flatnonzero(confidence >= HIGH)
        tracks, seen = self._matched(np.arange(len(self.kind)), high, kind, boxes, FIRST_IOU)
        free = np.setdiff1d(np.arange(len(self.kind)), tracks)
        more = self._matched(free, np.flatnonzero((confidence >= LOW) & (confidence < HIGH)), kind, boxes, SECOND_IOU)
        born = np.setdiff1d(high, seen)
        born = born[confidence[born] >= BIRTH]
        tracks, seen = np.concatenate((tracks, more[0])), np.concatenate((seen, more[1]))
        measured = np.column_stack((boxes[:, 0] + boxes[:, 2] / 2, boxes[:, 1] + boxes[:, 3] / 2, boxes[:, 2], boxes[:, 3]))
        a, b, c, d = self.p[tracks].T
        k0, k1, r = a / (a + 4.0), c / (a + 4.0), measured[seen] - self.x[tracks]
        self.x[tracks] += k0[:, None] * r
        self.v[tracks] += k1[:, None] * r
        self.p[tracks] = np.column_stack(((1 - k0) * a, (1 - k0) * b, c - k1 * a, d - k1 * b))
        self.missed[tracks] = 0
        out = [(ids[j], label) for j, label in zip(seen.tolist(), self.birth[tracks], strict=True)]
        labels = np.array([f"{frame}-{ids[j]}" for j in born.tolist()], object)
        out += [(ids[j], label) for j, label in zip(born.tolist(), labels, strict=True)]
        new = {"kind": kind[born], "missed": np.zeros(len(born), np.int64), "birth": labels, "x": measured[born], "v": np.zeros((len(born), 4)), "p": np.tile([100.0, 0.0, 0.0, 100.0], (len(born), 1))}
        for name, rows in new.items():
            setattr(self, name, np.concatenate((getattr(self, name), rows)))
        return out


def _associated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (video_id, class_name, stretch, frame_number, detection_id, confidence, x, y, width, height) in the order of these columns, frame after frame."""
    key, live, held = None, Association(), []

    def frame_done() -> list[tuple]:
        ids = [x for part in held for x in part[0]]
        confidence, boxes = (np.concatenate([part[n] for part in held]) for n in (1, 2))
        last = [n for n in range(len(ids)) if n + 1 == len(ids) or ids[n] != ids[n + 1]]  # of rows that repeat an id the last counts
        video, name, _, frame = key
        return [(video, d, f"{video}-{label}", frame) for d, label in live.advance(frame, [ids[n] for n in last], [name] * len(last), confidence[last], boxes[last])]

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["video_id", "detection_id", "track_id", "frame_number"])

    for batch in batches:
        keys = list(zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True))
        ids, confidence = batch.column(4).to_pylist(), batch.column(5).to_numpy(zero_copy_only=False)
        boxes = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in range(6, 10)]).astype(float)
        starts, out = [n for n in range(len(keys)) if not n or keys[n] != keys[n - 1]], []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and keys[a] != key:
                out += frame_done()
                held = []
            if key is None or keys[a][:3] != key[:3]:
                live = Association()
            key = keys[a]
            held.append((ids[a:b], confidence[a:b], boxes[a:b]))
        yield table(out)
    if held:
        yield table(frame_done())


def associate_tracks(detections: DataFrame) -> DataFrame:
    """(video_id, detection_id, track_id, frame_number): detections of a video joined into tracks, frame after frame.

    Confident detections are matched to predicted boxes first, then less confident ones to
    what is left; tracks start from confident detections and end after MAX_MISSED frames
    without any. Tracks of one class never meet another's, and a track is named by the frame and
    detection that it began with; so each class of a video is associated by itself, and is cut
    where it has no detection for longer than MAX_MISSED frames, which ends all its tracks. These
    stretches are dealt to tasks; within one, detections stream past the live tracks, so no task
    holds more than these and a frame. Detections without video, frame, confidence or box
    take no part (a null class is one); of rows that repeat a detection_id in a frame and class one counts.
    """
    d = detections.where("video_id IS NOT NULL AND frame_number IS NOT NULL AND confidence IS NOT NULL AND bbox IS NOT NULL")
    box = [F.col("bbox")[c].cast("double").alias(c) for c in ("x", "y", "width", "height")]
    d = d.select(F.col("video_id").cast("long"), "class_name", F.col("frame_number").cast("long"), F.col("detection_id").cast("long"), F.col("confidence").cast("double"), *box)
    w = Window.partitionBy("video_id", "class_name").orderBy("frame_number")
    cuts = d.select("video_id", "class_name", "frame_number").distinct().withColumn("stretch", islands(F.coalesce(F.col("frame_number") - F.lag("frame_number").over(w) > MAX_MISSED, F.lit(False)), w))
    cuts = cuts.toDF("_video", "_class", "_frame", "stretch")
    rows = d.join(cuts, (F.col("video_id") == F.col("_video")) & F.col("class_name").eqNullSafe(F.col("_class")) & (F.col("frame_number") == F.col("_frame")))
    order = ["video_id", "class_name", "stretch", "frame_number", "detection_id", "confidence", "x", "y", "width", "height"]
    rows = rows.select(*order).repartition("video_id", "class_name", "stretch").sortWithinPartitions(*order)
    return rows.mapInArrow(_associated, "video_id long, detection_id long, track_id string, frame_number long")
