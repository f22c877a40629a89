"""Streaming forms of operators that are fed row by row."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelake.operators.events import MIN_SPEED, ZONE_GAP
from tracelake.operators.fusion import FRAME_GAP, compatible
from tracelake.operators.ranking import BUDGET_SECONDS, MAX_REQUESTS, MAX_TOKENS
from tracelake.operators.tracks import Association
from tracelake.sources.versions import VersionedTable


def _mode(idle_ms: int | None) -> str:
    """Timers and a time to live need processing time, in which a query runs on until it is stopped, even with an availableNow trigger."""
    return "None" if idle_ms is None else "ProcessingTime"


def stream_clusters(events: DataFrame, gap: str = "2500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Clusters of point events (video_id, event_time) that lie at most gap apart, closed when the watermark has passed them."""
    return events.withWatermark("event_time", late).groupBy("video_id", F.session_window("event_time", gap)).agg(F.count("*").alias("n_events")).select("video_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def stream_duplicates(candidates: DataFrame, late: str = "60 seconds") -> DataFrame:
    """Candidates (signature, event_time) without those whose signature came within the watermark."""
    return candidates.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["signature"])


class _Motion(StatefulProcessor):
    """Last point and whether it moved, of one track."""

    columns = ("pts", "x", "y")

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "pts double, x double, y double, moving boolean", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("pts").itertuples(index=False):
            if state is None:
                state = (row.pts, row.x, row.y, None)
                continue
            pts, x, y, was = state
            if row.pts < pts:  # behind what an earlier trigger has settled
                continue
            moving = bool(((row.x - x) ** 2 + (row.y - y) ** 2) ** 0.5 / max(row.pts - pts, 0.001) >= MIN_SPEED)
            if was is not None and moving != was:
                out.append((*key, "started_moving" if moving else "stopped_moving", row.pts))
            state = (row.pts, row.x, row.y, moving)
        self.last.update(tuple(state))
        yield pd.DataFrame(out, columns=["video_id", "track_id", "event_type", "start"])

    def flush(self, key) -> pd.DataFrame:
        self.last.clear()
        return pd.DataFrame([], columns=["video_id", "track_id", "event_type", "start"])

    def close(self) -> None:
        pass


class _Zone(StatefulProcessor):
    """Whether a track is inside, since when, and its last transition."""

    columns = ("pts", "inside")

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("zone", "inside boolean, last double, entered double", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        inside, last, entered = self.state.get() if self.state.exists() else (False, -1.0, -1.0)
        out = []
        for row in pd.concat(list(rows)).sort_values("pts").itertuples(index=False):
            if bool(row.inside) == inside or row.pts - last < ZONE_GAP:
                continue
            out.append((*key, "zone_entered" if row.inside else "zone_exited", row.pts, None if row.inside else row.pts - entered))
            inside, last, entered = bool(row.inside), row.pts, row.pts if row.inside else entered
        self.state.update((inside, last, entered))
        yield pd.DataFrame(out, columns=["zone_id", "video_id", "track_id", "event_type", "start", "dwell"])

    def flush(self, key) -> pd.DataFrame:
        self.state.clear()
        return pd.DataFrame([], columns=["zone_id", "video_id", "track_id", "event_type", "start", "dwell"])

    def close(self) -> None:
        pass


class _Budget(StatefulProcessor):
    """Times and tokens of the requests admitted in the last BUDGET_SECONDS of one budget."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "t double, tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()) if self.held.exists() else []
        out = []
        for row in pd.concat(list(rows)).sort_values(["t", "request_id"]).itertuples(index=False):
            held = [(t, n) for t, n in held if row.t - t < BUDGET_SECONDS]
            ok = len(held) + 1 <= MAX_REQUESTS and sum(n for _, n in held) + row.tokens <= MAX_TOKENS
            if ok:
                held.append((float(row.t), int(row.tokens)))
            out.append((*key, row.request_id, ok))
        self.held.put(held) if held else self.held.clear()
        yield pd.DataFrame(out, columns=["budget_key", "request_id", "admitted"])

    def close(self) -> None:
        pass


class _Texts(StatefulProcessor):
    """Open sightings of one text in a video: first and last frame, last box, rows and best confidence; a timer closes what is left."""

    columns = ("observation_id", "frame_number", "x", "y", "width", "height", "confidence")

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, x double, y double, width double, height double, n long, confidence double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [tuple(c) for c in self.open.get()] if self.open.exists() else []
        out = []
        for row in pd.concat(list(rows)).sort_values(["frame_number", "observation_id"]).itertuples(index=False):
            out += [(*key, *c[:2], *c[6:]) for c in held if row.frame_number - c[1] > FRAME_GAP]
            held = [c for c in held if row.frame_number - c[1] <= FRAME_GAP]
            box = {"x": row.x, "y": row.y, "width": row.width, "height": row.height}
            fits = [(fit, -i) for i, c in enumerate(held) if (fit := compatible(dict(zip(box, c[2:6], strict=True)), box)) is not None]
            new = (int(row.frame_number), int(row.frame_number), *map(float, box.values()), 1, float(row.confidence))
            if fits:
                i = -max(fits)[1]
                held[i] = (min(held[i][0], new[0]), max(held[i][1], new[1]), *new[2:6], held[i][6] + 1, max(held[i][7], new[7]))
            else:
                held.append(new)
        self.open.put(held) if held else self.open.clear()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["video_id", "normalized_text", "first_frame", "last_frame", "n", "confidence"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.flush(key)

    def flush(self, key) -> pd.DataFrame:
        held = [tuple(c) for c in self.open.get()] if self.open.exists() else []
        self.open.clear()
        return pd.DataFrame([(*key, *c[:2], *c[6:]) for c in held], columns=["video_id", "normalized_text", "first_frame", "last_frame", "n", "confidence"])

    def close(self) -> None:
        pass


class _Association(StatefulProcessor):
    """The live tracks of one video."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracks", "live binary", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        live = pickle.loads(self.state.get()[0]) if self.state.exists() else Association()
        out = []
        for frame, part in pd.concat(list(rows)).sort_values(["frame_number", "detection_id"]).groupby("frame_number", sort=True):
            if live.last is not None and frame <= live.last:  # behind what an earlier trigger has settled
                continue
            seen = [{"detection_id": r.detection_id, "class_name": r.class_name, "confidence": r.confidence, "bbox": {"x": r.x, "y": r.y, "width": r.width, "height": r.height}} for r in part.itertuples(index=False)]
            out += [(*key, detection, f"{key[0]}-{label}", int(frame)) for detection, label in live.step(int(frame), seen)]
        self.state.update((pickle.dumps(live),))
        yield pd.DataFrame(out, columns=["video_id", "detection_id", "track_id", "frame_number"])

    def close(self) -> None:
        pass


class _InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them and hands them to another processor in the order of their event time.

    After idle_ms of event time without rows the other processor's flush() gives out what is open and its state goes.
    """

    def __init__(self, inner: StatefulProcessor, schema: str, idle_ms: int | None) -> None:
        self.inner, self.schema, self.idle_ms = inner, schema, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)
        self.handle = handle
        self.names = [c.strip().split(" ")[0] for c in self.schema.split(",")]
        self.waiting = handle.getListState("waiting", self.schema)
        self.settled = handle.getValueState("settled", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["at_ms"] > timers.getCurrentWatermarkInMs()]  # null and late rows go
        if len(new):
            new = new[self.names].astype({"at_ms": "int64"}).astype(object)
            self.waiting.appendList([tuple(r) for r in new.where(new.notna(), None).itertuples(index=False)])
            self.handle.registerTimer(int(new["at_ms"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        at = self.names.index("at_ms")
        ready, later = [r for r in held if r[at] <= passed], [r for r in held if r[at] > passed]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
            ready.sort(key=lambda r: r[at])
            newest = ready[-1][at]
            for first, last in self._stretches([r[at] for r in ready]):
                yield from self.inner.handleInputRows(key, iter([pd.DataFrame(ready[first:last], columns=self.names)]), timerValues)
                if last < len(ready):
                    yield self.inner.flush(key)
            self.settled.update((newest,))
        if later:
            self.handle.registerTimer(min(r[at] for r in later))
        if self.idle_ms is None or not self.settled.exists():
            return
        due = self.settled.get()[0] + self.idle_ms
        if due > passed:
            self.handle.registerTimer(due)
        elif not any(r[at] <= due for r in later):
            self.settled.clear()
            yield self.inner.flush(key)

    def _stretches(self, times: list[int]) -> list[tuple[int, int]]:
        """Ranges of sorted times that no pause of over idle_ms parts; the first one also ends where the last settled row is that far back."""
        cuts = [] if self.idle_ms is None else [i for i in range(1, len(times)) if times[i] - times[i - 1] > self.idle_ms]
        if self.idle_ms is not None and self.settled.exists() and times[0] - self.settled.get()[0] > self.idle_ms:
            cuts = [0, *cuts]
        return list(zip([0, *cuts], [*cuts, len(times)], strict=True))

    def close(self) -> None:
        self.inner.close()


def _run(df: DataFrame, keys: list[str], processor, schema: str, idle_ms: int | None, event_time: str | None, late: str) -> DataFrame:
    """df through a processor: rows as triggers bring them, or with an event_time column in its order behind a watermark."""
    if event_time is None:
        return df.groupBy(*keys).transformWithStateInPandas(processor(idle_ms), schema, "Append", _mode(idle_ms))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in processor.columns)
    rows = df.withWatermark(event_time, late).select(*keys, *processor.columns, event_time, F.unix_millis(F.col(event_time).cast("timestamp")).alias("at_ms"))
    return rows.groupBy(*keys).transformWithStateInPandas(_InOrder(processor(None), f"{kinds}, at_ms long", idle_ms), schema, "Append", "EventTime")


def stream_tracks(detections: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(video_id, detection_id, track_id, frame_number), as associate_tracks, for a stream of detections.

    detections: video_id, detection_id, frame_number, class_name, confidence, x, y, width,
    height, without nulls. A frame comes whole in one trigger; rows of frames at or before
    the last one of an earlier trigger are late and dropped. State holds live tracks
    only; that of a video without rows for idle_ms is dropped.
    """
    return detections.groupBy("video_id").transformWithStateInPandas(_Association(idle_ms), "video_id long, detection_id long, track_id string, frame_number long", "Append", _mode(idle_ms))


def stream_admit(requests: DataFrame) -> DataFrame:
    """(budget_key, request_id, admitted) for a stream of requests (budget_key string, request_id long, t, tokens)."""
    return requests.groupBy("budget_key").transformWithStateInPandas(_Budget(), "budget_key string, request_id long, admitted boolean", "Append", "None")


def stream_text_fusion(ocr: DataFrame, idle_ms: int | None = None, event_time: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Sightings of texts, given out when the text has a row over FRAME_GAP frames after them, or no row for idle_ms (None: what is open stays in state).

    ocr: video_id, normalized_text, observation_id, frame_number, x, y, width, height, confidence.
    With an event_time column, which rises with frame_number, rows may come in any order within `late`,
    later ones and those without a time are dropped, idle_ms counts event time, and so the data close what
    is open: the query ends with an availableNow trigger, and rows at its watermark's side of the end stay in state.
    """
    return _run(ocr, ["video_id", "normalized_text"], _Texts, "video_id long, normalized_text string, first_frame long, last_frame long, n long, confidence double", idle_ms, event_time, late)


def stream_motion_events(points: DataFrame, idle_ms: int | None = None, event_time: str | None = None, late: str = "10 seconds") -> DataFrame:
    """started and stopped moving from a stream of points (video_id, track_id, pts, x, y).

    Rows of a trigger may come in any order; those before the last of an earlier trigger are late and dropped.
    State of a track without rows for idle_ms is dropped. event_time and late as in stream_text_fusion, rising with pts.
    """
    return _run(points, ["video_id", "track_id"], _Motion, "video_id long, track_id long, event_type string, start double", idle_ms, event_time, late)


def stream_zone_events(points: DataFrame, idle_ms: int | None = None, event_time: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Zone entries and exits from a stream of (zone_id, video_id, track_id, pts, inside); state of a track without rows for idle_ms is dropped.

    Without event_time a row that comes behind a later one of its track, but after the last transition, is taken as it
    comes; event_time and late as in stream_text_fusion, rising with pts, put rows in order first.
    """
    return _run(points, ["zone_id", "video_id", "track_id"], _Zone, "zone_id string, video_id long, track_id long, event_type string, start double, dwell double", idle_ms, event_time, late)


def stream_upsert(batches: DataFrame, path: str, key: str, checkpoint: str, order: str | None = None, table: VersionedTable | None = None):
    """Starts a query that writes each trigger's rows as a version of their keys; readers take the newest version of a key.

    Of a key's rows in one trigger the one of largest `order` counts, ties and no order by the largest row.
    With `table` (of the same path and key) versions are its runs, which are merged as they grow many, and
    its read() takes the place of newest(); without, every version stays and is read.
    """

    def put(df: DataFrame, epoch: int) -> None:
        if table is not None:
            table.put(df, epoch, order)
            return
        names = [c for c in df.columns if c != key]
        newest_first = F.struct(*([order] if order else []), *(c for c in names if c != order))
        df.groupBy(key).agg(F.max_by(F.struct(*names), newest_first).alias("r")).select(key, "r.*").withColumn("_version", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return batches.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The newest version of each key."""
    names = [c for c in rows.columns if c not in (key, "version", "_version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "_version").alias("r")).select(key, "r.*")
