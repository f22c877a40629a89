"""Scoring predictions against ground truth, and audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelake.functions.alignment import edit_counts
from tracelake.functions.exprs import area, iou, tiou, wilson, x2, y2
from tracelake.functions.matching import greedy, greedy_classes, optimal, optimal_classes, pieces
from tracelake.functions.ordered import islands, range_join
from tracelake.functions.shared import components, held, let_go

MAX_DT, MIN_IOU, MIN_TIOU = 0.1, 0.5, 0.5
#: Metrics that are hits of trials, so that an interval can be given.
PROPORTIONS = ("detection_precision", "detection_recall", "event_precision", "event_recall", "qa_abstention_accuracy")


def detection_pairs(gt: DataFrame, pred: DataFrame, max_dt: float = MAX_DT, min_iou: float = MIN_IOU) -> DataFrame:
    """(video_id, class, g_id, p_id, t, t_end, weight): boxes of one class at most max_dt apart that overlap enough.

    gt, pred: video_id, id, t, class_name, bbox. Corners and areas are columns of each side, so that
    the join's generated code stays small enough to be compiled. Buckets are twice max_dt long, and the join is dealt over
    all tasks, as its pairs are many more than its rows. A threshold of 0 would admit disjoint boxes and is refused.
    """
    if min_iou <= 0:
        raise ValueError("the threshold must be over 0")

    def side(df: DataFrame, p: str) -> DataFrame:
        b = F.col("bbox")
        corners = {"x": b["x"], "y": b["y"], "x2": x2(b), "y2": y2(b), "area": area(b)}
        return df.where((b["width"] > 0) & (b["height"] > 0)).select("video_id", F.lower("class_name").alias("class"), F.col("id").alias(f"{p}_id"), F.col("t").alias(f"{p}_t"), F.col("t").alias(f"{p}_e"), *(c.alias(f"{p}_{n}") for n, c in corners.items()))

    both = range_join(side(gt, "g"), side(pred, "p").hint("merge"), ["video_id", "class"], ("g_t", "g_e"), ("p_t", "p_e"), max_dt, bucket=2 * max_dt or 1.0)
    both = both.withColumn("w", F.least("g_x2", "p_x2") - F.greatest("g_x", "p_x")).withColumn("h", F.least("g_y2", "p_y2") - F.greatest("g_y", "p_y")).where("w > 0 AND h > 0")
    weight = F.col("w") * F.col("h") / (F.col("g_area") + F.col("p_area") - F.col("w") * F.col("h"))
    return both.select("video_id", "class", "g_id", "p_id", F.least("g_t", "p_t").alias("t"), F.greatest("g_t", "p_t").alias("t_end"), weight.alias("weight")).where(F.col("weight") >= min_iou)


def event_pairs(gt: DataFrame, pred: DataFrame, min_tiou: float = MIN_TIOU) -> DataFrame:
    """The same for intervals of one event type. A threshold of 0 would admit disjoint pairs and is refused."""
    if min_tiou <= 0:
        raise ValueError("the threshold must be over 0")
    side = lambda df, p: df.select("video_id", F.col("event_type").alias("class"), F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_s"), F.col("end").alias(f"{p}_e"))
    both = range_join(side(gt, "g"), side(pred, "p"), ["video_id", "class"], ("g_s", "g_e"), ("p_s", "p_e"))
    return both.withColumn("weight", tiou(F.col("g_s"), F.col("g_e"), F.col("p_s"), F.col("p_e"))).where(F.col("weight") >= min_tiou).select("video_id", "class", "g_id", "p_id", F.least("g_s", "p_s").alias("t"), F.greatest("g_e", "p_e").alias("t_end"), "weight")


#: Pairs of one video and class that reach each other through time, of which more are first cut into connected pieces; seconds of a bucket of time.
MAX_STRETCH, BUCKET = 20_000, 10.0


def _stretches(pairs: DataFrame) -> DataFrame:
    """pairs with `piece`: a video and class is cut where no pair reaches over a bucket's start. Only buckets are ordered, not pairs."""
    keys, b = ["video_id", "class"], F.floor(F.col("t") / BUCKET).alias("_b")
    w = Window.partitionBy(*keys).orderBy("_b")
    buckets = pairs.groupBy(*keys, b).agg(F.max("t_end").alias("_e"))
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.withColumn("piece", islands(F.coalesce(F.col("_b") * BUCKET > reach, F.lit(True)), w)).drop("_e")
    return pairs.withColumn("_b", b).join(buckets, [*keys, "_b"]).drop("_b")


def _connected(pairs: DataFrame) -> DataFrame:
    """pairs with `piece`: the number of their connected piece, whatever time says. A hash that two ends share joins pieces, which changes no result."""
    end = lambda side: F.xxhash64(F.lit(side), "video_id", "class", f"{side}_id")
    ends = pairs.withColumn("_g", end("g"))
    found = components(ends.select(F.col("_g").alias("a"), end("p").alias("b"))).toDF("_g", "piece")
    return ends.join(found, "_g").drop("_g")


def _alike(df: DataFrame) -> DataFrame:
    """df's boxes with `rep`, the smallest id of those equal in video, class, time and box, and `n`, how many these are.

    A row whose id comes more than once in its video and class stands for itself. What overlaps nothing is left out.
    """
    b = F.col("bbox")
    rows = df.where((b["width"] > 0) & (b["height"] > 0) & F.col("t").isNotNull()).select("video_id", F.lower("class_name").alias("class_name"), "id", "t", "bbox")
    again = F.count("*").over(Window.partitionBy("video_id", "class_name", "id")) > 1
    w = Window.partitionBy("video_id", "class_name", "t", *(b[c] for c in ("x", "y", "width", "height")), "_again")
    rows = rows.withColumn("_again", F.when(again, F.col("id")))
    return held(rows.select("video_id", "class_name", "id", "t", "bbox", F.min("id").over(w).alias("rep"), F.when(F.col("_again").isNull(), F.count("*").over(w)).otherwise(1).alias("n")))


def match_detections(gt: DataFrame, pred: DataFrame, strategy: str = "greedy", max_dt: float = MAX_DT, min_iou: float = MIN_IOU) -> DataFrame:
    """match_pairs of detection_pairs, without making all pairs: boxes equal in video, class, time and box are matched as one with its members.

    Greedy takes the very same pairs; the optimal strategy as many of the same weight, and where boxes are equal it may be others of them.
    """
    sides = [_alike(gt), _alike(pred)]
    pairs = detection_pairs(*(s.where("id = rep").drop("rep", "n") for s in sides), max_dt, min_iou)
    return match_pairs(pairs, strategy, [s.where("n > 1").select("video_id", F.col("class_name").alias("class"), F.col("rep").alias(f"{p}_id"), F.col("id").alias("member")) for s, p in zip(sides, "gp", strict=True)])


def match_pairs(pairs: DataFrame, strategy: str = "greedy", members: list[DataFrame] | None = None) -> DataFrame:
    """One-to-one matches of candidate pairs, `greedy` (by falling weight, ties by ids) or `optimal` (most pairs, then most weight).

    Pairs are tables in the shared folder. A video and class is cut where time leaves none
    open; where one stretch has over MAX_STRETCH pairs, the pieces are the pair graph's connected
    ones instead. Pieces are dealt by hash and stream through their task one after the other:
    a pair without rivals passes as it is, the others are split into connected pieces and
    solved; so only one connected piece must fit a task. Repeated pairs count once, the heaviest; no
    pairs give no rows.

    members: for the left and the right side (video_id, class, g_id or p_id, member), the ends that an id of
    a pair stands for, itself included; one without rows stands for itself alone. Matches are between members.
    """
    if strategy not in ("greedy", "optimal"):
        raise ValueError(f"unknown strategy {strategy}")
    choose, choose_members = (optimal, optimal_classes) if strategy == "optimal" else (greedy, greedy_classes)
    names = ["video_id", "class", "g_id", "p_id", "t", "t_end", "weight"]
    found = held(pairs.select(*names))
    cut = held(_stretches(found))
    let_go(found)
    most = cut.groupBy("video_id", "class", "piece").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cut = cut if most <= MAX_STRETCH else _connected(cut.drop("piece")).select(*cut.columns)

    def solved(rows: pa.Table) -> list[tuple]:
        """(place, left end, right end) of the matches of whole pieces that have rivals in them."""
        groups: dict[tuple, tuple[dict, dict, dict]] = {}
        for i, (*key, g, p, w, m) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("_piece", "video_id", "class", "g_id", "p_id", "weight", "_member")), strict=True)):
            found, left, right = groups.setdefault(tuple(key), ({}, {}, {}))
            if m is not None:
                left.setdefault(g, []).append(m) if p is None else right.setdefault(p, []).append(m)
            elif (g, p) not in found or w > found[g, p][0]:
                found[g, p] = (w, i)
        out = []
        for found, left, right in groups.values():
            weights = {pair: w for pair, (w, _) in found.items()}
            parts: dict[int, dict] = {}
            for (pair, x), n in zip(weights.items(), pieces(weights), strict=True):
                parts.setdefault(n, {})[pair] = x
            for part in parts.values():
                if any(g in left or p in right for g, p in part):
                    ends = [{x: sorted(side.get(x, [x])) for x in {pair[n] for pair in part}} for n, side in enumerate((left, right))]
                    out += [(found[g, p][1], a, b) for g, p, a, b in choose_members(part, *ends)]
                else:
                    out += [(found[g, p][1], g, p) for g, p in choose(part)]
        return sorted(out, key=lambda x: x[0])

    def kept(held_back: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The matches of whole pieces; a row that is a piece of its own needs no solver."""
        table = pa.Table.from_batches(held_back).combine_chunks()
        piece = table.column("_piece").to_numpy()
        first = np.concatenate(([True], piece[1:] != piece[:-1]))
        alone = first & np.concatenate((first[1:], [True]))
        yield from table.filter(alone).select(names).to_batches()
        many = table.filter(~alone)
        places, *ends = zip(*solved(many), strict=True) if len(many) else ((), (), ())
        rows = many.take(pa.array(places, pa.int64())).select(names)
        for name, values in zip(("g_id", "p_id"), ends, strict=True):
            rows = rows.set_column(names.index(name), rows.schema.field(name), pa.array(values, rows.schema.field(name).type))
        yield from rows.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back: list[pa.RecordBatch] = []
        for batch in batches:
            piece = batch.column(0).to_numpy()
            # the last piece of a batch may go on in the next one
            start = int(np.searchsorted(piece, piece[-1])) if len(piece) else 0
            if start or (back and len(piece) and back[-1].column(0)[-1].as_py() != piece[0]):
                yield from kept([*back, batch.slice(0, start)])
                back = []
            back.append(batch.slice(start))
        if sum(map(len, back)):
            yield from kept(back)

    place = F.xxhash64("video_id", "class", "piece").alias("_piece")
    rows = cut.select(place, *names, F.lit(None).cast(cut.schema["g_id"].dataType).alias("_member"))
    for side, df in zip(("g_id", "p_id"), members or [], strict=False):
        of = df.join(cut.select("video_id", "class", side, "piece").distinct(), ["video_id", "class", side])
        none = lambda n: F.lit(None).cast(cut.schema[n].dataType).alias(n)
        rows = rows.unionByName(of.select(place, "video_id", "class", *(F.col(n) if n == side else none(n) for n in names[2:]), F.col("member").alias("_member")))
    dealt = rows.repartition("_piece").sortWithinPartitions("_piece")
    return dealt.mapInArrow(run, cut.select(*names).schema)


def prf(matches: DataFrame, gt: DataFrame, pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """TP, FP, FN, precision, recall, F1 and Wilson intervals by keys; null where nothing can be divided by."""
    keys = keys or ["video_id"]
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    c = n(gt, "n_gt").join(n(pred, "n_pred"), keys, "full").join(n(matches, "tp"), keys, "left").fillna(0, ["n_gt", "n_pred", "tp"])
    p, r = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")), F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt"))
    f1 = F.when(F.col("n_gt") + F.col("n_pred") > 0, 2 * F.col("tp") / (F.col("n_gt") + F.col("n_pred")))
    return c.select(*keys, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), wilson(F.col("tp"), F.col("n_pred")).alias("precision_ci"), wilson(F.col("tp"), F.col("n_gt")).alias("recall_ci"))


def boundary_error(matches: DataFrame, gt: DataFrame, pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per keys: matched events and the mean of their errors in seconds, each the mean of that at start and end, 4 decimals. gt, pred: id, start, end (null: the start)."""
    keys = keys or ["video_id"]
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_s"), F.coalesce("end", "start").alias(f"{p}_e"))
    j = matches.select(*keys, "g_id", "p_id").join(side(gt, "g"), "g_id").join(side(pred, "p"), "p_id")
    error = (F.abs(F.col("g_s") - F.col("p_s")) + F.abs(F.col("g_e") - F.col("p_e"))) / 2
    return j.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(error), 4).alias("mean_boundary_error"))


_EDITS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions")])


@F.pandas_udf(_EDITS)
def _edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Edits between two texts by code points, or two arrays by elements."""
    as_is = lambda s: s if isinstance(s, str) else list(s)
    return pd.DataFrame([edit_counts(as_is(a), as_is(b)) for a, b in zip(ref, hyp, strict=True)], columns=["substitutions", "deletions", "insertions"])


def error_rates(df: DataFrame, ref: str = "ref", hyp: str = "hyp", unit: str = "char") -> DataFrame:
    """df with n_ref, edits by kind and error_rate by characters or words; an empty reference has rate 0 or 1, null is empty.

    Memory is that of the two texts and KEPT_BYTES of alignment.py, however long they are.
    """
    cut, size = (lambda c: c, F.length) if unit == "char" else ((lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")), F.size)
    rows = df.withColumn("_r", cut(F.coalesce(ref, F.lit("")))).withColumn("_h", cut(F.coalesce(hyp, F.lit(""))))
    rows = rows.withColumn("_e", _edits("_r", "_h")).withColumn("n_ref", size("_r")).withColumn("_n", size("_h"))
    total = F.col("_e.substitutions") + F.col("_e.deletions") + F.col("_e.insertions")
    return rows.select(*df.columns, "n_ref", "_e.substitutions", "_e.deletions", "_e.insertions", F.when(F.col("n_ref") > 0, total / F.col("n_ref")).otherwise(F.when(F.col("_n") > 0, 1.0).otherwise(0.0)).alias("error_rate"))


def qa_abstention(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Confusion of abstaining (positive: unanswerable), accuracy, precision, recall and F1; questions without a prediction are counted apart.

    gt: qa_id, is_answerable; pred: qa_id, did_abstain and, where a question has several
    predictions, position, of which the last counts. Wilson intervals end in _ci and are null for no trials.
    """
    if "position" in pred.columns:
        pred = pred.groupBy("qa_id").agg(F.max_by("did_abstain", "position").alias("did_abstain"))
    j = gt.join(pred.select("qa_id", "did_abstain"), "qa_id", "left")
    c = j.agg(*(F.count_if(x).alias(n) for n, x in (("tp", ~F.col("is_answerable") & F.col("did_abstain")), ("fp", F.col("is_answerable") & F.col("did_abstain")), ("fn", ~F.col("is_answerable") & ~F.col("did_abstain")), ("tn", F.col("is_answerable") & ~F.col("did_abstain")), ("missing", F.col("did_abstain").isNull()))))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    div = lambda a, b: F.round(F.when(b > 0, a / b), 4)
    return c.select("*", div(F.col("tp") + F.col("tn"), n).alias("accuracy"), div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), wilson(F.col("tp") + F.col("tn"), n).alias("accuracy_ci"), wilson(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_ci"), wilson(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_ci"))


def reference_integrity(cites: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per video: citations, missing and cross-video ones, and the share that holds."""
    j = cites.join(evidence.select("evidence_id", F.col("video_id").alias("e_video")), "evidence_id", "left")
    c = j.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(F.col("e_video").isNull()).alias("missing"), F.count_if(F.col("e_video") != F.col("video_id")).alias("cross_video"))
    return c.withColumn("rate", F.round(1 - (F.col("missing") + F.col("cross_video")) / F.col("n"), 4))


def metric_status(annotated: DataFrame, predicted: DataFrame) -> DataFrame:
    """Whether a metric can be had, per video and modality. annotated: video_id, modality, status; predicted: video_id, modality, n (null: not predicted)."""
    videos = predicted.select("video_id").distinct().withColumn("_v", F.lit(True))
    j = annotated.join(predicted, ["video_id", "modality"], "left").join(videos, "video_id", "left")
    s = (
        F.when(F.col("status") == "not_applicable", "not_applicable").when(F.col("status") == "not_annotated", "not_annotated").when(F.col("status") == "annotation_incomplete", "annotation_incomplete")
        .when(F.col("_v").isNull(), "missing_video").when(F.col("n").isNull(), "missing_modality").when(F.col("n") == 0, "empty_predictions").otherwise("available")
    )
    return j.select("video_id", "modality", s.alias("metric_status"))


def aggregate_metrics(per_video: DataFrame) -> DataFrame:
    """Micro (from summed counts) and macro (mean of videos) precision, recall and F1 over available rows with tp, fp, fn."""
    a = per_video.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), *(F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), F.count("*").alias("n_videos"))
    div = lambda x, y: F.round(F.when(y > 0, x / y), 4)
    return a.select("*", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("micro_precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("micro_recall"), div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("micro_f1"))


def aggregate_rates(per_video: DataFrame, proportions: tuple[str, ...] = PROPORTIONS) -> DataFrame:
    """Micro and macro value of each metric over its available rows, with a Wilson interval where the metric is a share of trials.

    per_video: video_id, metric, status, part, whole, value; a rate is part of whole (edits of reference
    length, right decisions of all, twice the hits of 2 tp + fp + fn), value the video's own.
    micro is the sum of parts by the sum of wholes, 0 without any; macro the mean of the values that are
    not null, 0 without any. sample_size: sum of wholes; n_videos, n_values: available rows, and those
    with a value. A metric without an available row has none. Null parts and wholes count 0.
    """
    a = per_video.where("status = 'available'").groupBy("metric").agg(
        F.coalesce(F.sum("part"), F.lit(0)).alias("_part"), F.coalesce(F.sum("whole"), F.lit(0)).alias("sample_size"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("_mean"), F.count("*").alias("n_videos"), F.count("value").alias("n_values"),
    )
    some = F.col("sample_size") > 0
    bounds = wilson(F.col("_part"), F.col("sample_size"))
    share = some & F.col("metric").isin(*proportions)
    return a.select(
        "metric", F.round(F.when(some, F.col("_part") / F.col("sample_size")).otherwise(0.0), 4).alias("micro"), F.round("_mean", 4).alias("macro"), "sample_size", "n_videos", "n_values",
        F.when(share, bounds["low"]).alias("low"), F.when(share, bounds["high"]).alias("high"),
    )


def _issues(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())).alias("issue"))


def lint_annotations(boxes: DataFrame, frames: DataFrame, classes: list[str], max_iou: float = 0.85, slack: float = 0.05) -> DataFrame:
    """(video_id, id, issue) of annotated boxes (video_id, id, frame_number, t, class_name, bbox) on sampled frames (video_id, frame_number, pts, width, height, is_negative)."""
    j = boxes.join(frames, ["video_id", "frame_number"], "left")
    b = F.col("bbox")
    rules = {
        "unknown_frame": F.col("pts").isNull(), "timestamp_mismatch": F.abs(F.col("t") - F.col("pts")) > slack, "unknown_class": ~F.col("class_name").isin(classes), "empty_box": (b["width"] <= 0) | (b["height"] <= 0),
        "box_outside": (b["x"] < 0) | (b["y"] < 0) | (b["x"] + b["width"] > F.col("width")) | (b["y"] + b["height"] > F.col("height")), "box_on_negative_frame": F.col("is_negative"),
    }
    found = _issues(j, ["video_id", "id"], rules)
    d = boxes.select("video_id", "frame_number", "class_name", "id", "bbox")
    twice = d.toDF("video_id", "frame_number", "class_name", "id", "b1").join(d.toDF("video_id", "frame_number", "class_name", "id2", "b2"), ["video_id", "frame_number", "class_name"]).where("id < id2").where(iou(F.col("b1"), F.col("b2")) > max_iou).select("video_id", "id", F.lit("duplicate_box").alias("issue"))
    bare = frames.where("NOT is_negative").join(boxes.select("video_id", "frame_number").distinct(), ["video_id", "frame_number"], "left_anti").select("video_id", F.col("frame_number").cast("long").alias("id"), F.lit("missing_frame").alias("issue"))
    return reduce(DataFrame.unionByName, (found, twice, bare.withColumn("id", F.col("id").cast(found.schema["id"].dataType))))


def lint_corpus(found: DataFrame, clips: DataFrame, frames: DataFrame, boxes: DataFrame, slack: float = 0.01) -> DataFrame:
    """(video_id, issue) of many annotated clips: sizes, rates and frame counts that differ from the clip's, unknown clips, boxes on negative frames.

    found, clips: video_id, width, height, fps, n_frames, as annotated and as they are; frames:
    video_id, frame_number, is_negative; boxes: video_id, frame_number. Each issue once a
    clip; a clip without annotation has none, and a null on either side is no difference.
    """
    c = clips.select("video_id", *(F.col(n).alias(f"_{n}") for n in ("width", "height", "fps", "n_frames")), F.lit(True).alias("_known"))
    rules = {
        "unknown_clip": F.col("_known").isNull(), "size_mismatch": (F.col("width") != F.col("_width")) | (F.col("height") != F.col("_height")),
        "fps_mismatch": F.abs(F.col("fps") - F.col("_fps")) > slack, "frame_count_mismatch": F.col("n_frames") != F.col("_n_frames"),
    }
    plain = _issues(found.join(c, "video_id", "left"), ["video_id"], rules)
    full = boxes.join(frames.where("is_negative").select("video_id", "frame_number"), ["video_id", "frame_number"], "left_semi").select("video_id", F.lit("negative_frame_not_empty").alias("issue"))
    return plain.unionByName(full).distinct()


def latency_stats(df: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Mean, median, linear 95th percentile, extremes, sample deviation (0 for one) and throughput a second, 2 decimals."""
    v = F.col(value)
    r = lambda c, n: F.round(c, 2).alias(n)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), r(F.avg(v), "mean"), r(F.percentile(v, 0.5), "median"), r(F.percentile(v, 0.95), "p95"), r(F.min(v), "min"), r(F.max(v), "max"), r(F.coalesce(F.stddev_samp(v), F.lit(0.0)), "stdev"), r(1000 * F.count("*") / F.sum(v), "throughput"))


def audit_run(events: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(issue, id): events without evidence or with ungrounded ids or bad times, candidates of unknown events or with scores outside [0, 1]."""
    known = evidence.select("evidence_id").distinct()
    e = _issues(events, ["event_id"], {"no_evidence": F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0, "negative_time": F.col("start") < 0, "end_before_start": F.col("end") < F.col("start")}).select("issue", F.col("event_id").cast("string").alias("id"))
    ungrounded = events.select("event_id", F.explode("evidence_ids").alias("evidence_id")).join(known, "evidence_id", "left_anti").select(F.lit("ungrounded_evidence").alias("issue"), F.col("event_id").cast("string").alias("id"))
    lost = candidates.select("candidate_id", F.explode("source_event_ids").alias("event_id")).join(events.select("event_id").distinct(), "event_id", "left_anti").select(F.lit("unknown_event").alias("issue"), F.col("candidate_id").cast("string").alias("id"))
    wild = candidates.where("saliency_score < 0 OR saliency_score > 1").select(F.lit("score_range").alias("issue"), F.col("candidate_id").cast("string").alias("id"))
    return reduce(DataFrame.unionByName, (e, ungrounded, lost, wild))


#: Citations of one partition where they meet what they cite.
CITED_ROWS = 400_000


def audit_references(events: DataFrame, citations: DataFrame, tracks: DataFrame, texts: DataFrame, segments: DataFrame) -> DataFrame:
    """(issue, id) of a run's timelines: events out of order, and citations of unknown tracks, texts and segments or at negative times.

    events: video_id, event_id, position, start; one that starts before the one ahead of it in its
    video, by position, is non_monotonic, and the first of a video is where it starts below -1.
    citations: event_id, track_id, observation_id, segment_id, timestamp_seconds, of which any may
    be null; each gives its own issues. id is the event's, as text. Many citations are dealt to as many
    partitions as their rows need, so no task holds more of them with more rows.
    """
    n = -(-citations.count() // CITED_ROWS)
    many = n > citations.sparkSession.sparkContext.defaultParallelism
    w = Window.partitionBy("video_id").orderBy("position", "event_id")
    broken = events.withColumn("_ahead", F.coalesce(F.lag("start").over(w), F.lit(-1.0))).where("start < _ahead").select(F.lit("non_monotonic").alias("issue"), F.col("event_id").cast("string").alias("id"))
    early = citations.where("timestamp_seconds < 0").select(F.lit("negative_evidence_time").alias("issue"), F.col("event_id").cast("string").alias("id"))
    out = broken.unionByName(early)
    for issue, key, known in (("ungrounded_track", "track_id", tracks), ("ungrounded_text", "observation_id", texts), ("ungrounded_segment", "segment_id", segments)):
        cited = citations.where(F.col(key).isNotNull()).select("event_id", key)
        lost = (cited.repartition(n, key) if many else cited).join(known.select(key).distinct(), key, "left_anti")
        out = out.unionByName(lost.select(F.lit(issue).alias("issue"), F.col("event_id").cast("string").alias("id")))
    return out


def corpus_report(**tables: DataFrame) -> DataFrame:
    """Rows of each table by video; 0 where a video has none."""
    rows = reduce(DataFrame.unionByName, (df.groupBy("video_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, df in tables.items()))
    return rows.groupBy("video_id").pivot("what", list(tables)).agg(F.sum("n")).fillna(0)
