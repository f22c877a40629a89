"""Operators against plain Python that looks at everything: matching, edits, zones, association, text fusion."""

import random
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import alignment, matching, shared, zones
from tracelake.functions import exprs as ex
from tracelake.functions.ordered import thin
from tracelake.operators import evaluation as va
from tracelake.operators import events as ev
from tracelake.operators import fusion as fu
from tracelake.operators import graph as gr
from tracelake.operators import tracks as tr

# ---- matching


def all_matchings(pairs):
    """(pairs, weight) of the best matching, by trying each."""
    left = sorted({g for g, _ in pairs})

    def best(i, used):
        if i == len(left):
            return 0, 0.0
        found = best(i + 1, used)
        for (g, p), w in pairs.items():
            if g == left[i] and p not in used:
                n, x = best(i + 1, used | {p})
                found = max(found, (n + 1, x + w))
        return found

    return best(0, frozenset())


@pytest.mark.parametrize("seed", range(60))
def test_optimal_matching_against_all_matchings(seed):
    rng = random.Random(seed)
    n, m = rng.randrange(1, 6), rng.randrange(1, 6)
    pairs = {(g, p): rng.choice([0.5, 0.6, rng.random()]) for g in range(n) for p in range(m) if rng.random() < 0.6}
    got = matching.optimal(pairs)
    assert len({g for g, _ in got}) == len({p for _, p in got}) == len(got) and all(x in pairs for x in got)
    want = all_matchings(pairs)
    assert len(got) == want[0] and sum(pairs[x] for x in got) == pytest.approx(want[1])


def test_dense_recording_of_ten_thousand_pairs():
    rng = random.Random(1)
    pairs = {(g, p): rng.random() for g in range(100) for p in range(100)}
    got = matching.optimal(pairs)
    assert len(got) == 100 and sum(pairs[x] for x in got) > 97
    chain = {(i, i + d): 0.5 + rng.random() / 2 for i in range(5000) for d in (0, 1)}
    assert len(matching.optimal(chain)) == 5000


@pytest.mark.parametrize("limit", [1, 20_000])
def test_match_pairs_whatever_the_pieces(spark, monkeypatch, limit):
    monkeypatch.setattr(va, "MAX_STRETCH", limit)
    rng = random.Random(limit)
    rows = {}
    for _ in range(160):
        t = rng.choice([0.0, 3.0, 9.0, 11.0, 40.0, 41.0])
        k = int(t) * 10
        rows[(rng.randrange(2), rng.choice("ab"), k + rng.randrange(5), k + rng.randrange(5))] = (t, t + rng.choice([0.0, 1.5]), rng.choice([0.5, 0.75, rng.random()]))
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()] + [(*next(iter(rows)), 0.0, 0.0, 0.1)], "video_id long, class string, g_id long, p_id long, t double, t_end double, weight double")
    by_class = defaultdict(dict)
    for (v, c, g, p), (_, _, w) in rows.items():
        by_class[v, c][g, p] = w
    best = {r: 0 for r in by_class}
    for r in va.match_pairs(df, "optimal").collect():
        best[r["video_id"], r["class"]] += 1 + r["weight"] * 1e-3
    for key, pairs in by_class.items():
        own = matching.optimal(pairs)
        assert best[key] == pytest.approx(len(own) + 1e-3 * sum(pairs[x] for x in own))
    got = {(r["video_id"], r["class"], r["g_id"], r["p_id"]) for r in va.match_pairs(df, "greedy").collect()}
    assert got == {(*key, *x) for key, pairs in by_class.items() for x in matching.greedy(pairs)}
    assert va.match_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        va.match_pairs(df, "best")


def test_components_against_search(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, k) for k in range(201, 220)] + [(7, 7)]
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    got = shared.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == set(want.items()) and len(got) == len(want)


# ---- precision and recall


def test_prf_counts_against_plain_counting(spark):
    gt = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 9)], "video_id long, id long")
    pred = spark.createDataFrame([(1, i) for i in range(4)] + [(3, 1), (3, 2)], "video_id long, id long")
    matches = spark.createDataFrame([(1, 0, 0), (1, 1, 2)], "video_id long, g_id long, p_id long")
    got = {r["video_id"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) for r in va.prf(matches, gt, pred).collect()}
    assert got == {1: (2, 2, 3, 0.5, 0.4, round(4 / 9, 4)), 2: (0, 0, 1, None, 0.0, 0.0), 3: (0, 2, 0, 0.0, None, 0.0)}


# ---- edits


def full_table(a, b):
    """(substitutions, deletions, insertions) on the path back through the whole table."""
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, s, d, n = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            s, i, j = s + (a[i - 1] != b[j - 1]), i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            n, j = n + 1, j - 1
    return s, d, n


@pytest.mark.parametrize("seed", range(40))
def test_edits_against_the_whole_table(monkeypatch, seed):
    rng = random.Random(seed)
    a = [rng.randrange(3) for _ in range(rng.randrange(60))]
    b = [x if rng.random() < 0.7 else rng.randrange(4) for x in a if rng.random() < 0.9] if seed % 2 else [rng.randrange(3) for _ in range(rng.randrange(60))]
    want = full_table(a, b)
    assert alignment.edit_counts(a, b) == want
    # few kept rows, few checkpoints, few units with bits of their own: the same
    monkeypatch.setattr(alignment, "KEPT_BYTES", rng.choice([0, 8, 40]))
    monkeypatch.setattr(alignment, "PARTS", rng.choice([2, 3]))
    monkeypatch.setattr(alignment, "FREQUENT", 1)
    assert alignment.edit_counts(a, b) == want


def test_edits_of_long_texts(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_BYTES", 1 << 20)
    rng = random.Random(1)
    a = [rng.randrange(50) for _ in range(20_000)]
    b = a[:5] + a[6:7000] + a[7001:]
    b[15_000] = 99
    assert alignment.edit_counts(a, b) == (1, 2, 0) and alignment.edit_counts(b, a) == (1, 0, 2)


def test_error_rates_by_code_point_and_word(spark):
    df = spark.createDataFrame([("a𝒳b", "ab"), ("", "x y"), (None, None), ("one  two", "one too")], "ref string, hyp string")
    rows = lambda unit: [(r.n_ref, r.substitutions, r.deletions, r.insertions, round(r.error_rate, 3)) for r in va.error_rates(df, unit=unit).collect()]
    assert rows("char")[:3] == [(3, 0, 1, 0, 0.333), (0, 0, 0, 3, 1.0), (0, 0, 0, 0, 0.0)]
    assert rows("word")[1:] == [(0, 0, 0, 2, 1.0), (0, 0, 0, 0, 0.0), (2, 1, 0, 0, 0.5)]


# ---- zones


def some_zones(rng):
    out = []
    for k in range(14):
        size, x, y = rng.choice([0.01, 1.0, 30.0, 400.0]), rng.uniform(-200, 200), rng.uniform(-200, 200)
        out.append((f"z{k}", [(x + rng.uniform(0, size), y + rng.uniform(0, size)) for _ in range(rng.randrange(3, 9))]))
    square = [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)]
    return [*out, ("square", square), ("again", square), ("line", square[:2]), ("flat", [(0.0, 0.0), (5.0, 0.0), (9.0, 0.0)]), ("none", None), ("odd", [(0.0, 0.0), (float("inf"), 1.0), (2.0, 2.0)])]


ZONES = "zone_id string, polygon array<struct<x:double,y:double>>"


def test_points_in_zones_against_every_pair(spark):
    rng = random.Random(4)
    polygons = some_zones(rng)
    z = spark.createDataFrame(polygons, ZONES)
    at = [(rng.uniform(-250, 650), rng.uniform(-250, 650)) for _ in range(300)]
    at += [(x + dx, y + dy) for _, p in polygons if p for x, y in p[:3] if x < 1e9 for dx, dy in ((0, 0), (1e-9, 0), (0, -1e-9), (0.004, 0.004))] + [(32.0, 0.0), (64.0, 32.0), (0.0, 0.0), (None, 1.0), (float("nan"), 1.0)]
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "i long, x double, y double")
    got = sorted(map(tuple, zones.points_in_zones(p, z).select("i", "zone_id").collect()))
    every = p.where("abs(x) < 1e300").crossJoin(z.where("zone_id <> 'odd'")).where(ex.in_polygon(F.col("x"), F.col("y"), F.col("polygon"))).select("i", "zone_id")
    assert got == sorted(map(tuple, every.collect())) and len(got) > 50
    assert zones.points_in_zones(p, z.limit(0)).count() == 0 and zones.points_in_zones(p.limit(0), z).count() == 0


def plain_entries(points, polygons, gap):
    """Entries and exits of (track, pts, frame, x, y) points, zone by zone, with every point looked at."""
    out = []
    for zone, inside in polygons.items():
        for track in sorted({p[0] for p in points}):
            within, last, since = False, -1.0, None
            for _, pts, _, x, y in sorted(p for p in points if p[0] == track):
                if inside(x, y) == within or pts - last < gap:
                    continue
                out.append((zone, track, "zone_exited" if within else "zone_entered", pts, pts - since if within else None))
                within, last, since = not within, pts, None if within else pts
    return out


def test_zone_events_against_every_point_and_zone(spark):
    rng = random.Random(5)
    points = [(t, 0.1 * i + rng.random() * 0.05, i, rng.uniform(0, 100), rng.uniform(0, 100)) for t in range(4) for i in range(150)]
    rects = {"a": (10, 10, 40, 60), "b": (0, 0, 1000, 1000), "c": (50.5, 20, 30, 30), "far": (5000, 5000, 5, 5)}
    z = spark.createDataFrame([(k, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]) for k, (x, y, w, h) in ((k, tuple(map(float, v))) for k, v in rects.items())], ZONES)
    df = spark.createDataFrame([(0, *p) for p in points], "video_id long, track_id long, pts double, frame_number long, x double, y double")
    df = df.withColumn("bbox", ex.box(F.col("x") - 1, F.col("y") - 1, F.lit(2.0), F.lit(2.0)))
    found = ev.zone_events(df, z, 0.5)
    inside = {k: (lambda px, py, x=x, y=y, w=w, h=h: x <= px <= x + w and y <= py <= y + h) for k, (x, y, w, h) in rects.items()}
    got = [(r.zone_id, r.track_id, r.event_type, round(r.start, 6), r.dwell and round(r.dwell, 6)) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(a, b, c, round(d, 6), e and round(e, 6)) for a, b, c, d, e in plain_entries(points, inside, 0.5)], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_zone_edges_against_every_pair(spark):
    rng = random.Random(6)
    z = spark.createDataFrame(some_zones(rng)[:-1], ZONES)
    rows = [(0, t, *(rng.uniform(-250, 250) for _ in range(4))) for t in range(80)]
    t = spark.createDataFrame(rows, "video_id long, track_id long, a double, b double, c double, d double")
    box = lambda x, y: ex.box(F.col(x), F.col(y), F.lit(0.0), F.lit(0.0))
    t = t.select("video_id", "track_id", box("a", "b").alias("start_bbox"), box("c", "d").alias("end_bbox"), F.lit(0.5).alias("confidence"), F.lit(0.0).alias("first_seconds"), F.lit(1.0).alias("last_seconds"))
    got = gr.zone_edges(t, z)
    inside = lambda b: ex.in_polygon(ex.cx(F.col(b)), ex.cy(F.col(b)), F.col("polygon"))
    want = t.crossJoin(z).where(inside("start_bbox") | inside("end_bbox")).count()
    assert got.count() == want == got.select("edge_id").distinct().count() and want > 10


# ---- association of detections


class Plain:
    """A track with one matrix filter for each of centre and size, written from the equations."""

    step = np.array([[1.0, 1.0], [0.0, 1.0]])
    noise = np.diag([1.0, 0.1])

    def __init__(self, frame, row):
        self.name, self.at, self.seen = (frame, row[1]), frame, frame
        self.state = [(np.array([v, 0.0]), np.eye(2) * 100.0) for v in self.measure(row)]

    @staticmethod
    def measure(row):
        x, y, w, h = row[4:]
        return x + w / 2, y + h / 2, w, h

    def move(self, frame):
        for _ in range(frame - self.at):
            self.state = [(self.step @ x, self.step @ p @ self.step.T + self.noise) for x, p in self.state]
        self.at = frame

    def box(self):
        x, y, w, h = (s[0][0] for s in self.state)
        return x - w / 2, y - h / 2, max(w, 1e-3), max(h, 1e-3)

    def put(self, row):
        out = []
        for (x, p), z in zip(self.state, self.measure(row), strict=True):
            k = p[:, 0] / (p[0, 0] + 4.0)
            out.append((x + k * (z - x[0]), p - np.outer(k, p[0])))
        self.state, self.seen = out, self.at


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


def plain_tracks(rows):
    """Names of tracks by detection; rows (frame, detection, class, confidence, x, y, w, h) of one video, all classes at once."""
    live, names = [], {}
    for frame in sorted({r[0] for r in rows}):
        for t in live:
            t.move(frame)
        live = [t for t in live if frame - t.seen <= tr.MAX_MISSED]
        free, rest = list(live), [r for r in rows if r[0] == frame]
        for wanted, least in ((lambda c: c >= tr.HIGH, tr.FIRST_IOU), (lambda c: tr.LOW <= c < tr.HIGH, tr.SECOND_IOU)):
            while True:
                pairs = [(-iou(t.box(), r[4:]), t.name, r[1], t, r) for t in free for r in rest if wanted(r[3]) and t.kind == r[2]]
                pairs = [p for p in pairs if -p[0] >= least]
                if not pairs:
                    break
                _, _, _, t, r = min(pairs, key=lambda p: p[:3])
                free.remove(t)
                rest.remove(r)
                t.box_of, names[r[1]] = r, t.name
            for t in live:
                if t not in free and getattr(t, "box_of", None):
                    t.put(t.box_of)
                    t.box_of = None
        for r in sorted(rest, key=lambda r: r[1]):
            if r[3] >= tr.BIRTH:
                t = Plain(frame, r)
                t.kind = r[2]
                live.append(t)
                names[r[1]] = t.name
    return names


@pytest.mark.parametrize("seed", range(2))
def test_association_against_a_plain_tracker(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    things = [(rng.choice(["car", "cat", None]), rng.uniform(0, 80), rng.uniform(0, 80), rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(12)]
    for frame in [*range(40), *range(60, 75), *range(110, 125)]:
        for kind, x, y, vx, vy in things:
            if rng.random() < 0.8:
                rows.append((frame, n, kind, rng.choice([0.05, 0.3, 0.55, 0.7, 0.9]), x + vx * frame + rng.gauss(0, 0.5), y + vy * frame + rng.gauss(0, 0.5), 10.0 + rng.random(), 12.0))
                n += 1
    df = spark.createDataFrame([(7, *r) for r in rows], "video_id long, frame_number long, detection_id long, class_name string, confidence double, x double, y double, width double, height double")
    df = df.withColumn("bbox", ex.box("x", "y", "width", "height"))
    got = {r.detection_id: r.track_id for r in tr.associate_tracks(df).collect()}
    assert got == {d: f"7-{a}-{b}" for d, (a, b) in plain_tracks(rows).items()} and len(set(got.values())) > 10


# ---- fusion of text


def plain_fusion(rows, gap):
    """(text, observation ids) of each sighting; every sighting is kept and looked at."""
    made = []
    for text, obs, frame, box in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        fits = [(fu.compatible(c["box"], box), -i) for i, c in enumerate(made) if c["text"] == text and frame - c["frame"] <= gap]
        fits = [f for f in fits if f[0] is not None]
        if fits:
            c = made[-max(fits)[1]]
        else:
            made.append(c := {"text": text, "ids": [], "box": None})
        c["frame"], c["box"] = frame, box if box is not None else c["box"]
        c["ids"].append(obs)
    return sorted((c["text"], sorted(c["ids"])) for c in made)


@pytest.mark.parametrize("seed", range(2))
def test_text_fusion_against_all_sightings(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), i, rng.randrange(60), None if rng.random() < 0.1 else {"x": rng.choice([0.0, 90.0, 400.0]) + rng.uniform(0, 40), "y": 5.0, "width": 50.0, "height": 20.0}) for i in range(150)]
    df = spark.createDataFrame([(1, o, f, f / 2, t.upper(), t, 0.5, None if b is None else (b["x"], b["y"], b["width"], b["height"])) for t, o, f, b in rows], "video_id long, observation_id long, frame_number long, pts double, text string, normalized_text string, confidence double, bbox struct<x:double,y:double,width:double,height:double>")
    got = fu.fuse_text(df).collect()
    assert sorted((r.normalized_text, r.supporting_observation_ids) for r in got) == plain_fusion(rows, fu.FRAME_GAP)
    for r in got:
        frames = [f for _, o, f, _ in rows if o in r.supporting_observation_ids]
        assert (r.first_frame, r.last_frame) == (min(frames), max(frames)) and all(b - a <= fu.FRAME_GAP for a, b in pairwise(sorted(frames)))
    assert "FlatMapGroups" not in fu.fuse_text(df)._jdf.queryExecution().executedPlan().toString()
    assert fu.fuse_text(df.limit(0)).count() == 0


def test_one_text_in_every_frame_keeps_one_sighting_open():
    s = fu.Sightings()
    assert {s.put(f, {"x": 0.0, "y": 0.0, "width": 9.0, "height": 9.0}, 5) for f in range(10_000)} == {0} and len(s.open) == 1
    assert [s.put(f, None, 5) for f in range(20_000, 40_000, 10)] == list(range(1, 2001)) and len(s.open) == 1


# ---- thinning


@pytest.mark.parametrize(("seed", "gap"), [(0, 0.3), (1, 5.0), (2, 0.0), (3, 1.0)])
def test_thinning_against_a_fold(spark, seed, gap):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), rng.choice([round(rng.uniform(0, 40), 1), rng.uniform(-5, 40), rng.uniform(1e3, 1.1e3)]), i) for i in range(400)] + [(7, i * 0.1, 1000 + i) for i in range(700)] + [(8, None, 5000), (8, 4.0, 5001), (8, 4.0, 5000)]
    want = []
    for key in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2])):
            if last is None or r[1] - last >= gap - 1e-9:
                want.append(r)
                last = r[1]
    df = spark.createDataFrame(rows, "k long, t double, i long")
    found = thin(df, ["k"], "t", ["i"], gap)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
    assert thin(df.limit(0), ["k"], "t", ["i"], gap).count() == 0
