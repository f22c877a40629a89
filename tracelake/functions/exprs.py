"""Column expressions shared by the operators: geometry, intervals, time text, ids, normalisation."""

from __future__ import annotations

import unicodedata
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = "struct<x:double,y:double,width:double,height:double>"
COMPASS = ["E", "SE", "S", "SW", "W", "NW", "N", "NE"]  # 0 = right, 90 = down
COMPASS_WORDS = ["right", "down-right", "down", "down-left", "left", "up-left", "up", "up-right"]


def box(x, y, width, height) -> Column:
    cols = {"x": x, "y": y, "width": width, "height": height}
    return F.struct(*(F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for n, c in cols.items()))


def x2(b: Column) -> Column:
    return b["x"] + b["width"]


def y2(b: Column) -> Column:
    return b["y"] + b["height"]


def cx(b: Column) -> Column:
    return b["x"] + b["width"] / 2


def cy(b: Column) -> Column:
    return b["y"] + b["height"] / 2


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for disjoint boxes, boxes without area, or a union that is not positive."""
    w = F.greatest(F.least(x2(a), x2(b)) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    h = F.greatest(F.least(y2(a), y2(b)) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    both, union = w * h, area(a) + area(b) - w * h
    proper = (a["width"] > 0) & (a["height"] > 0) & (b["width"] > 0) & (b["height"] > 0)
    return F.when(proper & (union > 0), both / union).otherwise(0.0)


def rounded(x: Column, places: int) -> Column:
    """F.round(x, places) without its decimals where x is not close to the middle of two results: a multiple of time less a row."""
    scale = float(10**places)
    near = F.rint(x * scale)
    clear = (F.abs(F.abs(x * scale - near) - 0.5) > 1e-3) & (F.abs(near) < 2.0**31)
    return F.when(clear, (near + 0.0) / scale).otherwise(F.round(x, places))


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def centroid_distance(a: Column, b: Column) -> Column:
    return point_distance(cx(a), cy(a), cx(b), cy(b))


def tiou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Temporal IoU; a union without length is 1 for equal starts, else 0."""
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))
    union = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(union <= 0, F.when(s1 == s2, 1.0).otherwise(0.0)).otherwise(both / union)


def heading(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 360): 0 to the right, 90 downwards."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360 - d)


def compass8(degrees: Column, names: list[str] = COMPASS) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.floor((degrees + 22.5) / 45), F.lit(8)) + 1).cast("int"))


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting over an array of (x, y) points; fewer than three hold nothing. The bounding box is tested first."""

    def crosses(i: Column) -> Column:
        p, q = F.get(polygon, i), F.get(polygon, (i + 1) % F.size(polygon))
        meets = (y > F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"])) & (x <= F.greatest(p["x"], q["x"])) & (p["y"] != q["y"])
        at = (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]) + p["x"]
        return F.when(meets & ((p["x"] == q["x"]) | (x <= at)), 1).otherwise(0)

    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    near = (x >= F.array_min(xs)) & (x <= F.array_max(xs)) & (y >= F.array_min(ys)) & (y <= F.array_max(ys))
    odd = F.aggregate(F.sequence(F.lit(0), F.size(polygon) - 1), F.lit(0), lambda n, i: n + crosses(i)) % 2 == 1
    return F.coalesce((F.size(polygon) >= 3) & near & odd, F.lit(False))


def rect_zone(x: float, y: float, width: float, height: float) -> Column:
    points = [(x, y), (x + width, y), (x + width, y + height), (x, y + height)]
    return F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in points))


def crop_box(b: Column, width: Column, height: Column, margin: Column, normalized: Column | None = None) -> Column:
    """Pixel rectangle of a box grown by a share of its size and cut to the frame, with the reason if it is unusable."""
    norm = F.lit(False) if normalized is None else normalized
    sx, sy = F.when(norm, width).otherwise(1.0), F.when(norm, height).otherwise(1.0)
    bw, bh = b["width"] * sx, b["height"] * sy
    left = F.greatest(F.floor(b["x"] * sx - bw * margin), F.lit(0))
    top = F.greatest(F.floor(b["y"] * sy - bh * margin), F.lit(0))
    right, bottom = F.least(F.ceil(b["x"] * sx + bw * (1 + margin)), width), F.least(F.ceil(b["y"] * sy + bh * (1 + margin)), height)
    reason = F.when((bw < 1) | (bh < 1), "box_too_small").when((right - left < 2) | (bottom - top < 2), "crop_too_small")
    good = reason.isNull()
    return F.struct(*(F.when(good, v.cast("long")).alias(n) for n, v in (("left", left), ("top", top), ("right", right), ("bottom", bottom))), reason.alias("reason"))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which there is no SQL function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


_SPACE = r"[\s   -     　]+"


def normalize_ocr(c: Column, lower: bool = True) -> Column:
    """NFKC, no zero-width spaces, joiners only beside Devanagari, white space as single spaces."""
    c = F.regexp_replace(nfkc(c), "[​﻿]", "")
    c = F.regexp_replace(c, r"(?<![ऀ-ॿ])[‌‍](?![ऀ-ॿ])", "")
    c = F.trim(F.regexp_replace(c, _SPACE, " "))
    return F.lower(c) if lower else c


def normalize_transcript(c: Column, joiners: bool = True) -> Column:
    c = F.regexp_replace(nfkc(c), "[​﻿⁠]", "")
    c = c if joiners else F.regexp_replace(c, "[‌‍]", "")
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def normalize_eval(c: Column, case_sensitive: bool = False, strip_punctuation: bool = False) -> Column:
    c = nfkc(c)
    c = c if case_sensitive else F.lower(c)
    c = F.regexp_replace(c, r"\p{P}", "") if strip_punctuation else c
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def parse_ts(c: Column) -> Column:
    """Seconds of `HH:MM:SS.mmm`, `MM:SS` or plain seconds, comma or point; 0 for anything else."""
    parts = F.transform(F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double"))
    good = (F.size(parts) <= 3) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(good, F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p)).otherwise(0.0)


def fmt_ts(c: Column) -> Column:
    s = F.floor(F.greatest(c, F.lit(0.0))).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def parse_fps(c: Column) -> Column:
    """A rational like 30000/1001 or a number as frames a second; null where it is none or not positive."""
    a, b = F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.when(F.contains(c, F.lit("/")), F.split_part(c, F.lit("/"), F.lit(2)).try_cast("double")).otherwise(1.0)
    return F.when((b != 0) & (a > 0), a / b)


def wilson(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """Wilson score interval, 4 decimals; null for no trials."""
    z = {0.90: 1.6449, 0.95: 1.96, 0.99: 2.5758}.get(confidence) or NormalDist().inv_cdf((1 + confidence) / 2)
    p, nn = k / n, n.cast("double")
    mid, half = (p + z * z / (2 * nn)) / (1 + z * z / nn), z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn)
    return F.when(n > 0, F.struct(F.round(F.greatest(mid - half, F.lit(0.0)), 4).alias("low"), F.round(F.least(mid + half, F.lit(1.0)), 4).alias("high")))


def node_id(kind: str, source: Column) -> Column:
    return F.concat(F.lit(kind + ":"), source.cast("string"))


def edge_id(relation: Column, source: Column, target: Column, qualifier: Column | None = None) -> Column:
    plain = F.concat(relation, F.lit(":"), source, F.lit("->"), target)
    return plain if qualifier is None else F.concat(plain, F.lit("#"), qualifier)


def fingerprint(start: Column, end: Column, ids: list[Column], query: Column) -> Column:
    """Digest of a request: times to 3 decimals, sorted id arrays, trimmed lower-case query."""
    parts = [F.format_string("%.3f", start), F.format_string("%.3f", end), *(F.array_join(F.array_sort(i), ",") for i in ids), F.lower(F.trim(F.coalesce(query, F.lit(""))))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def slug(c: Column, limit: int = 120) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s_-]", ""), r"[\s_-]+", "-")
    return F.substring(F.regexp_replace(c, "^-+|-+$", ""), 1, limit)


def latex_ok(c: Column) -> Column:
    """Whether a formula's environments and brackets balance and its dollars pair up, escaped ones aside."""
    plain = F.regexp_replace(c, r"\\[\\{}$\[\]()]", "")
    tokens = F.regexp_extract_all(plain, F.lit(r"(\\begin\{[^}]*\}|\\end\{[^}]*\}|[{}\[\]()])"), F.lit(1))

    def opens(t: Column) -> Column:
        return F.when(t.startswith("\\begin"), F.replace(t, F.lit("\\begin"), F.lit("\\end"))).otherwise(F.translate(t, "{[(", "}])"))

    def fold(stack: Column, t: Column) -> Column:
        is_open = t.startswith("\\begin") | t.isin("{", "[", "(")
        top = F.when(F.size(stack) > 0, F.element_at(stack, -1)).otherwise("")
        return F.when(is_open, F.concat(stack, F.array(opens(t)))).when(top == t, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(F.concat(stack, F.array(F.lit("bad"))))

    rest = F.aggregate(tokens, F.array().cast("array<string>"), fold)
    return F.coalesce((F.size(rest) == 0) & (F.regexp_count(plain, F.lit(r"\$")) % 2 == 0), F.lit(False))
