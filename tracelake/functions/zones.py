"""Points in polygons by a cover of grid cells, for any number of zones of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.exprs import in_polygon

#: A zone's cells are the largest power of two of which so many cross its longer side, so a zone has some (CELLS + 1)**2 at most.
CELLS = 16
#: Cells are grown by this share of their size when edges are tested, against rounding.
_MARGIN = 1e-6


def zone_cells(zones: DataFrame) -> DataFrame:
    """zones (zone_id, polygon) as grid cells: zone_id, polygon (of border cells only), level (cells are 2**level wide), gx, gy, border.

    A cell that an edge comes near is a border cell; one that no edge meets is inside or not as
    a whole, which its centre tells, and is left out if not. Zones of fewer than three points, or
    with a null or infinite one, hold nothing and have no cells; repeated zones are repeated.
    """
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    sound = (F.size("polygon") >= 3) & ~F.exists("polygon", lambda p: F.coalesce(F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) > 1e300) | (F.abs(p["y"]) > 1e300), F.lit(True)))
    z = zones.where(sound).select("zone_id", "polygon", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    # far from the origin a cell must not be finer than the coordinates' own steps
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.greatest(*(F.abs(c) for c in ("x0", "x1", "y0", "y1"))) * 1e-9, F.lit(1e-9))
    z = z.withColumn("level", F.ceil(F.log2(span / CELLS)).cast("int")).withColumn("w", F.pow(F.lit(2.0), F.col("level")))
    low, high = (lambda c: F.floor(F.col(c) / F.col("w"))), (lambda c: F.floor(F.col(c) / F.col("w")))
    z = z.withColumn("gx", F.explode(F.sequence(low("x0"), high("x1")))).withColumn("gy", F.explode(F.sequence(low("y0"), high("y1"))))
    pad = F.col("w") * _MARGIN
    left, right = F.col("gx") * F.col("w") - pad, (F.col("gx") + 1) * F.col("w") + pad
    top, bottom = F.col("gy") * F.col("w") - pad, (F.col("gy") + 1) * F.col("w") + pad

    def meets(p, i):
        """The edge from p to the next point comes near the cell: their boxes meet, and not all corners lie on one side of it."""
        q = F.get("polygon", (i + 1) % F.size("polygon"))
        boxes = (F.least(p["x"], q["x"]) <= right) & (F.greatest(p["x"], q["x"]) >= left) & (F.least(p["y"], q["y"]) <= bottom) & (F.greatest(p["y"], q["y"]) >= top)
        side = lambda x, y: (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        corners = [side(x, y) for x in (left, right) for y in (top, bottom)]
        return boxes & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    z = z.withColumn("border", F.exists(F.transform("polygon", meets), lambda b: b))
    centre = in_polygon((F.col("gx") + 0.5) * F.col("w"), (F.col("gy") + 0.5) * F.col("w"), F.col("polygon"))
    return z.where(F.col("border") | centre).select("zone_id", F.when(F.col("border"), F.col("polygon")).alias("polygon"), "level", "gx", "gy", "border")


def points_in_zones(points: DataFrame, zones: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points with zone_id, one row for each zone that holds the point; in_polygon says which do, and is asked in border cells only.

    A point meets the cell that it lies in on each level that zones have (a few: powers of two
    between the smallest and the largest zone); these levels alone are collected. Points with a
    null or infinite coordinate lie in no zone.
    """
    cells = zone_cells(zones)
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    if not levels:
        return points.withColumn("zone_id", F.lit(None).cast(zones.schema["zone_id"].dataType)).where("false")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    p = points.where(f"abs({x}) < 1e300 AND abs({y}) < 1e300").withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("gx", at(x)).withColumn("gy", at(y))
    hit = p.join(cells, ["level", "gx", "gy"]).where(~F.col("border") | in_polygon(F.col(x), F.col(y), F.col("polygon")))
    return hit.select(*points.columns, "zone_id")
