"""Ways in of doors, from tables of rooms and doors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def _edges(outline: Column) -> Column:
    """The edges of an outline as an array of (k, ax, ay, bx, by)."""
    n = F.size(outline)
    at = lambda k, c: F.get(outline, k % n)[c]
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), at(k, "x").alias("ax"), at(k, "y").alias("ay"), at(k + 1, "x").alias("bx"), at(k + 1, "y").alias("by")))


def _distance(x: Column, y: Column, e: Column) -> Column:
    return G.segment_distance(x, y, e["ax"], e["ay"], e["bx"], e["by"])


def _mean(points: Column, c: str) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + p[c]) / F.size(points)


def _unit(dx: Column, dy: Column) -> Column:
    n = F.hypot(dx, dy)
    return F.when(n > 1e-9, F.struct((dx / n + 0.0).alias("x"), (dy / n + 0.0).alias("y")))


def door_axes(doors: DataFrame, rooms: DataFrame, corner_share: float = 0.5) -> DataFrame:
    """run_id, door_index, door_type, centre, way_a, way_b, inward of each door.

    `doors`: run_id, door_index, polygon; `rooms`: run_id, boundary; both arrays of
    (x, y).  The wall nearest to the door's centre is its own.  Where the second
    nearest meets it and their corner is within `corner_share` of the door's narrow
    side (1 at least), the ways in lead along both walls from the corner; else both
    ways along the wall.  Doors of too few points or walls of no length are left out.
    """
    rows = doors.join(rooms.select("run_id", "boundary"), "run_id").where((F.size("boundary") >= 3) & (F.size("polygon") >= 2))
    rows = rows.withColumn("centre", F.struct(_mean(F.col("polygon"), "x").alias("x"), _mean(F.col("polygon"), "y").alias("y"))).withColumn("walls", _edges(F.col("boundary")))
    near = F.array_sort(F.transform("walls", lambda e: F.struct(_distance(F.col("centre.x"), F.col("centre.y"), e).alias("d"), e["k"].alias("k"), e.alias("e"))))
    rows = rows.withColumn("near", near).withColumns({"own": F.col("near")[0]["e"], "next": F.col("near")[1]["e"], "n": F.size("boundary")})
    along = _unit(F.col("own.bx") - F.col("own.ax"), F.col("own.by") - F.col("own.ay"))
    rows = rows.withColumn("along", along).where("along is not null")
    into = F.col("along.x") * (_mean(F.col("boundary"), "y") - (F.col("own.ay") + F.col("own.by")) / 2) - F.col("along.y") * (_mean(F.col("boundary"), "x") - (F.col("own.ax") + F.col("own.bx")) / 2)
    sign = F.when(into >= 0, 1.0).otherwise(-1.0)
    rows = rows.withColumn("inward", F.struct((-F.col("along.y") * sign + 0.0).alias("x"), (F.col("along.x") * sign + 0.0).alias("y")))
    apart = F.pmod(F.col("next.k") - F.col("own.k"), F.col("n"))
    corner = F.when(apart == 1, F.col("next.k")).when(apart == F.col("n") - 1, F.col("own.k"))
    side = lambda c: F.array_max(F.transform("polygon", lambda p: p[c])) - F.array_min(F.transform("polygon", lambda p: p[c]))
    narrow = F.greatest(F.lit(1.0), F.least(side("x"), side("y")))
    rows = rows.withColumn("v", F.get("boundary", corner)).withColumn("at_corner", F.array_min(F.transform(_edges(F.col("polygon")), lambda e: _distance(F.col("v.x"), F.col("v.y"), e))) <= corner_share * narrow)
    leg = lambda k: _unit(F.get("boundary", F.pmod(k, F.col("n")))["x"] - F.col("v.x"), F.get("boundary", F.pmod(k, F.col("n")))["y"] - F.col("v.y"))
    wall_way = lambda s: F.struct((-F.col("inward.y") * s + 0.0).alias("x"), (F.col("inward.x") * s + 0.0).alias("y"))
    is_corner = F.coalesce("at_corner", F.lit(False))
    rows = rows.select(
        "run_id", "door_index", F.when(is_corner, "CORNER").otherwise("STRAIGHT").alias("door_type"), "centre",
        F.when(is_corner, leg(corner + 1)).otherwise(wall_way(1.0)).alias("way_a"), F.when(is_corner, leg(corner - 1)).otherwise(wall_way(-1.0)).alias("way_b"), "inward",
    )
    return rows.where("way_a is not null and way_b is not null")
