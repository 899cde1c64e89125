"""Geotags: numeric filter, date chop, nearest place.

The reference asks a web geocoder for each point; here the places are a
table (a gazetteer) and the nearest one is found with an exact multi-level
grid join.  Points and places are cells of (x, y, z) on the unit sphere, so no meridian and no
pole is special.  At each level a point is joined (equi-join on the cell) to the
places of its 3x3x3 block, and its best candidate is accepted when it is
no farther than one cell's side: any place outside the block is.  Points not settled go to
the next, coarser level; at the last, eight cells hold the sphere and every block all of it.  Only points
with no place within half the sphere's radius of them get there.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.functions.text import chop, is_number

EARTH_KM = 6371.0
LEVELS = (2.0 ** -7, 2.0 ** -5, 2.0 ** -3, 2.0 ** -1)   # cell sides tried, as parts of the Earth's radius
WHOLE = 2.0                                             # the block of such a cell holds the sphere: settles every point


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    r = F.lit(math.pi / 180.0)
    dlat = (lat2 - lat1) * r
    dlon = (lon2 - lon1) * r
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(lat1 * r) * F.cos(lat2 * r) * F.pow(F.sin(dlon / 2), 2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _cells(lat: Column, lon: Column, side: float) -> list[Column]:
    r = math.pi / 180.0
    flat = F.cos(lat * r)
    return [F.floor(c / side).cast("int") for c in (flat * F.cos(lon * r), flat * F.sin(lon * r), F.sin(lat * r))]


def _sure_km(side: float) -> float:
    """A distance on the ground whose chord is a cell's side (a hair less, for rounding)."""
    return 2 * EARTH_KM * math.asin(min(1.0, side / 2)) * (1 - 1e-9)


def nearest_place(points: DataFrame, places: DataFrame, pid: str = "point_id",
                  levels: Sequence[float] = LEVELS) -> DataFrame:
    """For each point (pid, lat, lon) the nearest place (place, plat, plon).

    Output: pid, place, distance_km.  Ties go to the smaller place name.
    """
    from maillake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(points.sparkSession)
    todo = points.select(pid, "lat", "lon").checkpoint()
    pl = places.select("place", "plat", "plon")
    step = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(ds, ("dx", "dy", "dz"))])
                     for ds in itertools.product((-1, 0, 1), repeat=3)])
    out = None
    for side in (*levels, WHOLE):
        last = side == WHOLE
        cx, cy, cz = _cells(F.col("plat"), F.col("plon"), side)
        pcells = pl.select("*", cx.alias("_cx"), cy.alias("_cy"), cz.alias("_cz"))
        qx, qy, qz = _cells(F.col("lat"), F.col("lon"), side)
        q = (todo.select(pid, "lat", "lon", qx.alias("_x"), qy.alias("_y"), qz.alias("_z"), F.explode(step).alias("_o"))
             .select(pid, "lat", "lon", (F.col("_x") + F.col("_o.dx")).alias("_cx"), (F.col("_y") + F.col("_o.dy")).alias("_cy"),
                     (F.col("_z") + F.col("_o.dz")).alias("_cz")))
        d = haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
        best = (q.join(pcells, ["_cx", "_cy", "_cz"]).withColumn("_d", d)
                .groupBy(pid, "lat", "lon").agg(F.min(F.struct("_d", "place")).alias("_b")))
        ok = best if last else best.filter(F.col("_b._d") <= _sure_km(side))
        got = ok.select(pid, F.col("_b.place").alias("place"), F.col("_b._d").alias("distance_km"))
        out = got if out is None else out.unionByName(got)
        if not last:
            # Checkpoint the unsettled points: the next level reads them
            # instead of re-running every earlier level's joins.
            todo = todo.join(ok.select(pid), pid, "left_anti").checkpoint()
    return out


def usable_geotags(tags: DataFrame) -> DataFrame:
    """P26 + P27: rows with a numeric latitude; date text loses its last 4 characters."""
    return (tags.filter(is_number(F.col("latitude")))
            .withColumn("date", chop(F.col("date_created"), 4))
            .withColumn("lat", F.col("latitude").cast("double"))
            .withColumn("lon", F.col("longitude").cast("double")))
