"""Points near other points, and the regions that contain a point.

``near``: pairs of points within a distance. Equal locations are collapsed first, so a spot that holds a
third of all points is one location; each location looks into the cells its circle touches, and
the pairs of locations found are expanded to pairs of points at the end.

``inside``: the areas that contain each point, by trapezoidal decomposition. A polygon's vertices and
crossings cut it into slabs by longitude; between two cuts no edges cross, so a slab's edges are
ordered by latitude and a binary search counts those below a point: odd is inside (holes included).
Slabs are cut again into tiles, which spreads them over the cluster: point and slab meet by an
equi-join on the tile, whatever number of areas there is. Catalyst broadcasts the slab table if its
measured size allows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencase.staging import cut

#: Fixed value: the sphere's radius in metres.
EARTH_M = 6371008.8
_DEG_M = math.pi * EARTH_M / 180
#: Tile levels: level L has tiles of 360 / 2**L degrees; an area uses the finest on which it spans at most MAX_SPAN tiles a side.
LEVELS, MAX_SPAN = (14, 11, 8, 5, 2, 0), 16


def locations(rows: DataFrame, id: str = "id", lat: str = "gps_lat", lon: str = "gps_lon") -> DataFrame:
    """id, lat, lon of the rows with a location: both numbers finite, in range and not exactly 0/0."""
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    # NaN and infinities fail the range tests: Spark orders NaN above all numbers
    fine = y.between(-90, 90) & x.between(-180, 180) & ~((y == 0) & (x == 0))
    return rows.where(F.col(id).isNotNull() & fine).select(F.col(id).cast("long").alias("id"), (y + 0.0).alias("lat"), (x + 0.0).alias("lon"))


def metres(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def near(points: DataFrame, distance_m: float = 30.0) -> DataFrame:
    """id_a, id_b (id_a < id_b) of every two points at most ``distance_m`` apart; points as from ``locations``.

    Rows beyond the antimeridian and at the poles are met like any others. Repeated rows of one id
    count once. An empty table gives no rows.
    """
    height = max(distance_m / _DEG_M * 1.6, 1e-7)  # of a band, in degrees
    bands = math.ceil(180 / height)
    # a place is known by its two numbers, not by a hash of them, so no two can be taken for one
    spots = cut(points.groupBy("lat", "lon").agg(F.count("*").alias("n")))

    def columns(band: Column) -> Column:
        # number of cells in a band, of at least `height` in width where the band is widest
        top = F.least(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
        return F.greatest(F.floor(360 / height * F.cos(F.radians(F.least(top, F.lit(90.0))))), F.lit(1)).cast("long")

    band_of = F.least(F.floor((F.col("lat") + 90) / height), F.lit(bands - 1)).cast("long")
    cell = lambda lon, n: F.floor((lon + 180) / 360 * n).cast("long")
    home = spots.select("lat", "lon", band_of.alias("band")).withColumn("cell", F.pmod(cell(F.col("lon"), columns(F.col("band"))), columns(F.col("band"))))
    reach = distance_m / _DEG_M * 1.0000001
    low, high = F.floor((F.col("lat") + 90 - reach) / height), F.floor((F.col("lat") + 90 + reach) / height)
    asked = spots.select("lat", "lon", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("long"), F.least(high, F.lit(bands - 1)).cast("long"))).alias("band"))
    # half the width of the circle in longitude at its latitude; beyond a pole's cap it is all round
    wide = F.when(F.abs("lat") + reach >= 89.9999, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(F.col("lat"))), F.lit(1.0)))))
    n = columns(F.col("band"))
    asked = asked.withColumn("n", n).withColumn("w", wide)
    first, last = cell(F.col("lon") - F.col("w"), F.col("n")), cell(F.col("lon") + F.col("w"), F.col("n"))
    asked = asked.select("lat", "lon", "band", F.explode(F.sequence(first, F.least(last, first + F.col("n") - 1))).alias("c"), "n")
    asked = asked.select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "band", F.pmod("c", "n").alias("cell"))
    before = (F.col("lat_a") < F.col("lat")) | ((F.col("lat_a") == F.col("lat")) & (F.col("lon_a") < F.col("lon")))
    met = asked.join(home, ["band", "cell"]).where(before).where(metres(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon")) <= distance_m)
    met = met.select("lat_a", "lon_a", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    alone = spots.where("n > 1").select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    pairs = cut(met.unionByName(alone))
    busy = pairs.select(F.explode(F.array(F.struct(F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon")), F.struct(F.col("lat_b").alias("lat"), F.col("lon_b").alias("lon")))).alias("s")).select("s.*").distinct()
    members = cut(points.select("id", "lat", "lon").distinct().join(busy, ["lat", "lon"], "left_semi"))
    a = members.select(F.col("id").alias("x"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = members.select(F.col("id").alias("y"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    apart = (F.col("lat_a") != F.col("lat_b")) | (F.col("lon_a") != F.col("lon_b"))
    both = pairs.join(a, ["lat_a", "lon_a"]).join(b, ["lat_b", "lon_b"]).where((apart & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def rings_of(wkt: str) -> list[np.ndarray]:
    """The rings (n x 2, longitude and latitude) of a POLYGON or MULTIPOLYGON text; others give none."""
    if not re.match(r"\s*(MULTI)?POLYGON", wkt or "", re.I):
        return []
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    rings = []
    for ring in re.findall(r"\(([^()]+)\)", wkt):
        points = [re.findall(number, p)[:2] for p in ring.split(",")]
        if all(len(p) == 2 for p in points) and len(points) >= 3:
            rings.append(np.array(points, dtype=np.float64))
    return rings


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """x1, y1, x2, y2 with x1 < x2 of every edge that is not vertical; rings are closed if they aren't."""
    parts = []
    for ring in rings:
        nxt = np.roll(ring, -1, axis=0)
        parts.append(np.hstack([ring, nxt]))
    e = np.vstack(parts)
    e = e[e[:, 0] != e[:, 2]]
    back = e[:, 0] > e[:, 2]
    e[back] = e[back][:, [2, 3, 0, 1]]
    return e


def _crossings(e: np.ndarray) -> np.ndarray:
    """Longitudes at which two edges cross between their ends."""
    out = []
    for i in range(len(e)):
        o = e[i + 1 :]
        o = o[(o[:, 0] < e[i, 2]) & (o[:, 2] > e[i, 0])]
        if not len(o):
            continue
        s1, s2 = (e[i, 3] - e[i, 1]) / (e[i, 2] - e[i, 0]), (o[:, 3] - o[:, 1]) / (o[:, 2] - o[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (o[:, 1] - s2 * o[:, 0] - e[i, 1] + s1 * e[i, 0]) / (s1 - s2)
        lo, hi = np.maximum(e[i, 0], o[:, 0]), np.minimum(e[i, 2], o[:, 2])
        out.append(x[(x > lo) & (x < hi)])
    return np.concatenate(out) if out else np.empty(0)


def _level(width: float, height: float) -> int:
    return next((v for v in LEVELS if max(width, height) / (360 / 2**v) <= MAX_SPAN), 0)


def _tiles(level: int, x0: float, x1: float, y0: float, y1: float) -> Iterator[tuple[int, int, float, float, float]]:
    """tx, ty, shift, x_lo, x_hi: the tiles a box touches; a point at lon in the tile stands at lon + shift in the box's own longitudes."""
    n = 1 << level
    size = 360 / n
    for tx in range(math.floor((x0 + 180) / size), math.floor((x1 + 180) / size) + 1):
        turns = tx // n
        for ty in range(max(0, math.floor((y0 + 90) / size)), min(math.floor(180 / size), math.floor((y1 + 90) / size)) + 1):
            yield tx - turns * n, ty, turns * 360.0, max(x0, tx * size - 180), min(x1, (tx + 1) * size - 180)


_SLAB = "area_id long, kind string, level int, tx long, ty long, shift double, x_lo double, x_hi double, lat double, lon double, radius_m double, edges array<struct<x:double,y:double,s:double>>"


def slabs(areas: DataFrame) -> DataFrame:
    """The areas as tiles of slabs: see ``_SLAB``. A polygon's slab has its edges from south to north as a point and slope.

    Rows without an id, circles without a finite centre or with a negative radius and unreadable polygons give none.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("s", pa.float64())]))
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 6, edge]
        names = [x.split()[0] for x in _SLAB.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for area in batch.to_pylist():
                lat, lon, radius = area["lat"], area["lon"], area["radius_m"]
                if (area["kind"] or "").lower() == "circle":
                    if None in (lat, lon, radius) or not all(map(math.isfinite, (lat, lon, radius))) or radius < 0:
                        continue
                    dy = radius / _DEG_M * 1.000001 + 1e-9
                    if abs(lat) + dy >= 89.9999 or dy >= 89:
                        x0, x1 = -180.0, 180.0
                    else:
                        dx = math.degrees(math.asin(min(1.0, math.sin(math.radians(dy)) / math.cos(math.radians(lat))))) + 1e-9
                        x0, x1 = lon - dx, lon + dx
                    level = _level(x1 - x0, 2 * dy)
                    for tx, ty in sorted({(t[0], t[1]) for t in _tiles(level, x0, x1, lat - dy, lat + dy)}):
                        rows.append((area["area_id"], "circle", level, tx, ty, 0.0, -1e9, 1e9, lat, lon, radius, None))
                    continue
                rings = rings_of(area["wkt"])
                if not rings:
                    continue
                e = _edges(rings)
                if not len(e):
                    continue
                cuts = np.unique(np.concatenate([e[:, 0], e[:, 2], _crossings(e)]))
                level = _level(cuts[-1] - cuts[0], e[:, [1, 3]].max() - e[:, [1, 3]].min())
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    there = e[(e[:, 0] <= a) & (e[:, 2] >= b)]
                    if not len(there):
                        continue
                    slope = (there[:, 3] - there[:, 1]) / (there[:, 2] - there[:, 0])
                    order = np.argsort(there[:, 1] + slope * ((a + b) / 2 - there[:, 0]), kind="stable")
                    ends = np.concatenate([there[:, 1] + slope * (a - there[:, 0]), there[:, 1] + slope * (b - there[:, 0])])
                    lines = [{"x": there[i, 0], "y": there[i, 1], "s": slope[i]} for i in order]
                    for tx, ty, shift, lo, hi in _tiles(level, a, b, ends.min(), ends.max()):
                        if hi > lo:
                            rows.append((area["area_id"], "polygon", level, tx, ty, shift, lo, hi, None, None, None, lines))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = areas.where("area_id is not null").select(
        F.col("area_id").cast("long").alias("area_id"), F.col("kind").cast("string").alias("kind"), F.col("center_lat").cast("double").alias("lat"),
        F.col("center_lon").cast("double").alias("lon"), F.col("radius_m").cast("double").alias("radius_m"), F.col("wkt").cast("string").alias("wkt"),
    )
    return rows.mapInArrow(build, _SLAB)


def inside(points: DataFrame, areas: DataFrame) -> DataFrame:
    """id, area_id of every area that contains each point; points as from ``locations``.

    A polygon may run past longitude 180 and have holes; a point on an edge counts as above it.
    """
    parts = cut(slabs(areas))
    levels = sorted(r[0] for r in parts.select("level").distinct().collect())  # at most len(LEVELS) numbers
    if not levels:
        return points.select("id", F.lit(None).cast("long").alias("area_id")).limit(0)
    at = points.select("id", F.col("lat").alias("y"), F.col("lon").alias("x"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    at = at.withColumn("tx", F.expr("pmod(floor((x + 180) / (360.0D / shiftleft(1L, level))), shiftleft(1L, level))"))
    at = at.withColumn("ty", F.expr("floor((y + 90) / (360.0D / shiftleft(1L, level)))"))
    met = at.join(parts, ["level", "tx", "ty"])
    # longitude 180 is -180 here, where its tile begins; a slab that holds 180 goes on in that tile with shift 360
    lon = "(if(x = 180, -180D, x) + shift)"
    # binary search: (lo, hi) closes in on the number of edges below the point, in as many steps as the edges' number has bits
    below = f"""aggregate(sequence(0, length(bin(size(edges)))), struct(0 as lo, size(edges) as hi), (a, i) ->
        case when a.lo >= a.hi then a
             when edges[shiftright(a.lo + a.hi, 1)].y + edges[shiftright(a.lo + a.hi, 1)].s * ({lon} - edges[shiftright(a.lo + a.hi, 1)].x) <= y
             then struct(shiftright(a.lo + a.hi, 1) + 1 as lo, a.hi as hi)
             else struct(a.lo as lo, shiftright(a.lo + a.hi, 1) as hi) end, a -> a.lo)"""
    in_slab = met.where(f"kind = 'polygon' and x_lo <= {lon} and {lon} < x_hi").where(f"{below} % 2 = 1")
    in_circle = met.where("kind = 'circle'").where(metres(F.col("y"), F.col("x"), F.col("lat"), F.col("lon")) <= F.col("radius_m"))
    return in_slab.select("id", "area_id").unionByName(in_circle.select("id", "area_id")).distinct()
