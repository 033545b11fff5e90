import math
import random

import numpy as np

from lumencase.operators.places import inside, locations, near

AREA = "area_id int, area_name string, kind string, center_lat double, center_lon double, radius_m double, wkt string, x string"


def points(spark, rows):
    return locations(spark.createDataFrame(rows, "id long, gps_lat double, gps_lon double"))


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


def test_near_against_brute_force_with_poles_and_antimeridian(spark):
    rng = random.Random(1)
    rows = []
    for lat, lon in [(0.0, 179.9999), (89.9999, 10.0), (-89.9999, -170.0), (47.0, 8.0), (-33.0, 151.0), (0.00005, 0.0)]:
        for _ in range(40):
            y = max(-90.0, min(90.0, lat + rng.uniform(-4e-4, 4e-4)))
            x = lon + rng.uniform(-4e-4, 4e-4) / max(0.01, math.cos(math.radians(y)))
            rows.append((len(rows) + 1, y, (x + 180) % 360 - 180))
    rows += [(len(rows) + 1 + i, 47.0, 8.0) for i in range(30)]
    got = {tuple(r) for r in near(points(spark, rows)).collect()}
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if metres(a[1:], b[1:]) <= 30}
    assert got == want


def test_unusable_locations_are_left_out(spark):
    bad = [(1, None, 1.0), (2, 1.0, None), (3, float("nan"), 1.0), (4, 91.0, 1.0), (5, 1.0, 181.0), (6, 0.0, 0.0), (7, float("inf"), 0.0), (None, 1.0, 1.0)]
    assert points(spark, bad).count() == 0
    assert near(points(spark, bad)).count() == 0
    assert points(spark, [(1, 0.0, 5.0), (2, -90.0, 180.0)]).count() == 2


def _brute(rows, areas):
    out = set()
    for area_id, kind, lat, lon, radius, rings in areas:
        for i, y, x in rows:
            if kind == "circle":
                if metres((y, x), (lat, lon)) <= radius:
                    out.add((i, area_id))
                continue
            for shift in (-360, 0, 360):
                odd = False
                for ring in rings:
                    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                        if (x1 > x + shift) != (x2 > x + shift):
                            odd ^= y >= y1 + (y2 - y1) * (x + shift - x1) / (x2 - x1)
                if odd:
                    out.add((i, area_id))
    return out


def test_inside_against_brute_force(spark):
    rng = np.random.default_rng(2)

    def star(cx, cy, r, n):
        a = np.linspace(0, 2 * np.pi, n, endpoint=False)
        d = r * rng.uniform(0.4, 1.0, n)
        return [(round(cx + x, 4), round(cy + y, 4)) for x, y in zip(d * np.cos(a), d * np.sin(a))]

    shapes = [[star(10, 10, 3, 25), star(10, 10, 0.8, 9)], [star(179.5, -5, 2, 12)], [[(0, 0), (4, 4), (4, 0), (0, 4)]], [star(-60, 70, 0.05, 40)], [star(0, 0, 60, 30)]]
    areas = [(i + 1, "polygon", None, None, None, rings) for i, rings in enumerate(shapes)] + [(20, "circle", 89.0, 0.0, 300_000.0, None), (21, "circle", -5.0, 179.9, 90_000.0, None), (22, "circle", 10.0, 10.0, 1000.0, None)]
    text = lambda rings: "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in ring + ring[:1]) + ")" for ring in rings) + ")"
    table = spark.createDataFrame([(a, "n", k, la, lo, r, text(s) if s else None, "z") for a, k, la, lo, r, s in areas], AREA)
    spots = [(9 + rng.uniform(-3, 5), 9 + rng.uniform(-3, 5)) for _ in range(300)]
    spots += [(-5 + rng.uniform(-3, 3), 179.5 + rng.uniform(-3, 0.5)) for _ in range(150)] + [(-5 + rng.uniform(-3, 3), -180 + rng.uniform(0, 3)) for _ in range(150)]
    spots += [(70 + rng.uniform(-0.1, 0.1), -60 + rng.uniform(-0.1, 0.1)) for _ in range(100)] + [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(300)] + [(89.5, 170.0), (2.0, 2.0)]
    rows = [(i, float(y), float(x)) for i, (y, x) in enumerate(spots)]
    assert {tuple(r) for r in inside(points(spark, rows), table).collect()} == _brute(rows, areas)


def test_odd_and_missing_areas(spark):
    p = points(spark, [(1, 1.0, 1.0)])
    rows = [(1, "n", "circle", None, 1.0, 5.0, None, "z"), (2, "n", "circle", 1.0, 1.0, -1.0, None, "z"), (3, "n", "polygon", None, None, None, "POINT (1 1)", "z"), (4, "n", "polygon", None, None, None, None, "z"), (None, "n", "circle", 1.0, 1.0, 5.0, None, "z"), (5, "n", None, None, None, None, "POLYGON ((0 0, 0 0, 0 0))", "z")]
    assert inside(p, spark.createDataFrame(rows, AREA)).count() == 0
    assert inside(p, spark.createDataFrame([], AREA)).count() == 0
    assert inside(p.limit(0), spark.createDataFrame([(6, "n", "circle", 1.0, 1.0, 5.0, None, "z")], AREA)).count() == 0


def test_points_at_exactly_180_are_inside_areas_across_the_antimeridian(spark):
    boxes = {1: (179.7, 180.35), 2: (-180.35, -179.7), 3: (179.0, 180.0), 4: (-180.0, -179.0), 5: (178.0, 179.0), 6: (100.0, 260.0)}
    areas = [(i, "polygon", None, None, None, [[(x0, -19.0), (x1, -19.0), (x1, -17.0), (x0, -17.0)]]) for i, (x0, x1) in boxes.items()] + [(20, "circle", -18.0, 179.9, 30_000.0, None)]
    text = lambda ring: "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ring + ring[:1]) + "))"
    table = spark.createDataFrame([(a, "n", k, la, lo, r, text(s[0]) if s else None, "z") for a, k, la, lo, r, s in areas], AREA)
    rows = [(1, -17.98886, 180.0), (2, -17.98886, -180.0), (3, -16.0, 180.0), (4, -18.5, 179.8)]
    got = {tuple(r) for r in inside(points(spark, rows), table).collect()}
    assert got == _brute(rows, areas)
    assert {(1, 1), (1, 2), (1, 4), (1, 6), (1, 20)} <= got
