"""Nearby points and containing regions against brute force."""

import numpy as np
import pytest

from bandlens.operators import nearby

SCHEMA = "id long, lon double, lat double, extra string"
ZONES = "zone long, xs array<double>, ys array<double>, lon string"


def run(spark, points, zones, metres):
    d = spark.createDataFrame([(*p, "x") for p in points], SCHEMA)
    z = spark.createDataFrame([(*q, "clash") for q in zones], ZONES)
    return sorted(tuple(r) for r in nearby.near_and_inside(d, z, "id", "zone", "lon", "lat", "xs", "ys", metres).collect())


def brute(points, zones, metres):
    ok = sorted({(i, x, y) for i, x, y in points if None not in (i, x, y) and not np.isnan(x) and not np.isnan(y) and abs(x) <= 180 and abs(y) <= 90 and (x, y) != (0, 0)})
    out = [("near", a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and nearby.distance(a[1], a[2], b[1], b[2]) <= metres]
    for z, xs, ys in zones:
        for i, x, y in ok:
            inside = False
            n = len(xs)
            for k in range(n):
                x1, y1, x2, y2 = xs[k], ys[k], xs[(k + 1) % n], ys[(k + 1) % n]
                if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                    inside = not inside
            if inside:
                out.append(("inside", i, z))
    return sorted(out)


def test_random_points_and_zones(spark, monkeypatch):
    monkeypatch.setattr(nearby, "LEAF_POINTS", 40)
    rng = np.random.default_rng(0)
    points = [(i, 10 + x, 50 + y) for i, (x, y) in enumerate((rng.random((600, 2)) * 0.01).tolist())]
    points += [(1000 + i, 10.005, 50.005) for i in range(5)]  # one spot
    zones = [(1, [10.0, 10.004, 10.004, 10.002, 10.0], [50.0, 50.0, 50.006, 50.002, 50.006]), (2, [10.0, 10.0, 10.01, 10.01, 10.0], [50.0, 50.01, 50.01, 50.0, 50.0]), (3, [100.0, 101.0, 101.0], [0.0, 0.0, 1.0])]
    assert run(spark, points, zones, 40.0) == brute(points, zones, 40.0)


def test_edges_of_the_globe(spark):
    points = [(1, 180.0, 10.0), (2, -180.0, 10.0), (3, -179.9999, 10.0), (4, 0.0, 90.0), (5, 120.0, 89.99999), (6, -60.0, 89.99999), (7, 30.0, -90.0), (8, 30.0, -89.99995)]
    assert run(spark, points, [], 15.0) == brute(points, [], 15.0)


def test_what_is_no_location(spark):
    nan = float("nan")
    points = [(1, None, 1.0), (2, 1.0, None), (3, 0.0, 0.0), (4, 181.0, 1.0), (5, 1.0, 91.0), (6, nan, 1.0), (None, 5.0, 5.0), (7, 5.0, 5.0), (8, 5.0, 5.0), (8, 5.0, 5.0)]
    zones = [(1, None, None), (2, [1.0, 2.0], [1.0, 2.0]), (None, [4.0, 6.0, 6.0, 4.0], [4.0, 4.0, 6.0, 6.0]), (3, [4.0, 6.0, None, 6.0, 4.0], [4.0, 4.0, None, 6.0, 6.0])]
    assert run(spark, points, zones, 15.0) == [("inside", 7, 3), ("inside", 8, 3), ("near", 7, 8)]


def test_empty(spark):
    assert run(spark, [], [], 15.0) == []


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_rtree(n):
    rng = np.random.default_rng(n)
    b = rng.random((n, 2))
    boxes = np.concatenate([b, b + rng.random((n, 2)) * 0.1], 1)
    q = np.concatenate([rng.random((20, 2)), np.zeros((20, 2))], 1)
    q[:, 2:] = q[:, :2] + 0.1
    got = set(zip(*[x.tolist() for x in nearby.RTree(boxes).probe(q)]))
    want = {(i, j) for i in range(20) for j in range(n) if (boxes[j, 0] <= q[i, 2]) and (q[i, 0] <= boxes[j, 2]) and (boxes[j, 1] <= q[i, 3]) and (q[i, 1] <= boxes[j, 3])}
    assert got == want
