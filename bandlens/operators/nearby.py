"""Points near other points, and the regions that contain them, on the sphere.

A bounded sample of the locations gives a quadtree over longitude and latitude whose leaves hold
about the same number of points; a leaf is a range of Morton codes, so a location's leaf is found by
a binary search. Every location goes to the leaf it lies in and to the others that its search box
reaches (boundary replication); regions go to all leaves their bounding box meets. In each leaf an
R-tree is bulk-loaded over the points (sort-tile-recursive) and probed with the leaf's own points,
and one over the regions' boxes; hits are refined by the great-circle distance and by crossings of
the polygon's edges. A pair is reported in one leaf only: the one that holds its reference point,
the location with the smaller key.

Equal coordinates are one location in the tree, however many records share them: pairs of records
come from a join of the pairs of locations with their records, so a hot spot costs what it puts out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlens.plans.stages import staged

RADIUS = 6371008.8
#: Bounds of the sample the quadtree is made from, and of the points it aims at in a leaf.
SAMPLE, LEAF_POINTS = 50_000, 20_000
DEEPEST = 20
FANOUT = 16


def located(longitude: str, latitude: str):
    """Whether a coordinate pair is a location: finite, within the ranges, and not 0/0."""
    lon, lat = F.col(longitude), F.col(latitude)
    inside = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    return F.coalesce(inside & ~((lon == 0) & (lat == 0)), F.lit(False))


def morton(lon: np.ndarray, lat: np.ndarray, depth: int = DEEPEST) -> np.ndarray:
    """Interleaved bits of the cell of a 2^depth x 2^depth grid over the globe."""
    n = 1 << depth
    x = np.clip(((lon + 180) / 360 * n).astype(np.int64), 0, n - 1)
    y = np.clip(((lat + 90) / 180 * n).astype(np.int64), 0, n - 1)
    out = np.zeros(len(x), np.int64)
    for b in range(depth):
        out |= ((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1)
    return out


def quadtree(codes: np.ndarray, capacity: float, depth: int, smallest: int) -> np.ndarray:
    """Starts of the leaves' ranges of Morton codes: cells are split while they hold more than ``capacity`` of the sample."""
    codes = np.sort(codes)
    starts, stack = [], [(0, 0)]
    while stack:
        level, start = stack.pop()
        size = 1 << 2 * (depth - level)
        lo, hi = np.searchsorted(codes, [start, start + size])
        if hi - lo <= capacity or level >= smallest:
            starts.append(start)
        else:
            stack += [(level + 1, start + i * (size >> 2)) for i in range(4)]
    return np.sort(np.array(starts, np.int64))


def boxes_of(starts: np.ndarray, depth: int) -> np.ndarray:
    """lon0, lat0, lon1, lat1 of the leaves."""
    sizes = np.diff(np.append(starts, 1 << 2 * depth))
    x, y = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for b in range(depth):
        x |= ((starts >> (2 * b)) & 1) << b
        y |= ((starts >> (2 * b + 1)) & 1) << b
    side = np.sqrt(sizes.astype(float))
    n = float(1 << depth)
    return np.stack([x / n * 360 - 180, y / n * 180 - 90, (x + side) / n * 360 - 180, (y + side) / n * 180 - 90], 1)


def reach(lat: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """Half-widths in degrees (longitude, latitude) of a box that holds the circle of the radius around points at ``lat``."""
    angle = metres / RADIUS * (1 + 1e-9) + 1e-12
    up = np.degrees(angle)
    polar = np.abs(lat) + up >= 90
    s = np.sin(angle) / np.maximum(np.cos(np.radians(np.minimum(np.abs(lat), 89.999999999))), 1e-15)
    return np.where(polar | (s >= 1), 360.0, np.degrees(np.arcsin(np.clip(s, 0, 1)))), np.full(len(lat), up)


def distance(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Great-circle distance in metres (haversine)."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))


class RTree:
    """A bulk-loaded R-tree over boxes (x0, y0, x1, y1), probed with many boxes at once."""

    def __init__(self, boxes: np.ndarray) -> None:
        n = len(boxes)
        self.order = np.zeros(0, np.int64)
        self.levels: list[np.ndarray] = []
        if not n:
            return
        cx, cy = boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
        slices = max(1, int(np.ceil(np.sqrt(n / FANOUT))))
        strip = np.empty(n, np.int64)
        strip[np.argsort(cx, kind="stable")] = np.arange(n) * slices // n
        self.order = np.lexsort((cy, strip))
        level = boxes[self.order]
        self.levels.append(level)
        while len(level) > FANOUT:
            at = np.arange(0, len(level), FANOUT)
            level = np.concatenate([np.minimum.reduceat(level[:, :2], at), np.maximum.reduceat(level[:, 2:], at)], 1)
            self.levels.append(level)

    def probe(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, entry) pairs whose boxes meet, level by level from the root."""
        if not self.levels or not len(boxes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = np.repeat(np.arange(len(boxes)), len(self.levels[-1]))
        e = np.tile(np.arange(len(self.levels[-1])), len(boxes))
        for h in range(len(self.levels) - 1, -1, -1):
            b, p = self.levels[h][e], boxes[q]
            hit = (b[:, 0] <= p[:, 2]) & (p[:, 0] <= b[:, 2]) & (b[:, 1] <= p[:, 3]) & (p[:, 1] <= b[:, 3])
            q, e = q[hit], e[hit]
            if h:
                below = len(self.levels[h - 1])
                e = (e[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                q, e = q[e < below], e[e < below]
        return q, self.order[e]


def contains(ring_x: np.ndarray, ring_y: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie within a polygon (even-odd rule); its ring may be closed or open, in either direction."""
    x2, y2 = np.roll(ring_x, -1), np.roll(ring_y, -1)
    inside = np.zeros(len(x), bool)
    for a in range(0, len(x), 4096):  # bounds the memory for rings of many vertices
        px, py = x[a : a + 4096, None], y[a : a + 4096, None]
        crosses = (ring_y > py) != (y2 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = ring_x + (py - ring_y) / (y2 - ring_y) * (x2 - ring_x)
        inside[a : a + 4096] = (crosses & (px < at)).sum(1) % 2 == 1
    return inside


class Leaves:
    """The quadtree's leaves: where points lie and what boxes meet."""

    def __init__(self, starts: np.ndarray, depth: int = DEEPEST) -> None:
        self.starts, self.depth = starts, depth
        self.boxes = boxes_of(starts, depth)
        self.tree = RTree(self.boxes)

    def home(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, morton(lon, lat, self.depth), side="right") - 1

    def met(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) pairs; boxes that cross the antimeridian also meet the leaves on its other side."""
        parts = [self.tree.probe(boxes + np.array([s, 0, s, 0])) for s in (0, -360, 360)]
        pairs = np.unique(np.concatenate([np.stack(p, 1) for p in parts]), axis=0)
        return pairs[:, 0], pairs[:, 1]


def partition_space(points: DataFrame, metres: float, total: int) -> Leaves:
    """Leaves from a sample of at most ``SAMPLE`` locations, the first by a hash of their coordinates."""
    fraction = min(1.0, SAMPLE / max(total, 1))
    if fraction < 1:
        points = points.filter(F.pmod(F.xxhash64("lon", "lat"), F.lit(2**62)) < F.lit(max(1, int(fraction * 2**62))))
    some = points.select("lon", "lat").limit(SAMPLE * 2).toPandas()
    # A leaf is at least four search boxes high, so most points have one leaf only.
    smallest = int(np.clip(np.floor(np.log2(180 / max(4 * np.degrees(metres / RADIUS), 1e-9))), 1, DEEPEST))
    codes = morton(some["lon"].to_numpy(float), some["lat"].to_numpy(float))
    return Leaves(quadtree(codes, max(1.0, LEAF_POINTS * fraction), DEEPEST, smallest))


def near_and_inside(points: DataFrame, regions: DataFrame, key: str, region: str, lon: str, lat: str, ring_lon: str, ring_lat: str, metres: float) -> DataFrame:
    """``kind``, ``key``, ``other_id``: pairs of records at most ``metres`` apart (kind 'near', the smaller key first) and records within regions ('inside', ``other_id`` is the region).

    ``points`` has one row for each key (repeated equal rows count once); rows with a null key or without a
    location (see :func:`located`) are left out. Regions with a null key or ring, or fewer than three
    vertices, contain nothing; null vertices are skipped. Edges are straight in degrees. Circles reach
    across the antimeridian and the poles. Extra columns of either side are ignored.
    """
    spark = points.sparkSession
    members = staged(points.filter(located(lon, lat) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), (F.col(lon) + 0.0).alias("lon"), (F.col(lat) + 0.0).alias("lat")).distinct(), "members")
    spots = staged(members.groupBy("lon", "lat").agg(F.min("id").alias("spot"), F.count(F.lit(1)).alias("n")), "spots")
    leaves = partition_space(spots, metres, spots.count())
    sent = spark.sparkContext.broadcast((leaves.starts, leaves.depth))  # bounded by the sample

    def place(batches):
        tree = Leaves(*sent.value)
        for b in batches:
            x, y = b["lon"].to_numpy(), b["lat"].to_numpy()
            dx, dy = reach(y, metres)
            home = tree.home(x, y)
            row, leaf = tree.met(np.stack([x - dx, y - dy, x + dx, y + dy], 1))
            extra = leaf != home[row]
            row = np.concatenate([np.arange(len(b)), row[extra]])
            leaf = np.concatenate([home, leaf[extra]])
            yield pd.DataFrame({"leaf": leaf, "spot": b["spot"].to_numpy()[row], "lon": x[row], "lat": y[row], "own": np.arange(len(row)) < len(b)})

    def spread(batches):
        tree = Leaves(*sent.value)
        for b in batches:
            boxes = np.array([[min(x), min(y), max(x), max(y)] for x, y in zip(b["x"], b["y"], strict=True)]).reshape(-1, 4)
            row, leaf = tree.tree.probe(boxes)
            yield b.iloc[row].assign(leaf=leaf)[["leaf", "region", "x", "y"]]

    def in_leaf(key_, here: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
        here = here.sort_values(["spot"], ignore_index=True)
        x, y, spot, own = here["lon"].to_numpy(), here["lat"].to_numpy(), here["spot"].to_numpy(np.int64), here["own"].to_numpy(bool)
        out = []
        tree = RTree(np.stack([x, y, x, y], 1))
        asks = np.flatnonzero(own)
        for a in range(0, len(asks), 4096):
            q = asks[a : a + 4096]
            dx, dy = reach(y[q], metres)
            for shift in (0, -360, 360):
                near = np.ones(len(q), bool) if shift == 0 else (x[q] - dx + shift <= 180) & (x[q] + dx + shift >= -180)
                if not near.any():
                    continue
                k, dxk, dyk = q[near], dx[near], dy[near]
                i, j = tree.probe(np.stack([x[k] - dxk + shift, y[k] - dyk, x[k] + dxk + shift, y[k] + dyk], 1))
                i = k[i]
                ok = spot[i] < spot[j]
                i, j = i[ok], j[ok]
                ok = distance(x[i], y[i], x[j], y[j]) <= metres
                out.append(pd.DataFrame({"kind": "near", "a": spot[i[ok]], "b": spot[j[ok]]}))
        if len(zones) and own.any():
            px, py, pid = x[own], y[own], spot[own]
            points_tree = RTree(np.stack([px, py, px, py], 1))
            for zone, zx, zy in zip(zones["region"], zones["x"], zones["y"], strict=True):
                zx, zy = np.asarray(zx, float), np.asarray(zy, float)
                _, hit = points_tree.probe(np.array([[zx.min(), zy.min(), zx.max(), zy.max()]]))
                hit = hit[contains(zx, zy, px[hit], py[hit])]
                out.append(pd.DataFrame({"kind": "inside", "a": pid[hit], "b": zone}))
        if not out:
            return pd.DataFrame({"kind": pd.Series([], dtype=str), "a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        return pd.concat(out).drop_duplicates()

    placed = spots.mapInPandas(place, "leaf long, spot long, lon double, lat double, own boolean")
    rings = regions.filter(F.col(region).isNotNull()).select(F.col(region).cast("long").alias("region"), F.col(ring_lon).alias("x"), F.col(ring_lat).alias("y"))
    both = F.filter(F.arrays_zip("x", "y"), lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    rings = rings.withColumn("ring", both).filter(F.size("ring") >= 3).select("region", F.col("ring.x").alias("x"), F.col("ring.y").alias("y"))
    rings = rings.mapInPandas(spread, "leaf long, region long, x array<double>, y array<double>")
    found = placed.groupBy("leaf").cogroup(rings.groupBy("leaf")).applyInPandas(in_leaf, "kind string, a long, b long")
    found = staged(found, "near-inside")

    who = members.join(spots.select("lon", "lat", "spot", "n"), ["lon", "lat"]).select("id", "spot", "n")
    who = staged(who, "who")
    near = found.filter("kind = 'near'").select("a", "b")
    apart = near.join(who.select(F.col("spot").alias("a"), F.col("id").alias("x")), "a").join(who.select(F.col("spot").alias("b"), F.col("id").alias("y")), "b").select(F.least("x", "y").alias(key), F.greatest("x", "y").alias("other_id"))
    shared = who.filter("n > 1").select("id", "spot")
    together = shared.select("spot", F.col("id").alias("x")).join(shared.select("spot", F.col("id").alias("y")), "spot").filter("x < y").select(F.col("x").alias(key), F.col("y").alias("other_id"))
    inside = found.filter("kind = 'inside'").select(F.col("a").alias("spot"), F.col("b").alias("other_id")).join(who, "spot").select(F.col("id").alias(key), "other_id")
    near = apart.unionByName(together)
    return near.select(F.lit("near").alias("kind"), key, "other_id").unionByName(inside.select(F.lit("inside").alias("kind"), key, "other_id"))
