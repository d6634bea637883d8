"""Similarity clusters of millions of records: cluster features, agglomeration, one assignment pass.

The cluster-feature tree is a tree of cells whose side doubles from level to level. A leaf's feature
is its count, sums, sum of squares and bounds; features of two partitions (or of a node's children)
merge by addition. Each partition sums its own leaves (the map-side half of a hash aggregate), the
shuffle merges the same leaf of all partitions. So the summary's size depends on how much of the
space is occupied, not on the number of records.

*Ward clusters* (:func:`clusters`): leaves are reduced up the tree: the features in a node of the
tree are agglomerated by Ward's criterion (nearest-neighbour chains, weighted by the counts) to a
share of their number, node by node and level by level, until at most ``max_leaves`` are left; these
are agglomerated to the clusters. Then one pass over all records assigns each to the nearest
centroid, and every partition hands over only its members nearest to each centroid.

*Linked clusters* (:func:`linked_clusters`): records are linked if they differ by less than a
tolerance in every dimension; a cluster is all records joined by links. Ward's criterion can't give
these (it cuts long chains and joins near groups), so here the same leaves are agglomerated by
links. Leaves have half the tolerance as side: records of one leaf, and of leaves that touch, are
surely linked; leaves two apart are judged by their bounds. Leaves are cut into square blocks, each
with a margin of two leaves; a task joins the leaves of its block in numpy, so what is exchanged
grows with the leaves, and a block has a bounded number of them whatever the records. What crosses
blocks is a graph of the blocks' components. Leaf pairs that their bounds leave open, and that their
block has not joined anyway, are judged by the bounds of their parts, and where these leave it open
by their different values, in blocks. The last pass assigns every record to its leaf's cluster.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandlens.plans.components import components
from bandlens.plans.stages import small, staged

EDGE = 1e-9
#: Features that the last agglomeration takes, and those a node of the tree hands on at most.
MAX_LEAVES, NODE_LEAVES = 1500, 256
#: Leaves that a block with its margin may have: its side is the largest power of 2 that allows no more.
BLOCK_LEAVES = 200_000
#: Parts of a leaf in each dimension, and different values that are compared at a time.
PARTS, BLOCK = 4, 512


def usable(df: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """Rows with a key and finite values; one row for each key is the caller's promise."""
    keep = F.col(key).isNotNull()
    for c in dims:
        keep &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e6)
    return df.filter(keep).select(key, *[F.col(c).cast("double").alias(c) for c in dims])


def leaves(rows: DataFrame, key: str, dims: list[str], side: float) -> DataFrame:
    """Features of the leaves: cell ``l0..``, ``leaf`` (the smallest key in it), ``n``, ``s0..`` sums, ``q`` sum of squares, ``lo0..``, ``hi0..``."""
    cells = [F.floor(F.col(c) / F.lit(side) + EDGE).cast("int").alias(f"l{i}") for i, c in enumerate(dims)]
    return rows.groupBy(*cells).agg(
        F.min(key).alias("leaf"), F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(dims)],
        F.sum(sum((F.col(c) * F.col(c) for c in dims[1:]), F.col(dims[0]) * F.col(dims[0]))).alias("q"),
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(dims)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(dims)],
    )


def ward(n: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Labels 0.. of at most ``k`` clusters of weighted points, by nearest-neighbour chains."""
    m = len(n)
    if m <= k:
        return np.arange(m)
    n, centre = n.astype(float).copy(), centre.astype(float).copy()
    alive, merges, chain = np.ones(m, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            d = n * n[i] / (n + n[i]) * ((centre - centre[i]) ** 2).sum(1)
            d[~alive] = np.inf
            d[i] = np.inf
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        merges.append((float(d[j]), i, j))
        centre[j] = (n[i] * centre[i] + n[j] * centre[j]) / (n[i] + n[j])
        n[j] += n[i]
        alive[i] = False
    # Chains find the merges out of order; the tree is cut after the m - k cheapest.
    parent = np.arange(m)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, i, j in sorted(merges, key=lambda x: x[0])[: m - k]:
        parent[root(i)] = root(j)
    return np.unique([root(x) for x in range(m)], return_inverse=True)[1]


def reduced(nodes: DataFrame, d: int, max_leaves: int) -> DataFrame:
    """At most ``max_leaves`` features (``n``, ``s0..``, ``q``), merged up the tree of cells by Ward's criterion.

    A node has the leaves of 8 cells a side at first and hands on at most NODE_LEAVES features; so many
    of its children's come together one level up.
    """
    names = ["n", *[f"s{i}" for i in range(d)], "q"]
    cells = [f"l{i}" for i in range(d)]
    shift = max(1, 12 // d)
    nodes = nodes.select(*cells, *names)
    total = nodes.count()

    def merger(ratio: float):
        def merge(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(cells, ignore_index=True)
            n = b["n"].to_numpy(float)
            k = int(min(NODE_LEAVES, max(1, np.floor(len(b) * ratio))))
            label = ward(n, b[[f"s{i}" for i in range(d)]].to_numpy(float) / n[:, None], k)
            first = b[cells].groupby(label).first()  # a place in the node, for the next level
            return pd.concat([first, b[names].groupby(label).sum()], axis=1)[[*cells, *names]].astype({"n": "int64"})

        return merge

    while total > max_leaves:
        up = nodes.withColumns({f"c{i}": F.shiftright(f"l{i}", shift) for i in range(d)})
        schema = ", ".join([*(f"l{i} int" for i in range(d)), "n long", *(f"s{i} double" for i in range(d)), "q double"])
        nodes = staged(up.groupBy(*[f"c{i}" for i in range(d)]).applyInPandas(merger(0.95 * max_leaves / total), schema), "nodes")
        total, shift = nodes.count(), shift + 1
    return nodes


def agglomerate(leaf_table: DataFrame, d: int, k: int, max_leaves: int = MAX_LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, mean squared distance of the members from them) of at most ``k`` clusters."""
    found = reduced(leaf_table, d, max_leaves).toPandas()  # at most max_leaves rows
    found = found.sort_values([*(f"l{i}" for i in range(d)), "n"], ignore_index=True)
    if not len(found):
        return np.zeros((0, d)), np.zeros(0)
    sums, n = found[[f"s{i}" for i in range(d)]].to_numpy(float), found["n"].to_numpy(float)
    label = ward(n, sums / n[:, None], k)
    total = np.bincount(label, n)
    centroids = np.stack([np.bincount(label, sums[:, i]) / total for i in range(d)], 1)
    return centroids, np.maximum(np.bincount(label, found["q"].to_numpy(float)) / total - (centroids**2).sum(1), 0.0)


def clusters(df: DataFrame, key: str, dims: list[str], side: float, k: int = 24, typical: int = 5, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """``cluster``, ``size``, centroid (``c_<dim>``), ``spread`` (of the merged features about the centroid), ``rank`` (1 = most typical), ``key``, ``distance``: ``typical`` rows for each cluster.

    Rows with a null key or a null, NaN or infinite value are left out; an empty table gives no rows;
    repeated rows are members of their own; ties in the distance are broken by the key.
    """
    rows = staged(usable(df, key, dims), "cluster-rows")
    d = len(dims)
    centroids, squares = agglomerate(staged(leaves(rows, key, dims, side / 2), "leaves"), d, k, max_leaves)
    kind = dict(rows.dtypes)[key]
    schema = f"cluster int, `{key}` {kind}, distance double, n long"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, n = [], np.zeros(len(centroids), np.int64)
        for b in batches:
            x = b[dims].to_numpy()
            d2 = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
            near = d2.argmin(1)
            n += np.bincount(near, minlength=len(centroids))
            best.append(pd.DataFrame({"cluster": near, key: b[key], "distance": np.sqrt(d2[np.arange(len(x)), near])}))
            best = [pd.concat(best).sort_values(["distance", key], kind="stable").groupby("cluster").head(typical)]
        if best:
            first = best[0].groupby("cluster").cumcount() == 0
            yield best[0].assign(n=np.where(first, n[best[0]["cluster"]], 0)).astype({"cluster": "int32"})

    # At most k x typical rows come out of a partition.
    near = rows.mapInPandas(assign, schema)
    of = Window.partitionBy("cluster")
    near = near.withColumn("size", F.sum("n").over(of)).withColumn("rank", F.row_number().over(of.orderBy("distance", key))).filter(F.col("rank") <= typical)
    centre = df.sparkSession.createDataFrame([(i, *map(float, c), float(np.sqrt(v))) for i, (c, v) in enumerate(zip(centroids, squares, strict=True))], "cluster int, " + ", ".join(f"`c_{c}` double" for c in dims) + ", spread double")
    return near.join(F.broadcast(centre), "cluster").select("cluster", "size", *[f"c_{c}" for c in dims], "spread", "rank", key, "distance")  # k rows


def _local(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """The smallest index reachable from each of ``m`` nodes."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_side(d: int) -> int:
    """Exponent of a block's side in leaves."""
    s = 1
    while (2 ** (s + 1) + 4) ** d <= BLOCK_LEAVES and s < 16:
        s += 1
    return s


def join_block(cells: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each leaf, the two ends of the pairs that stay open) in one block; ``own``: leaves that are not of the margin.

    Links among leaves of the margin are links too. Of a pair only the block of its lower end reports
    that it is open.
    """
    m = len(cells)
    # Leaves that touch first: most of the others are then in one component already.
    label = _local(*np.concatenate([np.zeros((2, 0), np.int64), *[np.stack(e) for e in _met(cells, 1)]], 1), m)
    ends, doubt = [np.stack([np.arange(m), label])], []
    for i, j in _met(cells, 2):
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        some = (np.maximum(lo[i] - hi[j], lo[j] - hi[i]) < tolerance).all(1)
        i, j = i[some], j[some]
        sure = (np.maximum(hi[i], hi[j]) - np.minimum(lo[i], lo[j]) < tolerance).all(1)
        doubt.append(np.stack([i[~sure], j[~sure]]))
        ends.append(np.stack([i[sure], j[sure]]))
    label = _local(*np.concatenate(ends, 1), m)
    i, j = np.concatenate([np.zeros((2, 0), np.int64), *doubt], 1)
    keep = (label[i] != label[j]) & own[i]
    return label, i[keep], j[keep]


def _met(cells: np.ndarray, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of cells whose largest distance in a dimension is ``far`` (1 or 2), each with the lower one (in the order of the cells) first.

    Few cells are all set against each other; many are found by their offsets in the order of their numbers.
    """
    m, d = cells.shape
    x = cells - cells.min(0) + 2
    base = x.max(0) + 3
    step = np.concatenate([np.cumprod(base[::-1])[::-1][1:], [1]])
    code = x @ step
    order = np.argsort(code, kind="stable")
    if m <= 5**d // 2:
        y = x[order]
        i, j = np.nonzero(np.triu((np.abs(y[:, None] - y[None]).max(2) == far), 1))
        yield order[i], order[j]
        return
    ordered = code[order]
    for o in itertools.product(range(-far, far + 1), repeat=d):
        if o > (0,) * d and max(map(abs, o)) == far:
            want = code + np.dot(o, step)
            at = np.minimum(np.searchsorted(ordered, want), m - 1)
            i = np.flatnonzero(ordered[at] == want)
            yield i, order[at[i]]


def linked_leaves(rows: DataFrame, key: str, dims: list[str], tolerance: float) -> DataFrame:
    """Leaves with ``component``, the smallest key of the linked cluster: ``l0..``, ``leaf``, ``n``, ``component``."""
    d = len(dims)
    cell = [f"l{i}" for i in range(d)]
    bounds = [f"{e}{i}" for e in ("lo", "hi") for i in range(d)]
    table = staged(leaves(rows, key, dims, tolerance / 2).select(*cell, "leaf", "n", *bounds), "leaves")
    shift, block = block_side(d), [f"b{i}" for i in range(d)]
    near = table
    for i in range(d):  # the blocks that a leaf or its margin of two lies in
        reach = F.sequence(F.shiftright(F.col(f"l{i}") - 2, shift), F.shiftright(F.col(f"l{i}") + 2, shift))
        near = near.withColumn(f"b{i}", F.explode(reach))

    def join(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("leaf", ignore_index=True)
        cells, at, name = b[cell].to_numpy(np.int64), b[block].to_numpy(np.int64), b["leaf"].to_numpy()
        own = (cells >> shift == at).all(1)
        label, i, j = join_block(cells, own, b[[f"lo{k}" for k in range(d)]].to_numpy(float), b[[f"hi{k}" for k in range(d)]].to_numpy(float), tolerance)
        # A component is named by its first leaf of the block itself.
        first = np.full(len(b), -1, np.int64)
        mine = np.flatnonzero(own)[::-1]
        first[label[mine]] = mine
        has = first[label] >= 0
        out = [
            pd.DataFrame({"kind": 0, "a": name[own], "b": name[first[label[own]]]}),
            pd.DataFrame({"kind": 1, "a": name[~own & has], "b": name[first[label[~own & has]]]}),
            pd.DataFrame({"kind": 2, "a": name[i], "b": name[j]}),
        ]
        return pd.concat(out, ignore_index=True).astype({"kind": "int32"})

    kind = dict(table.dtypes)["leaf"]
    # Few bytes but much work: partitions by the number of leaves, not by their size.
    near = near.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, table.count() // 20_000), *block)
    found = staged(near.groupBy(*block).applyInPandas(join, f"kind int, a {kind}, b {kind}"), "joined")
    label = found.filter("kind = 0").select(F.col("a").alias("leaf"), F.col("b").alias("component"))

    def named(edges: DataFrame, column: str) -> DataFrame:
        return edges.join(label.withColumnRenamed("leaf", column), column).drop(column).withColumnRenamed("component", column)

    # A leaf of a margin has its component at home.
    across = named(found.filter("kind = 1").select("a", "b").distinct(), "a")
    open_pairs = linked_pairs(rows, staged(found.filter("kind = 2").select(F.col("a").alias("a_leaf"), F.col("b").alias("b_leaf")), "leaf-doubt"), dims, tolerance, table)
    edges = across.select("a", "b").unionByName(named(named(open_pairs, "a"), "b").select("a", "b"))
    whole = staged(components(edges), "components").select(F.col("node").alias("component"), F.col("component").alias("_to"))
    out = table.select(*cell, "leaf", "n").join(label, "leaf").join(small(whole), "component", "left")
    return staged(out.withColumn("component", F.coalesce("_to", "component")).drop("_to"), "linked-leaves")


def linked_pairs(rows: DataFrame, doubt: DataFrame, dims: list[str], tolerance: float, table: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``: leaves) of the pairs (``a_leaf``, ``b_leaf``) that hold a linked pair of records.

    Only different values within reach of the other leaf's bounds count, so equal records cost nothing.
    They are summed up by the parts of a leaf; bounds of two parts decide most pairs, and values are
    compared only in parts that they leave open, in blocks of about ``BLOCK`` against ``BLOCK``, each
    giving one bit.
    """
    d, t = len(dims), F.lit(tolerance)
    cell = [f"l{i}" for i in range(d)]
    cells = [F.floor(F.col(c) / F.lit(tolerance / 2) + EDGE).cast("int").alias(f"l{i}") for i, c in enumerate(dims)]
    part = F.array(*[F.floor(F.col(c) / F.lit(tolerance / 2 / PARTS)).cast("int") for c in dims])
    wanted = doubt.select(F.col("a_leaf").alias("leaf")).unionByName(doubt.select(F.col("b_leaf").alias("leaf"))).distinct()
    wanted = table.join(small(wanted), "leaf", "left_semi").select(*cell, "leaf")
    points = rows.select(*dims, *cells).join(small(wanted), cell).select("leaf", *dims).distinct().withColumn("part", part)
    points = staged(points, "leaf-points")
    ends = lambda c: [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    parts = staged(points.groupBy("leaf", "part").agg(F.count(F.lit(1)).alias("n"), *[e for c in dims for e in ends(c)]), "leaf-parts")

    def gap(a: str, b: str, c: str) -> Column:
        return F.greatest(F.col(f"{a}_lo_{c}") - F.col(f"{b}_hi_{c}"), F.col(f"{b}_lo_{c}") - F.col(f"{a}_hi_{c}"))

    def of(me: str) -> DataFrame:
        """The parts of the pairs' one side that are within reach of the other leaf."""
        other = "b" if me == "a" else "a"
        far = table.select(F.col("leaf").alias(f"{other}_leaf"), *[F.col(f"{e}{i}").alias(f"{other}_{e}_{c}") for i, c in enumerate(dims) for e in ("lo", "hi")])
        mine = parts.select(*[F.col(c).alias(f"{me}_{c}") for c in parts.columns])
        p = doubt.join(mine, f"{me}_leaf").join(far, f"{other}_leaf")
        for c in dims:
            p = p.filter(gap(me, other, c) < t)
        return p.select("a_leaf", "b_leaf", *[f"{me}_{c}" for c in parts.columns if c != "leaf"])

    met = of("a").join(of("b"), ["a_leaf", "b_leaf"])
    sure = F.lit(True)
    for c in dims:
        met = met.filter(gap("a", "b", c) < t)
        sure &= F.greatest(f"a_hi_{c}", f"b_hi_{c}") - F.least(f"a_lo_{c}", f"b_lo_{c}") < t
    met = staged(met.select("a_leaf", "b_leaf", "a_part", "b_part", "a_n", "b_n", sure.alias("sure")), "part-pairs")
    linked = met.filter("sure").select("a_leaf", "b_leaf").distinct()
    rest = met.filter("not sure").join(linked, ["a_leaf", "b_leaf"], "left_anti")

    def chunks(me: str) -> DataFrame:
        p = rest.select("a_leaf", "b_leaf", "a_part", "b_part", f"{me}_n").join(points.select(F.col("leaf").alias(f"{me}_leaf"), F.col("part").alias(f"{me}_part"), *dims), [f"{me}_leaf", f"{me}_part"])
        chunk = F.pmod(F.xxhash64(*dims), F.ceil(F.col(f"{me}_n") / BLOCK))
        return p.groupBy("a_leaf", "b_leaf", "a_part", "b_part", chunk.alias(f"{me}_chunk")).agg(F.collect_list(F.array(*dims)).alias(f"{me}_points"))

    @F.pandas_udf("boolean")
    def any_linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            p, q = np.stack(p), np.stack(q)
            near = np.ones((len(p), len(q)), bool)
            for i in range(p.shape[1]):
                near &= np.abs(p[:, i, None] - q[None, :, i]) < tolerance
            out.append(bool(near.any()))
        return pd.Series(out, dtype=bool)

    pairs = chunks("a").join(chunks("b"), ["a_leaf", "b_leaf", "a_part", "b_part"])
    found = pairs.filter(any_linked("a_points", "b_points")).select("a_leaf", "b_leaf").unionByName(linked)
    return staged(found.select(F.col("a_leaf").alias("a"), F.col("b_leaf").alias("b")).distinct(), "leaf-links")


def linked_clusters(df: DataFrame, key: str, dims: list[str], tolerance: float, least: int = 2, most: int | None = None) -> DataFrame:
    """``head`` (the cluster's smallest key), ``size``, ``key``: every member of the linked clusters of ``least`` to ``most`` records.

    Rows as in :func:`clusters`; keys must be whole numbers and unique (of equal keys one is taken).
    """
    rows = staged(usable(df, key, dims).dropDuplicates([key]), "linked-rows")
    tree = linked_leaves(rows, key, dims, tolerance)
    sizes = tree.groupBy("component").agg(F.sum("n").alias("size")).filter(F.col("size") >= least)
    if most is not None:
        sizes = sizes.filter(F.col("size") <= most)
    cell = [f"l{i}" for i in range(len(dims))]
    kept = tree.join(sizes, "component").select(*cell, "component", "size")
    cells = [F.floor(F.col(c) / F.lit(tolerance / 2) + EDGE).cast("int").alias(f"l{i}") for i, c in enumerate(dims)]
    return rows.select(key, *cells).join(small(kept), cell).select(F.col("component").alias("head"), "size", key)
