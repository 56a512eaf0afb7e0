"""Exact grouping of vectors by cosine similarity without comparing every pair.

Unit vectors with cosine >= t lie within r = sqrt(2 - 2t) of each other. Every vector joins the block of its nearest
pivot (of n vectors about the square root of n are pivots, so blocks and pivots grow alike). Vectors within r/2 of their
pivot, its core, are all within r of each other, so they form one group through the pivot and are never compared among
themselves - near-copies of one vector, however many, cost one edge each.

Cores and rims are packed into tiles of bounded size, each vector into one. Pairs of tiles meet in tasks, which compare
a core or rim with another only if the triangle inequality allows partners. Nothing is missed and nothing is sampled
away. Rows that move are tiles, so vectors without any structure cost comparisons but no copies of each vector per block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspan.operators.graph import connected_components
from leadspan.session import cut_lineage

SLACK = 1e-6
LEAST_PIVOTS = 8
MIX = 2654435761  # spreads ids over the chunks of a block
TILE_VALUES = 2**21  # components of one tile at most: 32,768 vectors of 64
LEAST_TILE, TILES = 2048, 12  # fewer rows make smaller tiles, so that there are enough tasks
SEGMENT = 4  # tiles that one task compares with its own
SCORES = 2**20  # cosines that a task holds at a time: where all are links, their pairs take a few dozen MB


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * points @ pivots.T, 0))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest node, node) with the components of the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _opened(ids, units, data) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = np.frombuffer(data, dtype="<f4").reshape(len(ids), -1).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return np.asarray(ids), np.asarray(units), m, m.astype(np.float32)


def _similar(left, right, itself: bool, threshold: float, may_meet):
    """Pairs of ids, for some rows at a time: in single precision where that decides, else in double precision.

    As many rows at a time as make ``SCORES`` cosines, so that memory is bounded also where all rows of two tiles are similar.
    """
    (ids_a, units_a, exact_a, single_a), (ids_b, units_b, exact_b, single_b) = left, right
    error = (exact_a.shape[1] + 4) * 1.2e-7  # of a product in single precision
    begins = np.nonzero(np.r_[True, units_a[1:] != units_a[:-1]])[0]
    for first, last in zip(begins, [*begins[1:], len(units_a)]):
        meets = may_meet(units_a[first : first + 1], units_b)[0]
        if itself:
            meets &= units_b >= units_a[first]
        at = np.nonzero(meets)[0]
        if not len(at):
            continue
        single_at = single_b if len(at) == len(units_b) else single_b[at]
        rows = max(1, SCORES // len(at))
        for i in range(first, last, rows):
            j = min(i + rows, last)
            close = single_a[i:j] @ single_at.T
            x, y = np.nonzero(close >= threshold - error)
            unsure = close[x, y] < threshold + error
            x, y = x + i, at[y]
            linked = ids_a[x] != ids_b[y]
            linked[unsure] &= (exact_a[x[unsure]] * exact_b[y[unsure]]).sum(axis=1) >= threshold - 1e-12
            if linked.any():
                yield ids_a[x[linked]], ids_b[y[linked]]


def _chosen_pivots(points: DataFrame, wanted: int, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of up to ``wanted`` rows that lie more than ``apart`` from each other, near ones one after another."""
    rows = points.orderBy(F.xxhash64("node_id"), "node_id").limit(wanted).collect()
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    ids, found = np.array([r["node_id"] for r in rows], dtype=np.int64), _unit(pd.Series([r["vector"] for r in rows]))
    kept: list[int] = []
    for i in range(len(found)):
        if not kept or _distances(found[i : i + 1], found[kept]).min() > apart:
            kept.append(i)
    ids, found = ids[kept], found[kept]
    chain, left = [0], np.ones(len(found), dtype=bool)
    left[0] = False
    while left.any():
        rest = np.nonzero(left)[0]
        chain.append(int(rest[_distances(found[chain[-1] :][:1], found[rest]).argmin()]))
        left[chain[-1]] = False
    return ids[chain], found[chain]


def similar_links(vectors: DataFrame, threshold: float = 0.85, tile: int | None = None) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs with cosine >= threshold.

    ``vectors``: node_id, vector (one length). Equal vectors are linked to the first of them and compared once; zero
    vectors, those with missing or infinite components and those without id match nothing. To the driver come the
    pivots and sizes of their cores and rims, the square root of the rows.
    """
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    keyed = vectors.filter(sound & F.col("node_id").isNotNull()).withColumn("_h", F.xxhash64("vector"))
    first = keyed.groupBy("_h", "vector").agg(F.min("node_id").alias("a"))
    same = keyed.join(first, ["_h", "vector"]).filter("node_id <> a").select("a", F.col("node_id").alias("b"))
    points = cut_lineage(first.select(F.col("a").alias("node_id"), F.col("vector").cast("array<float>").alias("vector")))
    total = points.count()
    reach = math.sqrt(2 - 2 * threshold)
    pivot_ids, pivots = _chosen_pivots(points, max(LEAST_PIVOTS, math.isqrt(total)), reach / 2)
    if not len(pivots):
        return same

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_unit(pdf["vector"]), pivots)
                block = d.argmin(axis=1)
                near = d[np.arange(len(pdf)), block]
                rim = near > reach / 2 - SLACK
                data = [np.asarray(v, dtype="<f4").tobytes() for v in pdf["vector"]]
                yield pd.DataFrame({"node_id": pdf["node_id"], "data": data, "unit": 2 * block + rim, "distance": near, "pivot_id": pivot_ids[block]})

    placed = cut_lineage(points.mapInPandas(place, "node_id long, data binary, unit int, distance double, pivot_id long"))
    stars = placed.filter("unit % 2 = 0 AND node_id <> pivot_id").select(F.col("pivot_id").alias("a"), F.col("node_id").alias("b"))
    # a unit is the core (2 * block) or the rim (2 * block + 1) of a block
    radius, count = np.full(2 * len(pivots), -np.inf), np.zeros(2 * len(pivots), dtype=np.int64)
    for r in placed.groupBy("unit").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["unit"]], count[r["unit"]] = r["radius"], r["n"]
    size = tile or max(1, min(TILE_VALUES // pivots.shape[1], max(LEAST_TILE, -(-total // TILES))))
    # units larger than a tile are cut into chunks, smaller ones share a tile with those after them
    chunks, start, tiles, held = np.maximum(1, -(-count // size)), np.zeros(len(count), dtype=np.int64), 0, 0
    for u, n in enumerate(count):
        if held and held + n > size:
            tiles, held = tiles + 1, 0
        start[u], held = tiles, held + n
        if chunks[u] > 1:
            tiles, held = tiles + int(chunks[u]), 0
    tiles += held > 0

    def to_tile(batches):
        for pdf in batches:
            unit, node = pdf["unit"].to_numpy(), pdf["node_id"].to_numpy()
            yield pdf.assign(tile=start[unit] + node * MIX % chunks[unit])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        return pd.DataFrame({"tile": [key[0]], "ids": [pdf["node_id"].to_numpy()], "units": [pdf["unit"].to_numpy()], "data": [b"".join(pdf["data"])]})

    spread = placed.select("node_id", "data", "unit").mapInPandas(to_tile, "node_id long, data binary, unit int, tile long")
    packed = cut_lineage(spread.groupBy("tile").applyInPandas(pack, "tile long, ids array<long>, units array<int>, data binary"))

    def may_meet(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Whether rows of the units may be similar, as a table; the cores of a block are linked already."""
        d = _distances(pivots[one // 2], pivots[many // 2])
        return (d <= radius[one][:, None] + radius[many][None, :] + reach + SLACK) & ~((one[:, None] == many[None, :]) & (one % 2 == 0)[:, None])

    of_tile = [np.nonzero((start <= t) & (t < start + chunks) & (count > 0))[0] for t in range(tiles)]

    def meetings(batches):
        for pdf in batches:
            for a in pdf["id"]:
                others = [b for b in range(a, tiles) if may_meet(of_tile[a], of_tile[b]).any()]
                # either tile of a pair may be the one that a task keeps: turns even out their numbers
                yield pd.DataFrame({"own": [a if (a + b) % 2 == 0 else b for b in others], "tile": [b if (a + b) % 2 == 0 else a for b in others]}, dtype="int64")

    spark = vectors.sparkSession
    pairs = spark.range(tiles).mapInPandas(meetings, "own long, tile long").withColumn("segment", F.floor(F.col("tile") / SEGMENT))
    content = ["ids", "units", "data"]
    # named anew, for the tiles play two parts in one plan
    kept = packed.select(F.col("tile").alias("own"), *[F.col(c).alias(f"own_{c}") for c in content])
    owners = pairs.select("own", "segment").distinct().join(kept, "own").select(F.struct("own", "segment").alias("owner"), F.col("own").alias("own_tile"), *[f"own_{c}" for c in content])
    others = pairs.join(packed, "tile").select(F.struct("own", "segment").alias("task"), "tile", *content)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = b = np.zeros(0, dtype=np.int64)
        own = left.iloc[0]
        mine = _opened(own["own_ids"], own["own_units"], own["own_data"])
        for row in right.itertuples(index=False):
            itself = row.tile == own["own_tile"]
            for x, y in _similar(mine, mine if itself else _opened(row.ids, row.units, row.data), itself, threshold, may_meet):
                x, y = _spanning(x, y)
                a, b = np.concatenate([a, x]), np.concatenate([b, y])
            a, b = _spanning(a, b)
        return pd.DataFrame({"a": a, "b": b})

    found = owners.groupBy("owner").cogroup(others.groupBy("task")).applyInPandas(compare, "a long, b long")
    return same.union(stars).union(found).distinct()


def similar_clusters(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(node_id, cluster_id) of all nodes with at least one similar node; the cluster is its smallest node."""
    return connected_components(similar_links(vectors, threshold)).select(F.col("node").alias("node_id"), F.col("component").alias("cluster_id"))
