"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t) of each other. Vectors are turned into the principal directions of
a sample, the leading ones are cut into grid cells of width eps, and all vectors are sorted by their cells (then by cells of
half and quarter width). The sequence is joined with itself by recursion over its intervals: two intervals go on, part by part,
unless the boxes around them in the leading directions are more than eps apart. Spark runs the upper part of the recursion,
round by round, down to tiles of bounded size; tasks go on inside a pair of tiles. What is left is compared vector by vector,
in single precision where that decides and in double precision within its error bound.

The sample (about ``SAMPLE_VALUES`` components) only turns the axes: any orthogonal axes give the same links, at another speed.
Every vector is sorted and joined, nothing is capped. On vectors without leading directions few intervals are apart.

Equal vectors are joined once, with their number. A task that compares a tile with others returns how many vectors each of its
vectors is linked to and a spanning forest of the links, so a dense group costs its comparisons but not its pairs as rows.

Rows: vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing, nor do vectors of different
lengths. Rows of one id are vectors of their own. Rows without an id take part; the smallest known id names a component, null
if there is none. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from leadspan.llm.texts import scratch
from leadspan.operators.graph import connected_components
from leadspan.operators.ranking import ordinals
from leadspan.session import cut_lineage

THRESHOLD = 0.9
LEADING = 8  # directions that are cut into cells
FINER = (1, 2, 4)
TILE_VALUES = 2**19  # components of one tile: 8,192 vectors of 64
TILE_BLOCKS = 16  # blocks of a tile, the smallest intervals
SEGMENT_TILES = 16  # tiles that one task compares with its own, at most
BRANCH = 8
SAMPLE_VALUES = 2**21
SLACK = 1e-9


def unit(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of length 1 in double precision, filled up with zeros."""
    m = np.zeros((len(vectors), width))
    for row, v in zip(m, vectors):
        row[: len(v)] = v
    m /= np.abs(m).max(axis=1, keepdims=True, initial=0)  # squares of huge or tiny components stay finite
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray, width: int) -> np.ndarray:
    """Orthonormal columns, leading directions first."""
    if len(sample) < 2:
        return np.eye(width)
    centred = sample - sample.mean(axis=0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1]


def _gap(lo_a, hi_a, lo_b, hi_b) -> float:
    """Distance of two boxes."""
    apart = np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0)
    return float(np.sqrt((apart * apart).sum()))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, node) with the components of the links (a, b)."""
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


class Tile:
    """Consecutive vectors of the sequence with the boxes around their blocks."""

    def __init__(self, row, axes: np.ndarray, dtype: str) -> None:
        vectors = np.frombuffer(row.data, dtype=dtype).reshape(len(row.ids), -1)
        self.at, self.ids, self.weights = row.tile, np.asarray(row.ids), np.asarray(row.weights)
        self.unit = unit(list(vectors), vectors.shape[1])
        self.single = self.unit.astype(np.float32)
        places = self.unit @ axes[: vectors.shape[1]]
        size = -(-len(self.ids) // TILE_BLOCKS)
        self.starts = list(range(0, len(self.ids), size))
        self.ends = [*self.starts[1:], len(self.ids)]
        self.lo = np.array([places[i:j].min(axis=0) for i, j in zip(self.starts, self.ends)])
        self.hi = np.array([places[i:j].max(axis=0) for i, j in zip(self.starts, self.ends)])

    def box(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        return self.lo[first:last].min(axis=0), self.hi[first:last].max(axis=0)


def joinable(a: Tile, b: Tile, i: tuple[int, int], j: tuple[int, int], eps: float) -> Iterator[tuple[int, int]]:
    """Pairs of blocks of two intervals of blocks that may hold links; each pair once if the tiles are one."""
    if a is b and i[0] >= j[1] or _gap(*a.box(*i), *b.box(*j)) > eps:
        return
    if i[1] - i[0] == 1 == j[1] - j[0]:
        yield i[0], j[0]
    elif i[1] - i[0] >= j[1] - j[0]:
        half = sum(i) // 2
        yield from joinable(a, b, (i[0], half), j, eps)
        yield from joinable(a, b, (half, i[1]), j, eps)
    else:
        half = sum(j) // 2
        yield from joinable(a, b, i, (j[0], half), eps)
        yield from joinable(a, b, i, (half, j[1]), eps)


def links_between(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of linked vectors, by pairs of blocks."""
    width = a.unit.shape[1]
    error = (width + 4) * 1.2e-7  # of a product in single precision
    eps = math.sqrt(2 - 2 * threshold) + SLACK
    for i, j in joinable(a, b, (0, len(a.starts)), (0, len(b.starts)), eps):
        left, right = slice(a.starts[i], a.ends[i]), slice(b.starts[j], b.ends[j])
        close = a.single[left] @ b.single[right].T
        x, y = np.nonzero(close >= threshold - error)
        if not len(x):
            continue
        unsure = close[x, y] < threshold + error
        x, y = x + a.starts[i], y + b.starts[j]
        linked = ~unsure
        linked[unsure] = (a.unit[x[unsure]] * b.unit[y[unsure]]).sum(axis=1) >= threshold
        if a is b and i == j:
            linked &= x < y
        if linked.any():
            yield x[linked], y[linked]


def _tiles(placed: DataFrame, width: int, axes: np.ndarray, dtype: str) -> DataFrame:
    """One row per tile: size (length of its vectors), tile, ids, weights, data, box."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        vectors = [np.frombuffer(v, dtype=dtype) for v in pdf["data"]]
        places = unit(vectors, len(vectors[0])) @ axes[: len(vectors[0])]
        return pd.DataFrame({
            "size": [key[0]], "tile": [key[1]], "ids": [pdf["node"].to_numpy()], "weights": [pdf["weight"].to_numpy()],
            "data": [b"".join(pdf["data"])], "lo": [places.min(axis=0)], "hi": [places.max(axis=0)],
        })

    tile = F.floor(F.col("node") / max(TILE_BLOCKS, TILE_VALUES // width)).alias("tile")
    return placed.select("size", tile, "node", "weight", "data").groupBy("size", "tile").applyInPandas(
        pack, "size int, tile long, ids array<long>, weights array<long>, data binary, lo array<double>, hi array<double>"
    )


def _tile_pairs(boxes: DataFrame, directions: int, eps: float) -> DataFrame:
    """(size, a, b), a <= b: pairs of tiles left by the recursion from the whole sequence down."""
    levels = [boxes.select("size", F.col("tile").alias("at"), "lo", "hi")]
    while levels[-1].groupBy("size").count().filter("count > 1").limit(1).count():
        ends = [F.array(*[fn(F.col(c)[i]) for i in range(directions)]).alias(c) for c, fn in (("lo", F.min), ("hi", F.max))]
        levels.append(cut_lineage(levels[-1].groupBy("size", F.floor(F.col("at") / BRANCH).alias("_up")).agg(*ends).withColumnRenamed("_up", "at")))
    pairs = levels[-1].select("size", F.col("at").alias("a"), F.col("at").alias("b"))
    for level in levels[-2::-1]:
        parts = [level.select("size", F.floor(F.col("at") / BRANCH).alias(side), F.col("at").alias(f"_{side}"), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}")) for side in "ab"]
        both = pairs.join(parts[0], ["size", "a"]).join(parts[1], ["size", "b"]).filter("_a <= _b")
        apart = F.transform(F.arrays_zip("lo_a", "hi_a", "lo_b", "hi_b"), lambda d: F.greatest(d["lo_a"] - d["hi_b"], d["lo_b"] - d["hi_a"], F.lit(0.0)))
        near = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x) <= eps * eps
        pairs = cut_lineage(both.filter(near).select("size", F.col("_a").alias("a"), F.col("_b").alias("b")))
    return pairs


def linked(distinct: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, key), numbers of linked vectors (node, n) and links (a, b) that span the components.

    ``distinct``: key, size, data (components as bytes of ``single`` or double precision), single, weight; nonzero and finite.
    """
    found = distinct.agg(F.max("size").alias("width"), F.count(F.lit(1)).alias("n"), F.max("single").alias("single")).first()
    width, dtype = found["width"] or 1, "<f4" if found["single"] else "<f8"
    eps = math.sqrt(2 - 2 * threshold) + SLACK
    directions = min(LEADING, width)
    # keys are SHA-256 in hex: those below a bound are a sample of its share
    share = min(1.0, SAMPLE_VALUES / width / max(1, found["n"]))
    sample = distinct if share == 1 else distinct.filter(F.col("key") < f"{int(share * 16**8):08x}")
    axes = principal_axes(unit([np.frombuffer(r["data"], dtype=dtype) for r in sample.select("data").toLocalIterator()], width), width)[:, :directions]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                places = unit([np.frombuffer(v, dtype=dtype) for v in pdf["data"]], width) @ axes
                cells = np.concatenate([np.floor(places / (eps / f)) for f in FINER], axis=1).astype(np.int32)
                yield pdf.assign(cells=list(cells))

    cut = distinct.select("key", "size", "weight", "data").mapInPandas(place, "key string, size int, weight long, data binary, cells array<int>")
    folder = scratch(distinct.sparkSession, "grid")
    ordinals(cut, [], ["size", "cells", "key"], "node").drop("cells").write.parquet(f"{folder}/placed")
    placed = distinct.sparkSession.read.parquet(f"{folder}/placed")
    _tiles(placed, width, axes, dtype).write.parquet(f"{folder}/tiles")
    # the tiles play three parts in one plan, each read by itself
    boxes, owned, met = (distinct.sparkSession.read.parquet(f"{folder}/tiles") for _ in range(3))
    pairs = _tile_pairs(boxes.select("size", "tile", "lo", "hi"), directions, eps)
    # either tile of a pair may be the one that a task keeps: turns even out their numbers
    even = (F.col("a") + F.col("b")) % 2 == 0
    tasks = pairs.select(F.col("size").alias("size"), F.when(even, F.col("a")).otherwise(F.col("b")).alias("own"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("tile"))
    tasks = tasks.withColumn("segment", F.floor(F.col("tile") / SEGMENT_TILES))
    content = ["ids", "weights", "data"]
    others = tasks.join(met.select("size", "tile", *content), ["size", "tile"])
    owners = tasks.groupBy("size", "own", "segment").agg(F.first("own").alias("tile")).join(owned.select("size", "tile", *content), ["size", "tile"])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = Tile(left.iloc[0], axes, dtype)
        counts, links = [], []
        for row in right.itertuples(index=False):
            other = own if row.tile == own.at else Tile(row, axes, dtype)
            mine, theirs, ends = np.zeros(len(own.ids), np.int64), np.zeros(len(other.ids), np.int64), []
            for x, y in links_between(own, other, threshold):
                np.add.at(mine, x, other.weights[y])
                np.add.at(theirs, y, own.weights[x])
                ends.append(forest(own.ids[x], other.ids[y]))
            counts += [(t.ids[n > 0], n[n > 0]) for t, n in ((own, mine), (other, theirs))]
            links += ends
            if links:
                links = [forest(*map(np.concatenate, zip(*links)))]
        none = np.zeros(0, np.int64)
        nodes, n = map(np.concatenate, zip(*counts)) if counts else (none, none)
        a, b = links[0] if links else (none, none)
        return pd.DataFrame({"a": np.concatenate([nodes, a]), "b": pd.array([*[None] * len(nodes), *b], dtype="Int64"), "n": pd.array([*n, *[None] * len(b)], dtype="Int64")})

    sides = [df.select(F.struct("size", "own", "segment").alias("task"), "tile", *content) for df in (owners, others)]
    results = cut_lineage(sides[0].groupBy("task").cogroup(sides[1].groupBy("task")).applyInPandas(compare, "a long, b long, n long"))
    counted = results.filter("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    return placed.select("node", "key"), counted, results.filter("b IS NOT NULL").select("a", "b").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "first_id": pdf["first_id"], "weight": pdf["weight"], "data": [np.asarray(v, "<f4" if single else "<f8").tobytes() for v in pdf["embedding"]]})

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    text = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
    keyed = rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.sha2(text, 256)))
    whole = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.any_value("embedding").alias("embedding"))
    folder = scratch(vectors.sparkSession, "vectors")
    whole.mapInPandas(packed, "key string, first_id long, weight long, data binary").write.parquet(folder)
    distinct = vectors.sparkSession.read.parquet(folder)
    size = (F.octet_length("data") / (4 if single else 8)).cast("int")
    nodes, counted, links = linked(distinct.select("key", "weight", "data", size.alias("size"), F.lit(single).alias("single")), threshold)
    components = connected_components(links)
    known = distinct.select("key", "first_id", "weight").join(nodes, "key").join(components, "node", "left").join(counted, "node", "left")
    known = cut_lineage(known.select("key", "first_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    names = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_key = known.join(names, "component").select("key", "n_links", "component_id")
    out = keyed.select("vec_id", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
