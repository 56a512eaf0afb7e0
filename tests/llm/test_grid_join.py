import math

import numpy as np
import pytest

from leadspan.llm import grid_join
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<{}>, label int, key string, node int, a int, n int, size string, component_id int"


def plain(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: [] for i in ok}
    unit = {}
    for i in ok:
        v = np.array(rows[i][1], dtype=float)
        v = v / np.abs(v).max()
        unit[i] = v / np.sqrt(v @ v)
    for size in {len(unit[i]) for i in ok}:
        own = [i for i in ok if len(unit[i]) == size]
        m = np.array([unit[i] for i in own])
        for x, y in zip(*np.nonzero(m @ m.T >= threshold - 1e-13)):
            if x != y:
                links[own[x]].append(own[y])
    component = {}
    for i in ok:
        if i not in component:
            found, todo = {i}, [i]
            while todo:
                new = set(links[todo.pop()]) - found
                found |= new
                todo += new
            name = min((rows[j][0] for j in found if rows[j][0] is not None), default=None)
            component |= dict.fromkeys(found, name)
    out = [(v, len(links.get(i, [])), component.get(i, v)) for i, (v, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "k", 2, 3, 4, "s", 5) for i, v in rows], SCHEMA.format(kind)).repartition(3)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.1")])
def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(QUERIES["op12_embedding_near_dedup"](spark, sf)) == plain(rows)


def crowd(rng, n, width=24):
    """Copies, chains and a dense group among scattered vectors of few leading directions."""
    scale = np.concatenate([[8, 5, 3], np.ones(width - 3)])
    rows = [rng.normal(size=width) * scale for _ in range(n)]
    rows += [rows[0].copy() for _ in range(n // 3)]
    rows += [rows[1] + 0.3 * rng.normal(size=width) for _ in range(n // 3)]
    step = [rows[2]]
    for _ in range(30):
        step.append(step[-1] + 0.7 * rng.normal(size=width))
    return [(i * 7 % 10007, [float(np.float32(x)) for x in v]) for i, v in enumerate([*rows, *step])]


def test_small_tiles(spark, monkeypatch):
    """Many tiles, several segments and rounds of the recursion."""
    monkeypatch.setattr(grid_join, "TILE_VALUES", 24 * 32)
    monkeypatch.setattr(grid_join, "SEGMENT_TILES", 3)
    monkeypatch.setattr(grid_join, "BRANCH", 3)
    rows = crowd(np.random.default_rng(4), 700)
    assert found(grid_join.near_duplicates(frame(spark, rows))) == plain(rows)


def test_intervals_are_skipped(monkeypatch):
    """Where directions lead, most pairs of blocks are provably apart, and none that holds a link is."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    m = grid_join.unit(list(np.repeat(centres, 50, axis=0) + 0.05 * rng.normal(size=(2000, 16))), 16)
    axes = grid_join.principal_axes(m, 16)[:, :8]
    order = np.lexsort(np.floor(m @ axes / 0.447).T[::-1])
    row = type("Row", (), {"tile": 0, "ids": np.arange(2000), "weights": np.ones(2000, int), "data": m[order].astype("<f8").tobytes()})
    monkeypatch.setattr(grid_join, "TILE_BLOCKS", 100)
    tile = grid_join.Tile(row, axes, "<f8")
    pairs = list(grid_join.joinable(tile, tile, (0, 100), (0, 100), math.sqrt(0.2)))
    assert len(pairs) < 0.25 * 100 * 101 / 2
    got = {(x, y) for xs, ys in grid_join.links_between(tile, tile, 0.9) for x, y in zip(xs.tolist(), ys.tolist())}
    x, y = np.nonzero(np.triu(tile.unit @ tile.unit.T >= 0.9, 1))
    assert got == set(zip(x.tolist(), y.tolist()))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.5])]
    rows += [(None, [1.0, 0.25]), (None, None), (None, [0.0, 1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e30, 1e29]), (12, [1e-30, 0.0]), (5, [3.0]), (13, [-0.0, 2.0]), (14, [0.0, 2.0]), (9, [-5.0, 1.0])]
    assert found(grid_join.near_duplicates(frame(spark, rows, kind))) == plain(rows)
    assert grid_join.near_duplicates(frame(spark, [], kind)).collect() == []
    assert found(grid_join.near_duplicates(frame(spark, [(1, None), (2, [0.0])], kind))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_the_threshold_belongs_to_the_links(spark):
    """Cosines of 0.9 and next to it, where single precision cannot tell."""
    rows = []
    for i, delta in enumerate([0, 1e-6, -1e-6, 3e-8, -3e-8]):
        c = 0.9 + delta
        rows += [(100 * i, [0.0] * i * 2 + [1.0, 0.0] + [0.0] * (8 - 2 * i)), (100 * i + 1, [0.0] * i * 2 + [c, math.sqrt(1 - c * c)] + [0.0] * (8 - 2 * i))]
    got = {r.vec_id: r.n_links for r in grid_join.near_duplicates(frame(spark, rows, "double")).collect()}
    assert [got[100 * i] for i in (1, 2, 3, 4)] == [1, 0, 1, 0]
