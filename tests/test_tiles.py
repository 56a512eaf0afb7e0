"""Best matches by tiles of texts, against brute force, and how little of all pairs they look at."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadspan.operators import simjoin, simtiles
from leadspan.operators.simjoin import best_dice

WORDS = ["acme", "globex", "ada", "grace", "hopper", "turing", "labs", "x", "99", "corp", "žluťoučký", "数据公司", "😀x"]


def dice(a, b):
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} or {None} for s in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def some(rng, n):
    names = [" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) + rng.choice(["", "s", " 1", " 2", " 12"]) for _ in range(n)]
    return [*names, "a", "b", "ab"]


def brute(left, right, threshold, level):
    out = {}
    for g, a in set(left):
        hits = [(-level(dice(a, b)), o) for h, b, o in right if g is not None and h == g and dice(a, b) >= threshold]
        if hits:
            out[g, a] = (-min(hits)[0], min(hits)[1])
    return out


@pytest.fixture
def tiled(monkeypatch):
    monkeypatch.setattr(simjoin, "TILED_PAIRS", 0)


@pytest.mark.parametrize(("threshold", "words"), [(0.5, 1), (0.8, 16)])
def test_best_matches_by_tiles_are_those_of_brute_force(spark, tiled, monkeypatch, threshold, words):
    monkeypatch.setattr(simtiles, "WORDS", words)  # with one word most pieces have no bit
    monkeypatch.setattr(simtiles, "PER_TASK", 30_000)
    rng = random.Random(8)
    group = lambda: rng.choice(["t0", "t1", None])
    left = [(group(), x) for x in some(rng, 500)] * 2
    right = [(group(), x, rng.randrange(10**6)) for x in some(rng, 500)] + [("t2", "ada", 1)]
    lefts, rights = spark.createDataFrame(left, "g string, text string"), spark.createDataFrame(right, "g string, text string, ord long")
    for fine in (20, 100):
        got = {(r.g, r.text): (r.confidence, r.ord) for r in best_dice(lefts, rights, threshold, lambda s: F.floor(s * fine + 0.5), ["g"]).collect()}
        want = brute(left, right, threshold, lambda s: math.floor(s * fine + 0.5))
        assert want and got == want


def test_large_groups_go_by_tiles_and_small_ones_are_joined(spark, monkeypatch):
    rng = random.Random(9)
    left = [("large", x) for x in some(rng, 300)] + [("small", x) for x in some(rng, 20)]
    right = [(g, x, i) for i, (g, x) in enumerate(left[::-1])]
    monkeypatch.setattr(simjoin, "TILED_PAIRS", 5000)
    seen = []
    whole = simjoin.best_by_tiles
    monkeypatch.setattr(simjoin, "best_by_tiles", lambda l, r, *more: (seen.append({x.g for x in l.select("g").distinct().collect()}), whole(l, r, *more))[1])  # noqa: E741
    lefts, rights = spark.createDataFrame(left, "g string, text string"), spark.createDataFrame(right, "g string, text string, ord long")
    got = {(r.g, r.text): (r.confidence, r.ord) for r in best_dice(lefts, rights, 0.6, lambda s: F.floor(s * 100), ["g"]).collect()}
    assert got == brute(left, right, 0.6, lambda s: math.floor(s * 100)) and seen == [{"large"}]


def test_few_tiles_are_compared(monkeypatch):
    """A text meets the tiles that stand near what it matches, not all; nothing is lost by it."""
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 9))) for _ in range(30)]
    texts = sorted(" ".join((a, b, c)) + rng.choice(["", "s"]) for a in parts for b in parts for c in parts[:10])
    rows = [{"side": s, "text": x, "ord": i % 7, "block": 0, "pieces": sorted({ord(a) * 2**21 + ord(b) for a, b in zip(x, x[1:])})} for s in (simtiles.RIGHT, simtiles.LEFT) for i, x in enumerate(texts)]
    known = np.array(sorted({p for r in rows for p in r["pieces"]}))[: 64 * simtiles.WORDS]
    kinds = pa.schema([("side", pa.int32()), ("text", pa.string()), ("ord", pa.int64()), ("block", pa.int32()), ("pieces", pa.list_(pa.int64()))])
    tiles = list(simtiles._packer(known, [])(pa.RecordBatch.from_pylist(rows[i : i + 5000], kinds) for i in range(0, len(rows), 5000)))
    compared, whole = [], simtiles._Block._compare

    def counted(self, t, at, *more):
        compared.append(len(at) * simtiles.PART)
        return whole(self, t, at, *more)

    monkeypatch.setattr(simtiles._Block, "_compare", counted)
    found = list(simtiles._searcher(len(known), np.arange(65, 101) / 100, np.arange(65, 101))(tiles))
    assert {c for b in found for r in b["confidence"].to_pylist() for c in r} == {100}
    assert sum(b.num_rows for b in found) == sum(1 for t in tiles for s in t["side"].to_pylist() if s == simtiles.LEFT)
    assert sum(compared) < len(texts) ** 2 / 8


def test_texts_without_a_match_and_empty_sides(spark, tiled):
    one = spark.createDataFrame([("ada acme",), ("zz",)], "text string")
    other = spark.createDataFrame([("ada acme", 7), ("ada acme", 3), ("quux", 1)], "text string, ord long")
    level = lambda s: F.floor(s * 100)
    assert [tuple(r) for r in best_dice(one, other, 0.65, level).collect()] == [("ada acme", 100, 3)]
    assert not best_dice(one.limit(0), other, 0.65, level).collect() and not best_dice(one, other.limit(0), 0.65, level).collect()
