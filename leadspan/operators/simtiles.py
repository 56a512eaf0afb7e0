"""Best Dice match of every text among large groups, by tiles of texts that stand next to each other.

Texts of a group are sorted into blocks, those of a block are split again and again by the piece that tells most about the others, and
what stands together is cut into tiles of 64 texts with a bit per piece, so pieces in common are counted for many texts at once, exactly.
A tile and each quarter of it know the pieces that all of their texts have and those that any has: a text that lacks some of the first, or
has others than the second, is apart from all of them, which bounds the scores. Tiles are looked at from the highest bound down, only
as far as one may still hold a better match than what a text has. First every block looks among itself, then the blocks of a group meet
in pairs, each a task of bounded memory, with what was found as the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.session import cut_lineage

TILE, PART = 64, 16  # texts of a tile and of a part of it
WORDS = 16  # of 64 bits: this many of the most frequent pieces have a bit, others are compared one by one
BLOCK = 2**18  # texts of both sides
TASKS_PER_CORE, PER_TASK = 24, 4_000_000  # a task is a pair of blocks: many enough to be of like length, with this many pairs of texts or more
FIRST_TILES, MORE_TILES = 32, 512  # looked at in one go, each by a part of the left tile
SAMPLE = 256  # texts that choose the piece to split by
NO_ORD = np.iinfo(np.int64).max
LEFT, RIGHT = 1, 0  # right tiles of a block come first
HELD = "run long, side int, tile long, bits binary, sizes binary, ords binary, rare binary, confidence array<bigint>, best array<bigint>"
FOUND = "run long, tile long, confidence array<bigint>, best array<bigint>"


def best_by_tiles(lefts: DataFrame, rights: DataFrame, threshold: float, confidence: Callable[[Column], Column], pieces: Callable[[Column], Column], keys: Sequence[str]) -> DataFrame:
    """keys, ``text``, ``confidence``, ``ord``: as ``simjoin.best_dice``, whose choices hold here. Texts are distinct on both sides and keys not null."""
    spark = lefts.sparkSession
    no_ord = F.lit(int(NO_ORD))
    sides = lefts.select(*keys, "text", no_ord.alias("ord"), F.lit(LEFT).alias("side")).union(rights.select(*keys, "text", F.coalesce(F.col("ord").cast("bigint"), no_ord), F.lit(RIGHT)))
    texts = cut_lineage(sides)
    is_left, is_right = (F.col("side") == LEFT).cast("bigint"), (F.col("side") == RIGHT).cast("bigint")
    sizes = texts.groupBy(*keys).agg(F.sum(is_left).alias("l"), F.sum(is_right).alias("r"), F.max(F.length("text")).alias("longest"))
    n_left, n_right, pairs, longest = sizes.agg(F.sum("l"), F.sum("r"), F.sum(F.col("l").cast("double") * F.col("r")), F.max("longest")).first()
    levels = _levels(spark, 2 * max(longest or 1, 2), threshold, confidence)
    known = _frequent(texts.select(F.explode(pieces(F.col("text"))).alias("piece")))
    if not pairs:
        return lefts.select(*keys, "text", F.lit(0).cast("bigint").alias("confidence"), F.lit(0).cast("bigint").alias("ord")).limit(0)
    tasks = min(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, math.ceil(pairs / PER_TASK))
    blocks = max(math.ceil((n_left + n_right) / BLOCK), round(math.sqrt(tasks * n_left * n_right / pairs)))
    placed = texts.repartitionByRange(blocks, *keys, "text").sortWithinPartitions(*keys, "side", "text")
    cut = placed.select(*keys, "side", "text", "ord", F.spark_partition_id().alias("block"), pieces(F.col("text")).alias("pieces"))
    kinds = "".join(f"`{k}` {kind}, " for k, kind in lefts.select(*keys).dtypes)
    tiles = cut_lineage(cut.mapInArrow(_packer(known, list(keys)), f"{kinds}texts array<string>, {HELD}"))
    search = _searcher(len(known), *levels)
    held = [c.split()[0] for c in HELD.split(", ")]
    near = cut_lineage(tiles.select(*held).mapInArrow(search, FOUND))
    met = _met(tiles, keys)
    found = [near]
    if met:
        pair = spark.createDataFrame(met, "pair long, l long, r long")
        start = tiles.filter(F.col("side") == LEFT).drop("confidence", "best").join(near, ["run", "tile"])
        one = start.join(pair, F.col("run") == F.col("l")).withColumn("run", F.col("pair")).select(*held)
        two = tiles.filter(F.col("side") == RIGHT).join(pair, F.col("run") == F.col("r")).withColumn("run", F.col("pair")).select(*held)
        dealt = one.union(two).repartitionById(len(met), F.col("run").cast("int")).sortWithinPartitions("run", "side", "tile")
        found.append(cut_lineage(dealt.mapInArrow(search, FOUND)))
    rows = [x.select("tile", F.posexplode(F.arrays_zip("confidence", "best")).alias("at", "b")).filter(F.col("b.confidence").isNotNull()) for x in found]
    every = rows[0] if len(rows) == 1 else rows[0].union(rows[1])
    best = every.groupBy("tile", "at").agg(F.max(F.struct(F.col("b.confidence").alias("confidence"), (-F.col("b.best")).alias("o"))).alias("b"))
    named = tiles.filter(F.col("side") == LEFT).select(*keys, "tile", F.posexplode("texts").alias("at", "text"))
    out = named.join(best, ["tile", "at"])
    return out.select(*keys, "text", F.col("b.confidence").alias("confidence"), F.nullif(-F.col("b.o"), no_ord).alias("ord"))


def _levels(spark, most: int, threshold: float, confidence: Callable[[Column], Column]) -> tuple[np.ndarray, np.ndarray]:
    """Every confidence that a score may have, ascending, with the least score that has it: scores are 2 x common / both sizes, ``most`` at most."""
    shared = spark.range(2, most + 1).select("id", F.explode(F.sequence(F.lit(1), F.floor(F.col("id") / 2).cast("int"))).alias("n"))
    scores = shared.select((2.0 * F.col("n") / F.col("id")).alias("score"))
    rows = scores.filter(F.col("score") >= F.lit(threshold)).groupBy(confidence(F.col("score")).cast("bigint").alias("c")).agg(F.min("score").alias("s")).collect()
    rows.sort(key=lambda r: r.s)
    return np.array([r.s for r in rows], dtype=np.float64), np.array([r.c for r in rows], dtype=np.int64)


def _frequent(pieces: DataFrame) -> np.ndarray:
    counted = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return np.array([r.piece for r in counted.orderBy(F.desc("n"), "piece").limit(64 * WORDS).collect()], dtype=np.int64)


def _met(tiles: DataFrame, keys: Sequence[str]) -> list[tuple[int, int, int]]:
    """Pairs of blocks of one group, numbered: what a task looks at."""
    runs = tiles.groupBy(*keys, "run").agg(F.max("side").alias("most"), F.min("side").alias("least"))
    l = runs.filter(F.col("most") == LEFT).select(*keys, F.col("run").alias("l"))  # noqa: E741
    r = runs.filter(F.col("least") == RIGHT).select(*keys, F.col("run").alias("r"))
    both = (l.join(r, list(keys)) if keys else l.crossJoin(r)).filter(F.col("l") != F.col("r"))
    return [(i, x.l, x.r) for i, x in enumerate(both.select("l", "r").orderBy("l", "r").collect())]


def _packer(known: np.ndarray, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted texts to rows of a tile each; ``run`` numbers the part of a group that is in one block."""
    words = max(1, -(-len(known) // 64))
    order = np.argsort(known)
    sorted_known = known[order]

    def encoded(b):
        lists = b["pieces"]
        ends = lists.offsets.to_numpy()
        flat, sizes = lists.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends).astype(np.int32)
        row = np.repeat(np.arange(b.num_rows), sizes)
        at = np.minimum(np.searchsorted(sorted_known, flat), len(known) - 1)
        hit = sorted_known[at] == flat
        dense = np.zeros((b.num_rows, 64 * words), dtype=np.uint8)
        dense[row[hit], order[at[hit]]] = 1
        rare = np.split(flat[~hit], np.cumsum(np.bincount(row[~hit], minlength=b.num_rows))[:-1])
        return np.packbits(dense, axis=1, bitorder="little").view("<u8"), sizes, rare

    def packed(key, run, tile, side, block, parts):
        """One batch of all tiles of one side of a run."""
        b = pa.Table.from_batches([x for x, *_ in parts]).combine_chunks()
        bits, sizes = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
        rare = [r for x in parts for r in x[3]]
        near = _neighbours(bits)
        bits, sizes, ords, n = bits[near], sizes[near], b["ord"].to_numpy().astype(np.int64)[near], len(near)
        begins = range(0, n, TILE)
        texts = b["text"].take(pa.array(near)).combine_chunks() if side == LEFT else None
        ends = pa.array(np.append(np.arange(0, n, TILE), n), pa.int32())
        some = [np.concatenate([rare[x] for x in near[i : i + TILE]]) for i in begins]
        m = len(begins)
        same = lambda v, kind: pa.array([v] * m, kind)
        columns = {k: same(v, b.schema.field(k).type) for k, v in zip(keys, key)} | {
            "texts": pa.ListArray.from_arrays(ends, texts if not isinstance(texts, pa.ChunkedArray) else texts.chunk(0)) if side == LEFT else pa.nulls(m, pa.list_(b.schema.field("text").type)),
            "run": same((block << 32) + run, pa.int64()), "side": same(side, pa.int32()), "tile": pa.array(np.arange(m) + (block << 32) + tile, pa.int64()),
            "bits": pa.array([np.ascontiguousarray(bits[i : i + TILE].T).tobytes() for i in begins], pa.binary()), "sizes": pa.array([sizes[i : i + TILE].tobytes() for i in begins], pa.binary()),
            "ords": pa.nulls(m, pa.binary()) if side == LEFT else pa.array([ords[i : i + TILE].tobytes() for i in begins], pa.binary()),
            "rare": pa.array([x.tobytes() if len(x) else None for x in some], pa.binary()), "confidence": pa.nulls(m, pa.list_(pa.int64())), "best": pa.nulls(m, pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def pack(batches):
        now, run, tile, block, held = None, -1, 0, 0, []
        for b in batches:
            if not b.num_rows:
                continue
            block, sides, new = int(b["block"][0].as_py()), b["side"].to_numpy(), np.zeros(b.num_rows, dtype=bool)
            new[1:] |= sides[1:] != sides[:-1]
            for k in keys:
                code = b[k].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            turns = np.append(np.nonzero(new)[0], b.num_rows)
            begin = 0
            for end in turns.tolist():
                part = b.slice(begin, end - begin)
                key = tuple(part[k][0].as_py() for k in keys), int(sides[begin])
                if key != now:
                    if held:
                        yield packed(now[0], run, tile, now[1], block, held)
                        tile += -(-sum(x.num_rows for x, *_ in held) // TILE)
                    run += now is None or key[0] != now[0]
                    now, held = key, []
                held.append((part.select([*keys, "text", "ord"]), *encoded(part)))
                begin = end
        if held:
            yield packed(now[0], run, tile, now[1], block, held)

    return pack


def _neighbours(bits: np.ndarray) -> np.ndarray:
    """An order of the rows in which like ones stand together: split by the bit that tells most of the others, down to parts of a tile."""
    columns = np.ascontiguousarray(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").T)
    out, todo = [], [np.arange(len(bits))]
    while todo:
        rows = todo.pop()
        if len(rows) > PART:
            x = columns[:, rows[:: -(-len(rows) // SAMPLE)]].astype(np.float32)
            mean = x.mean(axis=1)
            if len(rows) > 2 * SAMPLE:
                mixed = np.nonzero((mean > 0) & (mean < 1))[0]
                y = x[mixed] - mean[mixed, None]
                shared = y @ y.T
                best = mixed[((shared**2).sum(axis=1) / np.diag(shared)).argmax()] if len(mixed) else 0
            else:
                best = np.abs(mean - 0.5).argmin()
            has = columns[best, rows] == 1
            if has.any() and not has.all():
                todo += [rows[~has], rows[has]]
                continue
        out.append(rows)
    return np.concatenate(out)


class _Tile:
    """Texts of one row: bits by word, sizes, and the pieces without a bit."""

    def __init__(self, bits: bytes, sizes: bytes, rare: bytes | None, words: int):
        self.sizes = np.frombuffer(sizes, dtype=np.int32)
        self.bits = np.frombuffer(bits, dtype=np.uint64).reshape(words, len(self.sizes))
        self.n_rare = self.sizes - np.bitwise_count(self.bits).sum(axis=0, dtype=np.int32)
        self.rare = np.split(np.frombuffer(rare, dtype=np.int64), np.cumsum(self.n_rare)[:-1]) if rare else None


class _Block:
    """Right tiles of one block, looked at by left tiles one after the other."""

    def __init__(self, rows: list[tuple[_Tile, np.ndarray]], words: int, breaks: np.ndarray):
        n, parts = len(rows), TILE // PART
        self.breaks, self.words = breaks, words
        bits, every = np.zeros((words, n, TILE), dtype=np.uint64), np.full((words, n, TILE), ~np.uint64(0))
        sizes, n_rare, ords = np.zeros((n, TILE), dtype=np.int32), np.zeros((n, TILE), dtype=np.int32), np.full((n, TILE), NO_ORD, dtype=np.int64)
        least = np.full((n, TILE), np.iinfo(np.int32).max, dtype=np.int32)
        self.rare = {}
        for i, (t, own) in enumerate(rows):
            m = len(t.sizes)
            bits[:, i, :m] = every[:, i, :m] = t.bits
            sizes[i, :m] = least[i, :m] = t.sizes
            n_rare[i, :m], ords[i, :m] = t.n_rare, own
            if t.rare is not None:
                self.rare[i] = t.rare
        cut = lambda x: x.reshape(*x.shape[:-1], parts, PART)
        self.bits, self.sizes, self.n_rare, self.ords = cut(bits), cut(sizes), cut(n_rare), cut(ords)
        # what no text of a part or tile has, what every one has, sizes and the first ord; a part without texts has nothing in common with any
        self.part = ~np.bitwise_or.reduce(self.bits, axis=-1), np.bitwise_and.reduce(cut(every), axis=-1), self.sizes.max(axis=-1), cut(least).min(axis=-1), self.ords.min(axis=-1)
        none, all_, most, least, first = self.part
        self.tile = np.bitwise_and.reduce(none, axis=-1), np.bitwise_and.reduce(all_, axis=-1), most.max(axis=-1), least.min(axis=-1), first.min(axis=-1)
        self.wide = np.uint8 if most.max() < 256 else np.uint16

    def _level(self, score: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.breaks, score, side="right") - 1

    def look(self, t: _Tile, level: np.ndarray, best: np.ndarray) -> bool:
        """Raises ``level`` and ``best`` (the ord) of the texts that have a better match here; whether any has."""
        none, all_, most, least, first = self.tile
        m, parts = len(t.sizes), np.arange(0, len(t.sizes), PART)
        every, some = np.bitwise_and.reduceat(t.bits, parts, axis=1)[:, :, None], np.bitwise_or.reduceat(t.bits, parts, axis=1)[:, :, None]
        small, large = np.minimum.reduceat(t.sizes, parts)[:, None], np.maximum.reduceat(t.sizes, parts)[:, None]
        apart = np.zeros((len(parts), len(most)), dtype=np.int32)
        for w in range(self.words):
            apart += np.bitwise_count((every[w] & none[w]) | (all_[w] & ~some[w]))
        both = large + most
        bound = (both - np.maximum(apart, np.maximum(small - most, least - large))) / both
        low = np.minimum.reduceat(level, parts)
        part, tile = np.nonzero(bound >= self.breaks[np.maximum(low, 0)][:, None])
        bound = bound[part, tile]
        order = np.argsort(-bound, kind="stable")
        part, tile, bound = part[order], tile[order], bound[order]
        better, at, step = False, 0, FIRST_TILES
        while at < len(part):
            p, j, b = part[at : at + step], tile[at : at + step], bound[at : at + step]
            at, step = at + step, MORE_TILES
            if better:
                low = np.minimum.reduceat(level, parts)
                keep = b >= self.breaks[np.maximum(low, 0)][p]
                p, j = p[keep], j[keep]
            rows = p[:, None] * PART + np.arange(PART)
            k, r = np.nonzero(rows < m)
            rows, j = rows[k, r], j[k]
            better |= bool(len(rows)) and self._rows(t, rows, j, level, best)
        return better

    def _open(self, bits: np.ndarray, sizes: np.ndarray, level: np.ndarray, best: np.ndarray, none, all_, most, least, first) -> np.ndarray:
        """Where a text may have a better match than it has; shapes broadcast, bits have the words in front."""
        apart = np.zeros(np.broadcast_shapes(sizes.shape, most.shape), dtype=np.int32)
        for w in range(self.words):
            apart += np.bitwise_count((bits[w] & none[w]) | (all_[w] & ~bits[w]))
        apart = np.maximum(apart, np.maximum(sizes - most, least - sizes))
        both = sizes + most
        bound = (both - apart) / both
        need = self.breaks[np.maximum(level, 0)]
        more = np.append(self.breaks, np.inf)[level + 1]
        return (bound >= more) | ((bound >= need) & (level >= 0) & (first < best))

    def _rows(self, t: _Tile, rows: np.ndarray, tiles: np.ndarray, level: np.ndarray, best: np.ndarray) -> bool:
        """Texts of the one tile, each with another tile."""
        none, all_, most, least, first = self.tile
        open_ = self._open(t.bits[:, rows], t.sizes[rows], level[rows], best[rows], none[:, tiles], all_[:, tiles], most[tiles], least[tiles], first[tiles])
        rows, tiles = rows[open_], tiles[open_]
        if not len(rows):
            return False
        none, all_, most, least, first = self.part
        some, part = np.nonzero(self._open(t.bits[:, rows, None], t.sizes[rows, None], level[rows, None], best[rows, None], none[:, tiles], all_[:, tiles], most[tiles], least[tiles], first[tiles]))
        return bool(len(some)) and self._compare(t, rows[some], tiles[some], part, level, best)

    def _compare(self, t: _Tile, rows: np.ndarray, tiles: np.ndarray, parts: np.ndarray, level: np.ndarray, best: np.ndarray) -> bool:
        """Texts of the one tile, each with a part of another."""
        common = np.zeros((len(rows), PART), dtype=self.wide)
        for w in range(self.words):
            common += np.bitwise_count(t.bits[w, rows][:, None] & self.bits[w, tiles, parts])
        both = t.sizes[rows][:, None] + self.sizes[tiles, parts]
        rare = None
        most = common
        if t.rare is not None:
            rare = np.minimum(t.n_rare[rows][:, None], self.n_rare[tiles, parts])
            most = common + rare
        i, j = np.nonzero(2.0 * most / both >= self.breaks[np.maximum(level[rows], 0)][:, None])
        shared = common[i, j].astype(np.int64)
        if rare is not None:
            for k in np.nonzero(rare[i, j])[0]:
                place = int(parts[i[k]]) * PART + int(j[k])
                shared[k] += len(np.intersect1d(t.rare[rows[i[k]]], self.rare[int(tiles[i[k]])][place], assume_unique=True))
        found, ords, row = self._level(2.0 * shared / both[i, j]), self.ords[tiles[i], parts[i], j], rows[i]
        more = (found > level[row]) | ((found >= 0) & (found == level[row]) & (ords < best[row]))
        row, found, ords = row[more], found[more], ords[more]
        order = np.lexsort((ords, -found, row))
        first = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
        level[row[first]], best[row[first]] = found[first], ords[first]
        return bool(len(first))


def _searcher(n_known: int, breaks: np.ndarray, values: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Left tiles of a run with the best of its right tiles, which come before them. Those with a start come out only if they have a better one."""
    words = max(1, -(-n_known // 64))

    def lists(parts, none):
        flat = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in parts])), pa.int32()), pa.array(flat, pa.int64(), mask=np.concatenate(none)))

    def search(batches):
        run, rights, block = None, [], None
        for b in batches:
            runs, sides, tiles = b["run"].to_pylist(), b["side"].to_pylist(), b["tile"].to_pylist()
            bits, sizes, ords, rare = b["bits"].to_pylist(), b["sizes"].to_pylist(), b["ords"].to_pylist(), b["rare"].to_pylist()
            found = []
            for i in range(b.num_rows):
                if runs[i] != run:
                    run, rights, block = runs[i], [], None
                t = _Tile(bits[i], sizes[i], rare[i], words)
                if sides[i] == RIGHT:
                    rights.append((t, np.frombuffer(ords[i], dtype=np.int64)))
                    continue
                if block is None and rights:
                    block, rights = _Block(rights, words, breaks), []
                level, best, start = np.full(len(t.sizes), -1), np.full(len(t.sizes), NO_ORD, dtype=np.int64), b["confidence"][i].values
                if start is not None:
                    has = start.is_valid().to_numpy(zero_copy_only=False)
                    level = np.where(has, np.searchsorted(values, start.fill_null(0).to_numpy()), -1)
                    best = np.where(has, b["best"][i].values.fill_null(0).to_numpy(), NO_ORD)
                better = block is not None and block.look(t, level, best)
                if better or start is None:
                    found.append((run, tiles[i], values[np.maximum(level, 0)], best, level < 0))
            if found:
                run_, tile, confidence, ord_, none = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(run_, pa.int64()), pa.array(tile, pa.int64()), lists(confidence, none), lists(ord_, none)], ["run", "tile", "confidence", "best"])

    return search
