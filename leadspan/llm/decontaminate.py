"""Benchmark decontamination with spaced seeds.

Tokens are lower-case words without outer punctuation. A spaced seed hashes the tokens of a window at the positions of a
mask and ignores the others. The two masks below together keep a hit in every window of 13 tokens with any 2 of them
substituted, which is the verification rule: an overlap is a run of aligned windows of 13 tokens with a similarity of
0.8 or more (11 equal tokens). Items of fewer than 13 tokens have to be matched by a window of their whole length: those of
8 to 12 at the same similarity, with masks of their own that each leave out one part in three (one substitution allowed) or
two in four (two allowed), so that some mask misses every allowed set of substitutions; those of fewer than 8 token by token,
with one mask of all positions. The corpus is only searched for lengths that the benchmark has.

The work on the corpus is one pass with a bit map of the benchmark's seeds, of bounded size; it only lets windows through
that may hit. What passes is cut into regions (a stretch of hits with room on both sides), equal stretches of hits are
joined to the seeds once, and each region is verified along the diagonals found, token by token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspan.llm.texts import bit_map, given_id, identity, in_bit_map, packed
from leadspan.session import cut_lineage

# Found by search: no smaller set of masks with six positions in a span of 10 or less has the property above.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW = 13
SIMILARITY = 0.8
OUTER = ".,;:!?\"'()[]{}«»“”‘’…-–—*#&%$|<>"
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9], dtype=np.uint64)


def token_hashes(text: str | None) -> np.ndarray:
    words = [w for x in (text or "").lower().split() if (w := x.strip(OUTER))]
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, dtype=np.uint64)


def least_equal(size: int) -> int:
    """Equal tokens that a window of ``size`` needs."""
    return size if size < SPAN else math.ceil(SIMILARITY * size - 1e-9)


def masks_for(length: int) -> tuple[int, tuple[tuple[int, ...], ...]]:
    """Span and masks for items of a length: together they hit whatever tokens are substituted, as many as are allowed."""
    if length >= WINDOW:
        return SPAN, MASKS
    lost = length - least_equal(length)
    parts = lost + 2
    dropped = combinations(range(parts), lost)
    return length, tuple(tuple(i for i in range(length) if i * parts // length not in out) for out in dropped)


def seed_hashes(tokens: np.ndarray, length: int, mask: int) -> np.ndarray:
    """The hash of each window under one mask of the items of a length; both are part of it."""
    span, masks = masks_for(length)
    k = len(tokens) - span + 1
    if k <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(k, min(length, WINDOW) * 16 + mask, dtype=np.uint64)
    for at, factor in zip(masks[mask], MULTIPLIERS):
        total += tokens[at : at + k] * factor
    total ^= total >> np.uint64(29)
    return total * MULTIPLIERS[0]


def overlaps(doc: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, int, int, int]]:
    """(doc start, item start, length, equal tokens) of each overlap where item token i meets doc token i + diagonal."""
    size = min(WINDOW, len(item))
    first, last = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if not size or last - first < size:
        return []
    equal = doc[first + diagonal : last + diagonal] == item[first:last]
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(sums[size:] - sums[:-size] >= least_equal(size))
    found = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > size) + 1) if len(good) else []:
        same = np.flatnonzero(equal[run[0] : run[-1] + size]) + run[0]  # an overlap begins and ends with equal tokens
        a, b = int(same[0]), int(same[-1]) + 1
        found.append((first + a + diagonal, first + a, b - a, int(sums[b] - sums[a])))
    return found


def _items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, tokens): distinct token sequences under the smallest id that has them."""

    @F.pandas_udf("array<bigint>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([token_hashes(t).view(np.int64) for t in texts], dtype=object)

    items = benchmark.select(F.col(id_column).cast("bigint").alias("item"), hashed(F.col(text_column)).alias("tokens"))
    return cut_lineage(items.filter(F.col("item").isNotNull() & (F.size("tokens") > 0)).groupBy("tokens").agg(F.min("item").alias("item")))


def _seeds(items: DataFrame) -> DataFrame:
    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, tokens in zip(batch["item"], batch["tokens"]):
                for mask in range(len(masks_for(len(tokens))[1])):
                    found = seed_hashes(np.asarray(tokens, dtype=np.int64).view(np.uint64), len(tokens), mask)
                    yield pd.DataFrame({"seed": found.view(np.int64), "item": item, "item_at": np.arange(len(found))})

    return cut_lineage(items.mapInPandas(seeds, "seed bigint, item bigint, item_at int"))


REGION = "_id bigint, _content bigint, region int, start bigint, tokens array<bigint>, core string, core_at int, hit_at array<int>, hit_seed array<bigint>"


def _regions(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """Stretches of windows that may hit a seed of items of these lengths (WINDOW: that or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kinds = [(n, mask) for n in lengths for mask in range(len(masks_for(n)[1]))]
    reach = max((masks_for(n)[0] for n in lengths), default=0)

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, content, text in zip(batch["_id"], batch["_content"], batch["text"]):
                tokens = token_hashes(text)
                seeds = [seed_hashes(tokens, *kind) for kind in kinds]
                hits = [np.flatnonzero(in_bit_map(shared.value, s)) for s in seeds]
                at = np.unique(np.concatenate([np.zeros(0, np.int64), *hits]))
                for number, run in enumerate(np.split(at, np.flatnonzero(np.diff(at) > WINDOW) + 1) if len(at) else []):
                    low, high = max(0, run[0] - WINDOW), min(len(tokens), run[-1] + reach + WINDOW)
                    inside = [(a, k) for k, h in enumerate(hits) for a in h[np.searchsorted(h, run[0]) : np.searchsorted(h, run[-1], side="right")]]
                    core = xxhash.xxh3_128_hexdigest(tokens[run[0] : run[-1] + reach].tobytes())
                    hit_seeds = np.array([seeds[k][a] for a, k in inside], dtype=np.uint64).view(np.int64)
                    out.append((key, content, number, low, tokens[low:high].view(np.int64), core, run[0] - low, [int(a - run[0]) for a, _ in inside], hit_seeds))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REGION.split(", ")])

    return cut_lineage(docs.mapInPandas(regions, REGION))


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(_id, _content, item, doc_start, item_start, length, equal): all verified overlaps; positions count tokens.

    ``_id`` and ``_content`` name the row (``texts.identity``). Null and empty texts, and an empty table on either side,
    have no overlap. Items with equal tokens are one, under their smallest id; items without an id are left out.
    """
    items = _items(benchmark, item_column, item_text_column)
    seeds = _seeds(items)
    rows = docs.select(*identity(id_column, text_column), F.col(text_column).alias("text"))
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("tokens"), F.lit(WINDOW)).alias("n")).distinct().collect())  # 13 at most
    found = _regions(rows, bit_map(seeds, "seed"), lengths)
    cores = found.groupBy("core").agg(F.first(F.arrays_zip("hit_at", "hit_seed")).alias("hits"))
    diagonals = cores.select("core", F.inline("hits")).join(seeds, F.col("hit_seed") == F.col("seed")).select("core", "item", (F.col("hit_at") - F.col("item_at")).alias("diagonal")).distinct()
    pairs = found.select("_id", "_content", "start", "tokens", "core", "core_at").join(diagonals, "core").join(items.withColumnRenamed("tokens", "item_tokens"), "item")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, content, item, start, shift, doc_tokens, item_tokens in zip(b["_id"], b["_content"], b["item"], b["start"], b["shift"], b["tokens"], b["item_tokens"]):
                for d, i, n, equal in overlaps(np.asarray(doc_tokens), np.asarray(item_tokens), shift):
                    out.append((key, content, item, start + d, i, n, equal))
            yield pd.DataFrame(out, columns=["_id", "_content", "item", "doc_start", "item_start", "length", "equal"])

    slim = pairs.select("_id", "_content", "item", "start", (F.col("core_at") + F.col("diagonal")).alias("shift"), "tokens", "item_tokens")
    return slim.mapInPandas(verify, "_id bigint, _content bigint, item bigint, doc_start bigint, item_start bigint, length bigint, equal bigint").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, and its longest overlap (the first of equal ones)."""
    found = matches(docs, benchmark, **columns)
    order = F.struct("equal", "length", -F.col("doc_start"), -F.col("item_start"))
    best = found.groupBy("_id", "item").agg(F.max_by(F.struct("doc_start", "item_start", "length", "equal"), order).alias("best"))
    return best.select(given_id("_id").alias("doc_id"), F.col("item").alias("item_id"), "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` without an overlap with any item."""
    bad = cut_lineage(matches(docs, benchmark, id_column, text_column, **columns).select("_id", "_content").distinct())
    return packed(docs, *identity(id_column, text_column)).join(bad, ["_id", "_content"], "left_anti").select("_row.*")
