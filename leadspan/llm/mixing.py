"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is the mean number of copies r of each of its documents, at most ``most_repeats``. Every
document is taken floor(r) times; whether it is taken once more is drawn with probability r - floor(r) so that for each
source the number of documents and the number of words both stay at their expectation.

The cube method moves the vector of inclusion probabilities inside the null space of the constraints until coordinates
reach 0 or 1. With two constraints (documents, words) three open documents always have a direction to move along, and
every move settles at least one of them; a block of any size ends with at most two open documents, and since large
documents are pushed first, with small ones. Blocks run in
parallel, the few open documents of all blocks are gathered into new blocks, and so on until one block per source is
left. Its last documents are the landing problem: of all their outcomes the one nearest to the balanced totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.llm.texts import NO_ID, given_id, known_id, packed, word_count
from leadspan.operators.ranking import ordinals
from leadspan.session import cut_lineage

WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3.0
BLOCK_UNITS = 4096  # documents that one task settles at a time, on average
SETTLED = 1e-9
LANDING = 12  # smallest open documents of a source that the landing decides over, with what the flight leaves
WORDS_FIRST = 4.0
AT_ONCE = 128  # open documents that the flight moves together


def unit_draw(seed: int, *names: object) -> float:
    """A number in [0, 1) fixed by the seed and names."""
    digest = hashlib.blake2b(repr((seed, *names)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2**64


def flight(sizes: Sequence[float], chances: Sequence[float], draws: Callable[[int], float], counts: Sequence[float] | None = None) -> np.ndarray:
    """Cube flight over one block: chances moved to 0 or 1, but for at most two, with the totals of counts and sizes kept.

    Entries should come in descending size: ``AT_ONCE`` open ones are held at a time and the largest that can move is
    pushed, along the projection of its axis on the null space, so that what stays open in the end is small.
    ``draws(i)`` is the i-th random number. ``counts`` are the documents each entry stands for, 1 by default.
    """
    p = np.array(chances, dtype=float)
    n = np.ones(len(p)) if counts is None else np.asarray(counts, dtype=float)
    w = np.asarray(sizes, dtype=float) / max(np.max(sizes, initial=0.0), 1.0)
    fixed = (p <= SETTLED) | (p >= 1 - SETTLED)
    p[fixed] = np.round(p[fixed])
    waiting, used = np.flatnonzero(~fixed), 0
    active, waiting = waiting[:AT_ONCE], waiting[AT_ONCE:]
    while len(active):
        rows = np.stack([n[active], w[active]])
        (nn, nw), (_, ww) = rows @ rows.T
        within = nn * ww - nw * nw
        # where all have the same size per document, keeping their number keeps the words
        inverse = np.array([[ww, -nw], [-nw, nn]]) / within if within > 1e-10 * nn * ww else np.array([[1 / nn, 0.0], [0.0, 0.0]])
        free = 1 - (rows * (inverse @ rows)).sum(axis=0)  # how far each axis lies in the null space
        able = np.flatnonzero(free > 1e-7)
        if len(active) < 3 and not len(able):
            break
        k = able[0]
        u = -(rows[:, k] @ inverse @ rows)
        u[k] += 1
        u[np.abs(u) < 1e-12] = 0
        at, up = p[active], u > 0
        moving = u != 0
        forth = np.min(np.where(up, 1 - at, at)[moving] / np.abs(u[moving]))
        back = np.min(np.where(up, at, 1 - at)[moving] / np.abs(u[moving]))
        at = at + u * (forth if draws(used) * (forth + back) < back else -back)
        used += 1
        done = (at <= SETTLED) | (at >= 1 - SETTLED)
        p[active] = np.where(done, np.round(at), at)
        room = AT_ONCE - int((~done).sum())
        active, waiting = np.concatenate([active[~done], waiting[:room]]), waiting[room:]
    return p


def landing(sizes: Sequence[float], chances: Sequence[float], counts: Sequence[float]) -> np.ndarray:
    """Settles the last open entries: of all their outcomes the one nearest to the balanced totals of words and documents.

    An error of a mean document's words weighs ``WORDS_FIRST`` times an error of a document.
    """
    p = np.array(chances, dtype=float)
    free = np.flatnonzero((p > 0) & (p < 1))
    if not len(free):
        return p
    size, count, chance = np.asarray(sizes, dtype=float)[free], np.asarray(counts, dtype=float)[free], p[free]
    outcomes = (np.arange(2 ** len(free))[:, None] >> np.arange(len(free)) & 1).astype(float)
    words, documents = np.abs((outcomes - chance) @ size), np.abs((outcomes - chance) @ count)
    p[free] = outcomes[np.argmin(WORDS_FIRST * words / max(1.0, size.mean()) + documents)]
    return p


def settle_last(sizes: np.ndarray, chances: np.ndarray, draws: Callable[[int], float], counts: np.ndarray) -> np.ndarray:
    """The last block of a source, in descending size: its smallest open entries wait for the landing, the flight moves the others."""
    held = np.flatnonzero((chances > SETTLED) & (chances < 1 - SETTLED))[-LANDING:]
    p = np.array(chances, dtype=float)
    flown = np.setdiff1d(np.arange(len(p)), held)
    p[flown] = flight(sizes[flown], p[flown], draws, counts[flown])
    return landing(sizes, p, counts)


def source_targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): all sizes times ``share``, split by weight; a target above ``most_repeats`` times its
    source's size stops there and the excess is shared again by weight, until none is above.

    Sources by code point (Spark orders strings by their UTF-8 bytes), null last, take the weights in turn. Sources without
    words have target 0.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("_null", F.col("source").isNull())
    ranked = ordinals(sizes, [], ["_null", "source"], "_rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    open_ = cut_lineage(ranked.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * most_repeats).alias("most")))
    total = open_.agg(F.sum("source_size")).first()[0]
    if not total:
        return open_.select("source", "source_size", F.lit(0.0).alias("target"))
    capped = F.lit(False)
    level = 0.0
    while True:
        left, weight = open_.agg(
            F.lit(float(total) * share) - F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        if weight <= 0 or left / weight <= level:
            break
        level = left / weight
        capped = F.col("weight") * level > F.col("most")
    return open_.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def _settle(units: DataFrame, block: Column, seed: int, last: bool) -> DataFrame:
    """One round: every block of a source is moved by itself."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_words=rows["size"] * rows["n"]).sort_values(["_words", "_draw", "_id", "size"], ascending=[False, True, True, True])
        name = (rows["source"].iloc[0], int(rows["_block"].iloc[0]), len(rows), int(rows["_draw"].iloc[0]))
        counts, sizes = rows["n"].to_numpy(float), rows["size"].to_numpy(float) * rows["n"].to_numpy(float)
        rows["chance"] = (settle_last if last else flight)(sizes, rows["chance"].to_numpy(float), lambda i: unit_draw(seed, *name, i), counts)
        return rows[[f.split()[0] for f in UNIT.split(", ")]]

    return units.withColumn("_block", block).groupBy("source", "_block").applyInPandas(run, UNIT)


UNIT = "source string, _id bigint, size bigint, n bigint, _draw bigint, chance double"


def copies(docs: DataFrame, size: Column | None = None, id_column: str = "doc_id", source_column: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.0, most_repeats: float = MOST_REPEATS, seed: int = 0, block_units: int = BLOCK_UNITS) -> DataFrame:
    """(source, doc_id, size, source_size, target, copies, n) per unit: the n rows with equal id, source and size share their fate.

    Null texts have size 0; documents of size 0 are balanced by number only. An empty table gives no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    named = docs.select(F.col(source_column).cast("string").alias("source"), known_id(id_column).alias("_id"), size.cast("bigint").alias("size"))
    units = cut_lineage(named.groupBy("source", "_id", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = cut_lineage(source_targets(units, weights, share, most_repeats))
    mean = F.when(F.col("source_size") > 0, F.least(F.lit(most_repeats), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    placed = units.join(targets, units["source"].eqNullSafe(targets["source"])).select(units["*"], "source_size", "target", mean.alias("_mean"))
    placed = cut_lineage(placed.withColumn("_whole", F.floor(F.col("_mean") + SETTLED)).withColumn("_draw", F.xxhash64(F.lit(seed), "_id", "size", "source")))
    todo = placed.select("source", "_id", "size", "n", "_draw", F.greatest(F.lit(0.0), F.col("_mean") - F.col("_whole")).alias("chance")).filter(F.col("chance") > SETTLED)
    once_more = placed.select("source", "_id", "size").limit(0)
    while True:
        most = todo.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if not most:
            break
        last = most <= block_units
        blocks = -(-most // block_units)
        moved = cut_lineage(_settle(todo, F.lit(0) if last else F.pmod(F.col("_draw"), F.lit(blocks)), seed, last))
        once_more = once_more.union(moved.filter(F.col("chance") >= 1).select("source", "_id", "size"))
        todo = moved.filter((F.col("chance") > 0) & (F.col("chance") < 1))
        if last:
            break
    more = once_more.select(F.col("source").alias("_s"), F.col("_id").alias("_d"), F.col("size").alias("_z"), F.lit(1).alias("_more"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_id") == F.col("_d")) & (F.col("size") == F.col("_z"))
    return placed.join(more, same, "left").select(
        "source", given_id("_id").alias("doc_id"), "size", "source_size", "target", (F.col("_whole") + F.coalesce("_more", F.lit(0))).alias("copies"), "n"
    )


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, with its own columns."""
    size = word_count(F.col(text_column))
    taken = copies(docs, size, id_column, source_column, **options).filter("copies > 0").withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    taken = taken.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("size").alias("_z"), F.col("copies").cast("int").alias("_copies"))
    rows = packed(docs, F.col(source_column).cast("string").alias("_source"), known_id(id_column).alias("_id"), size.alias("_size"))
    joined = rows.join(taken, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_id") == F.col("_d")) & (F.col("_size") == F.col("_z")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def taken_words(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words taken, repeats counted), copies."""
    units = copies(docs, word_count(F.col(text_column)), id_column, source_column, **options)
    rows = units.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
