"""Exact Dice similarity join on sets of two-letter pieces, without comparing every pair.

Dice(A, B) >= t forces |A n B| >= t/2 (|A|+|B|) and bounds |B| by |A| t/(2-t) from below and |A| (2-t)/t from
above. Put the pieces of every text in one global order, rarest first. Two texts that share at least o pieces
then share, among the first |A| - o + k pieces of A and the like for B, the k rarest pieces they have in common.
Joining on groups of k pieces drawn from those prefixes therefore loses no pair. Common pieces (a company a
third of all rows work for) sort last and hardly ever enter a prefix, so hot values do not become hot join keys.

Pairs that meet are told apart before any set is compared: by the place of the key in both orders (what comes after it bounds
the overlap) and by bit maps of the sets, which differ in at most |A| + |B| - 2 |A n B| places.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.operators.ranking import computed
from leadspan.operators.simtiles import best_by_tiles
from leadspan.session import cut_lineage, ensure_checkpoint_dir

# Stands for a text too short to have a piece; such texts match each other with 1.
NO_PIECES = -1
# Second half of a join key made of one piece only.
ALONE = -2
CODE_SPACE = 1 << 21
WORDS = ("s0", "s1", "s2", "s3")  # of a text's bit map
# Best matches are looked for by falling thresholds, unless this many pairs of texts or fewer are left.
STEPS = (0.97, 0.94, 0.91, 0.87, 0.82, 0.75)
FEW_PAIRS = 300_000_000
# Groups with more pairs of texts are looked through tile by tile.
TILED_PAIRS = 100_000


def _codes(text: Column) -> Column:
    """Distinct two-letter pieces, each as one exact number (two code points)."""
    letter = lambda i: F.ascii(text.substr(i, F.lit(1))).cast("bigint")
    codes = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: letter(i) * CODE_SPACE + letter(i + 1))
    return F.when(F.length(text) >= 2, F.array_distinct(codes)).otherwise(F.array(F.lit(NO_PIECES).cast("bigint")))


def _pieces(texts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct texts with their pieces, over all tasks: texts are few bytes but much work."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return computed(texts.select(*keys, "text").repartition(tasks, *keys, "text").distinct(), pieces=_codes(F.col("text")))


def _frequency(*sides: DataFrame) -> DataFrame:
    """(piece, n) over all sides, stored: Spark sees that a small one is small, so texts need not move to meet it."""
    found = sides[0].select("pieces")
    for more in sides[1:]:
        found = found.union(more.select("pieces"))
    counted = found.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    folder = f"{ensure_checkpoint_dir(counted.sparkSession)}/pieces-{uuid.uuid4().hex}"
    counted.write.parquet(folder)
    return counted.sparkSession.read.parquet(folder)


def _rarest_first(texts: DataFrame, frequency: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each distinct text with its ``pieces`` sorted by (frequency, piece), their number and bit map."""
    long = texts.select(*keys, "text", F.explode("pieces").alias("piece"))
    ranked = long.join(frequency, "piece").groupBy(*keys, "text").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("s"))
    pieces = ranked.select(*keys, "text", F.col("s.piece").alias("pieces"))
    return pieces.select("*", F.size("pieces").alias("n"), *_bit_map(F.col("pieces")))


def _bit_map(pieces: Column) -> list[Column]:
    """Four words with one bit per piece, by hash; pieces may share a bit."""
    place = lambda p: F.pmod(F.xxhash64(p), F.lit(64 * len(WORDS)))
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), place(p).bitwiseAND(63).cast("int"))
    none = F.lit(0).cast("bigint")
    here = lambda word: lambda bits, p: bits.bitwiseOR(F.when(F.shiftright(place(p), 6) == word, one(p)).otherwise(none))
    return [F.aggregate(pieces, none, here(word)).alias(name) for word, name in enumerate(WORDS)]


def _small(threshold: float) -> int:
    """Sets smaller than this may share fewer than two pieces with a match."""
    return math.ceil(2 / threshold - 1e-9)


def _signatures(side: DataFrame, threshold: float, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per join key of a text: pairs of prefix pieces, and single pieces where small sets are involved; ``rest`` pieces
    come after those of the key, ``before`` are the other ones that come before its last."""
    n = F.col("n")
    need = F.ceil(n * F.lit(threshold / (2 - threshold)) - F.lit(1e-9)).cast("int")
    reach = math.floor(_small(threshold) * (2 - threshold) / threshold + 1e-9)
    alone = F.lit(ALONE).cast("bigint").alias("k2")
    single = F.transform(F.slice("pieces", F.lit(1), n - need + 1), lambda a, i: F.struct(a.alias("k1"), alone, (n - i - 1).alias("rest"), F.slice("pieces", F.lit(1), i).alias("before")))
    double = F.slice("pieces", F.lit(1), F.least(n, n - need + 2))
    before = lambda i, j: F.concat(F.slice("pieces", F.lit(1), i), F.slice("pieces", i + 2, j))
    key = lambda a, b, i, j: F.struct(a.alias("k1"), b.alias("k2"), (n - i - j - 2).alias("rest"), before(i, j).alias("before"))
    pairs = F.flatten(F.transform(double, lambda a, i: F.transform(F.slice(double, i + 2, F.size(double)), lambda b, j: key(a, b, i, j))))
    none = F.array().cast("array<struct<k1:bigint,k2:bigint,rest:int,before:array<bigint>>>")
    keyed = F.concat(F.when(n <= reach, single).otherwise(none), F.when(n >= _small(threshold), pairs).otherwise(none))
    return side.select(*keys, "text", *carry, "n", *WORDS, F.inline(keyed))


def dice_join(left: DataFrame, right: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """All (left text, right text) pairs with equal ``keys`` and Dice >= threshold, once each.

    Inputs need the columns ``keys`` and ``text`` (trimmed, lower-case, non-empty); duplicates are removed first,
    so repeated texts cost nothing. Returns keys, ``left_text``, ``right_text``, ``score``.

    Rows of the join are a text, a size, a position and a bit map. A pair goes on only if the pieces of the key and those after
    it are enough for the overlap its sizes need, and if the bit maps differ in no more places than the sets may.
    """
    lt, rt = _pieces(left, keys), _pieces(right, keys)
    frequency = _frequency(lt, rt)
    return _scored(candidate_pairs(_rarest_first(lt, frequency, keys), _rarest_first(rt, frequency, keys), threshold, keys), threshold)


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    sets = computed(pairs, _a=_codes(F.col("left_text")), _b=_codes(F.col("right_text")))
    score = 2.0 * F.size(F.array_intersect("_a", "_b")) / (F.size("_a") + F.size("_b"))
    return computed(sets, score=score).drop("_a", "_b").filter(F.col("score") >= F.lit(threshold))


def best_dice(left: DataFrame, right: DataFrame, threshold: float, confidence: Callable[[Column], Column], keys: Sequence[str] = ()) -> DataFrame:
    """Of all pairs of ``dice_join`` the best for each left text: keys, ``text``, ``confidence``, ``ord``.

    ``right`` has an ``ord`` per text besides, the smaller one wins among equal confidence, which must not fall as the score
    rises. Groups of equal ``keys`` with more than ``TILED_PAIRS`` pairs of texts are looked through tile by tile (``simtiles``), the others joined.
    """
    lefts = cut_lineage(left.select(*keys, "text").distinct().dropna(subset=list(keys)) if keys else left.select("text").distinct())
    rights = cut_lineage(right.groupBy(*keys, "text").agg(F.min("ord").alias("ord")).dropna(subset=list(keys)) if keys else right.groupBy("text").agg(F.min("ord").alias("ord")))
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    a, b = count(lefts, "l"), count(rights, "r")
    sizes = (a.join(b, list(keys)) if keys else a.crossJoin(b)).withColumn("tiled", F.col("l").cast("double") * F.col("r") > TILED_PAIRS)
    sizes = cut_lineage(sizes)
    tiled = {r.tiled for r in sizes.select("tiled").distinct().collect()}
    of = lambda df, kind: df.join(sizes.filter(F.col("tiled") == kind), list(keys), "left_semi") if keys and len(tiled) > 1 else df
    tiles = best_by_tiles(of(lefts, True), of(rights, True), threshold, confidence, _codes, keys) if True in tiled else None
    if tiled == {True}:
        return tiles
    joined = _best_joined(of(lefts, False), of(rights, False), threshold, confidence, keys)
    return joined if tiles is None else tiles.union(joined)


def _best_joined(left: DataFrame, right: DataFrame, threshold: float, confidence: Callable[[Column], Column], keys: Sequence[str]) -> DataFrame:
    """``best_dice`` by falling thresholds: a text with a match of more confidence than the threshold itself has its best match
    among what was found and does not go on. So pairs far below a text's best match are never made, and long prefixes are
    made only for texts without a near match.
    """
    lt, rt = _pieces(left, keys), _pieces(right, keys)
    frequency = _frequency(lt, rt)
    a = cut_lineage(_rarest_first(lt, frequency, keys))
    b = cut_lineage(_rarest_first(rt, frequency, keys).join(right.groupBy(*keys, "text").agg(F.min("ord").alias("ord")), [*keys, "text"]))
    on, found, steps = [*keys, "text"], [], [*[t for t in STEPS if t > threshold], threshold]
    n_left, n_right = a.count(), b.count()
    while True:
        step = threshold if n_left * n_right <= FEW_PAIRS else steps.pop(0)
        pairs = _scored(candidate_pairs(a, b, step, keys, ["ord"]), step)
        scored = pairs.select(*keys, F.col("left_text").alias("text"), F.struct(confidence(F.col("score")).cast("bigint").alias("confidence"), (-F.col("ord")).alias("o")).alias("b"))
        best = scored.groupBy(*on).agg(F.max("b").alias("b"))
        if step == threshold:
            found.append(best)
            break
        settled = cut_lineage(best.filter(F.col("b.confidence") > confidence(F.lit(step)).cast("bigint")))
        found.append(settled)
        a = cut_lineage(a.join(settled, on, "left_anti"))
        n_left = a.count()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(*on, F.col("b.confidence").alias("confidence"), (-F.col("b.o")).alias("ord"))


def candidate_pairs(a: DataFrame, b: DataFrame, threshold: float, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(keys, left_text, right_text), once each: pairs that share a key and pass the bounds; all similar pairs are among them.

    ``carry``: columns of the right side that go along. A pair is taken where it meets at its two rarest common pieces, so pairs
    need no shuffle to be told apart: both sides order their pieces alike, and no other common piece comes before those.
    """
    # the rows are few but many pairs may meet: fix the number of tasks, so they are not merged by their bytes
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = []
    for side, df, more in (("l", a, ()), ("r", b, carry)):
        named = [F.col(c).alias(f"{side}_{c}") for c in ("text", "n", "rest", "before", *WORDS)]
        sides.append(_signatures(df, threshold, keys, more).select(*keys, "k1", "k2", *named, *more).repartition(tasks, *keys, "k1", "k2"))
    joined = sides[0].join(sides[1], [*keys, "k1", "k2"])
    both = F.col("l_n") + F.col("r_n")
    in_key = F.when(F.col("k2") == ALONE, 1).otherwise(2)
    enough = 2 * (in_key + F.least("l_rest", "r_rest")) >= both * threshold - 1e-9
    differ = sum((F.bit_count(F.col(f"l_{w}").bitwiseXOR(F.col(f"r_{w}"))) for w in WORDS[1:]), F.bit_count(F.col(f"l_{WORDS[0]}").bitwiseXOR(F.col(f"r_{WORDS[0]}"))))
    near = differ <= both * (1 - threshold) + 1e-9
    # where both sets are large enough for two common pieces, pairs of pieces find them
    due = (F.col("k2") != ALONE) | (F.least("l_n", "r_n") < _small(threshold))
    rarest = ~F.arrays_overlap("l_before", "r_before")
    return joined.filter(enough & near & due).filter(rarest).select(*keys, F.col("l_text").alias("left_text"), F.col("r_text").alias("right_text"), *carry)


def as_text(c: Column) -> Column:
    return F.lower(F.trim(c))
