"""Merkle manifest of a corpus, with the proofs of all documents made by octopus multiproofs.

Per source the documents, in ascending id, are the leaves of a tree; every ``RUN`` consecutive nodes (the last run may be
shorter, even one) become the hash of their digests, until one is left. The roots of the sources, in order of source (null
first, by UTF-8 bytes), are the leaves of the top tree in the same way. A digest is the lowercase hex SHA-256.

Leaves are numbered by a range sort, so that no source has to fit a task, and kept as rows of one block of ``BLOCK`` leaves.
Above them two levels are made at a time from groups of ``BLOCK`` nodes, each round ``BLOCK`` times smaller.

A proof holds the other nodes of each run on a leaf's way to the root. Leaf partitions (consecutive blocks) do not fetch
these one by one. Each works out the coordinates that the proofs of all its leaves need and that do not follow from its own
leaves: the minimal union. One join fetches them. The partition then derives the inner nodes its leaves share and expands
the proofs. Coordinates near a root are wanted by many partitions; their requests are salted by the number of leaves below
them, so that no key of that join meets more than about ``ASKERS`` requests.

Rows: a null in any column is hashed as ``-``. Rows of null id come first in their source and rows of one id in the order of
their leaves (equal rows have equal digests, and either order gives the same tree). Documents without a source form one. Empty
and blank texts are texts like any other. An empty table has no sources, no root and no rows. Columns other than the five
hashed ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.llm.texts import given_id, known_id, scratch
from leadspan.operators.ranking import ordinals
from leadspan.session import cut_lineage

RUN = 16
BLOCK = RUN * RUN
PART_LEAVES = 8 * BLOCK  # leaves of one leaf partition, about
ASKERS = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # number of the tree over the sources
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: ``-`` for a null field, else its bytes in UTF-8, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _runs(digests: Column) -> Column:
    """Digests of the runs of an array of digests."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / RUN).cast("int")), lambda r: F.sha2(F.array_join(F.slice(digests, r * RUN + 1, F.lit(RUN)), ""), 256))


def _group_top(n: Column, below: Column, runs: Column) -> Column:
    """Two levels above a group, or the root of its tree if the ``n`` nodes of that level are few: the last group of a larger
    tree is hashed twice even if it is a single node."""
    return F.when(n == 1, below[0]).when(n <= RUN, runs[0]).otherwise(F.sha2(F.array_join(runs, ""), 256))


@dataclass(frozen=True)
class Manifest:
    """``sources``: tree, source, leaves, start, subroot. ``blocks``: part, tree, block, leaves, ids, digests, claims.
    ``nodes``: tree, level, at, leaves, digest of every node from the blocks' roots up and of the whole top tree."""

    sources: DataFrame
    blocks: DataFrame
    nodes: DataFrame
    n_sources: int
    n_leaves: int
    root: str | None


def _climb(groups: DataFrame, with_leaves: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, digest of its root) and its inner nodes, from groups (tree, at, n, leaves, below) of up to BLOCK consecutive
    leaves; ``n`` nodes has the tree at the level of ``below``. Leaves and the level above follow from the blocks of leaves;
    they are among the nodes only ``with_leaves``."""
    tops, nodes, level = [], [], 0
    while True:
        made = groups.withColumn("runs", _runs(F.col("below")))
        if level or with_leaves:
            for up, column, wide, inner in ((0, "below", BLOCK, made), (1, "runs", RUN, made.filter("n > 1"))):
                each = inner.select("tree", "leaves", "at", F.posexplode(column).alias("_i", "digest"))
                nodes.append(each.select("tree", F.lit(level + up).cast("bigint").alias("level"), (F.col("at") * wide + F.col("_i")).alias("at"), "leaves", "digest"))
        made = made.withColumn("digest", _group_top(F.col("n"), F.col("below"), F.col("runs")))
        tops.append(made.filter(F.col("n") <= BLOCK).select("tree", "digest"))
        more = cut_lineage(made.filter(F.col("n") > BLOCK).select("tree", "at", F.ceil(F.col("n") / BLOCK).alias("n"), "leaves", "digest"))
        if more.isEmpty():
            return reduce(DataFrame.union, tops), nodes
        digests = F.array_sort(F.collect_list(F.struct("at", "digest"))).getField("digest")
        groups = more.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("_group")).agg(F.first("n").alias("n"), F.first("leaves").alias("leaves"), digests.alias("below")).withColumnRenamed("_group", "at")
        level += 2


def build(leaves: DataFrame, part_leaves: int = PART_LEAVES) -> Manifest:
    """The manifest of ``leaves``: _id (bigint, not null), source, leaf, claim (another digest to verify instead, or null)."""
    spark = leaves.sparkSession
    folder = scratch(spark, "manifest")
    ordinals(leaves, [], ["source", "_id", "leaf"], "_g").write.parquet(f"{folder}/leaves")
    placed = spark.read.parquet(f"{folder}/leaves")
    ranges = placed.groupBy("source").agg(F.min("_g").alias("start"), F.count(F.lit(1)).alias("leaves"))
    trees = cut_lineage(ordinals(ranges, [], ["start"], "tree"))
    named = placed.withColumnRenamed("source", "_source")
    numbered = named.join(trees, F.col("_source").eqNullSafe(F.col("source")))
    rows = F.array_sort(F.collect_list(F.struct("_g", "_id", "leaf", "claim")))
    grouped = numbered.groupBy("tree", "start", "leaves", F.floor((F.col("_g") - F.col("start")) / BLOCK).alias("block")).agg(rows.alias("_rows"))
    part = F.floor((F.col("start") + F.col("block") * BLOCK) / part_leaves)
    grouped.select(
        part.alias("part"), "tree", "block", "leaves", *[F.col("_rows").getField(n).alias(c) for n, c in (("_id", "ids"), ("leaf", "digests"), ("claim", "claims"))]
    ).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    roots, inner = _climb(blocks.select("tree", F.col("block").alias("at"), F.col("leaves").alias("n"), "leaves", F.col("digests").alias("below")), False)
    subroots = cut_lineage(roots)
    counted = trees.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves")).first()
    ordered = F.array_sort(F.collect_list(F.struct("tree", "digest"))).getField("digest")
    top = subroots.groupBy(F.floor(F.col("tree") / BLOCK).alias("at")).agg(ordered.alias("below"))
    of_all = [F.lit(v).cast("bigint").alias(n) for n, v in (("tree", TOP), ("n", counted["n"]), ("leaves", counted["leaves"]))]
    top_root, upper = _climb(top.select(*of_all, "at", "below"), True)
    root = top_root.first()
    reduce(DataFrame.union, [*upper, *inner]).write.parquet(f"{folder}/nodes")
    sources = trees.join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    return Manifest(sources, blocks, spark.read.parquet(f"{folder}/nodes"), counted["n"], counted["leaves"], root["digest"] if root else None)


def widths(n: int) -> list[int]:
    """Nodes of each level of a tree of n leaves, from the leaves to the root."""
    found = [n]
    while found[-1] > 1:
        found.append(-(-found[-1] // RUN))
    return found


def missing(held: dict[int, np.ndarray], n: int) -> Iterator[tuple[int, int]]:
    """Minimal union of (level, at) that, beside the ``held`` nodes (level: sorted places), gives every node on their way to
    the root of a tree of ``n`` leaves and all their siblings."""
    known = np.zeros(0, dtype=np.int64)
    for level, width in enumerate(widths(n)[:-1]):
        known = np.union1d(known, held.get(level, known[:0]))
        runs = np.unique(known // RUN)
        wanted = (runs[:, None] * RUN + np.arange(RUN)).ravel()
        yield from ((level, int(at)) for at in np.setdiff1d(wanted[wanted < width], known, assume_unique=True))
        known = runs


def _salts(level: np.ndarray | Column, leaves: np.ndarray | Column, part_leaves: int):
    """Salts of a coordinate: about one for ASKERS partitions among the leaves below its parent."""
    if isinstance(level, Column):
        return F.least(F.pow(F.lit(float(RUN)), level + 1), leaves.cast("double")) / (part_leaves * ASKERS) + 1
    return np.minimum(float(RUN) ** (level + 1), leaves) / (part_leaves * ASKERS) + 1


def _salt_level(tree: Column | np.ndarray, level):
    """Nodes of the top tree stand above whole sources: all partitions may want them."""
    return F.when(tree == TOP, F.lit(60)).otherwise(level) if isinstance(tree, Column) else np.where(tree == TOP, 60, level)


def fold(digest: str, places: Sequence[int], siblings: Sequence[Sequence[str]]) -> str:
    """The root that follows from a leaf, its place in each run on the way, and the other nodes of these runs."""
    for place, others in zip(places, siblings):
        digest = hashed([*others[:place], digest, *others[place:]])
    return digest


class _Trees:
    """The nodes a partition holds or derives, and the proofs that follow from them."""

    def __init__(self, n_sources: int, fetched: pd.DataFrame) -> None:
        self.n_sources = n_sources
        self.nodes = {(t, l, a): d for t, l, a, d in zip(fetched["tree"], fetched["level"], fetched["at"], fetched["digest"])}
        self.proofs: dict[tuple[int, int, int], tuple[str, ...]] = {}
        self.folded: dict[tuple[int, int, int, str], str] = {}

    def run(self, tree: int, level: int, at: int, width: int) -> list[str]:
        first = at // RUN * RUN
        return [self.nodes[tree, level, i] for i in range(first, min(first + RUN, width))]

    def derive(self, tree: int, n: int, held: dict[int, np.ndarray]) -> None:
        """All nodes above the held ones."""
        known = np.zeros(0, dtype=np.int64)
        for level, width in enumerate(widths(n)[:-1]):
            known = np.unique(np.union1d(known, held.get(level, known[:0])) // RUN)
            for at in known.tolist():
                if (tree, level + 1, at) not in self.nodes:
                    self.nodes[tree, level + 1, at] = hashed(self.run(tree, level, at * RUN, width))

    def above(self, tree: int, n: int, level: int, at: int) -> tuple[tuple[str, ...], ...]:
        """Siblings of each run from a node to the root of all, through the top tree."""
        shape = widths(n)
        if level == len(shape) - 1:
            return () if tree == TOP else self.above(TOP, self.n_sources, 0, tree)
        key = tree, level, at
        if key not in self.proofs:
            run = self.run(tree, level, at, shape[level])
            place = at % RUN
            self.proofs[key] = (tuple(run[:place] + run[place + 1 :]), *self.above(tree, n, level + 1, at // RUN))
        return self.proofs[key]

    def places(self, tree: int, n: int, at: int) -> list[int]:
        way = []
        for t, count, i in ((tree, n, at), (TOP, self.n_sources, tree)):
            for _ in widths(count)[:-1]:
                way.append(i % RUN)
                i //= RUN
        return way

    def fold(self, tree: int, n: int, level: int, at: int, digest: str) -> str:
        """As ``fold``, where equal digests at one node are folded on once."""
        key = tree, level, at, digest
        if key not in self.folded:
            siblings = self.above(tree, n, level, at)
            shape = widths(n)
            if level == len(shape) - 1:
                self.folded[key] = digest if tree == TOP else self.fold(TOP, self.n_sources, 0, tree, digest)
            else:
                self.folded[key] = self.fold(tree, n, level + 1, at // RUN, fold(digest, [at % RUN], siblings[:1]))
        return self.folded[key]


def _held(pdf: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
    """(tree, leaves of the tree, places of the leaves held) of block rows."""
    for (tree, n), blocks in pdf.groupby(["tree", "leaves"])["block"]:
        places = (np.sort(blocks.to_numpy(np.int64))[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        yield int(tree), int(n), places[places < n]


def _partitions(manifest: Manifest, part_leaves: int):
    """Leaf partitions beside the nodes each of them has asked for."""
    n_sources, n_leaves = manifest.n_sources, manifest.n_leaves

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(tree, level, at, n) for tree, n, places in _held(pdf) for level, at in missing({0: places}, n)]
        subroots = np.unique(pdf["tree"].to_numpy(np.int64))
        # subroots follow from the partition's leaves, so only other sources' are fetched
        found += [(TOP, level, at, n_leaves) for level, at in missing({0: subroots}, n_sources)]
        out = pd.DataFrame(found, columns=["tree", "level", "at", "leaves"], dtype=np.int64)
        out["salt"] = (key[0] % np.floor(_salts(_salt_level(out["tree"].to_numpy(), out["level"].to_numpy()), out["leaves"].to_numpy(), part_leaves))).astype(np.int64)
        return out.drop(columns="leaves").assign(part=key[0])

    wanted = manifest.blocks.select("part", "tree", "block", "leaves").groupBy("part").applyInPandas(ask, "tree long, level long, at long, salt long, part long")
    copies = F.floor(_salts(_salt_level(F.col("tree"), F.col("level")), F.col("leaves"), part_leaves)).cast("bigint")
    stored = manifest.nodes.select("tree", "level", "at", "digest", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias("salt"))
    fetched = wanted.join(stored, ["tree", "level", "at", "salt"]).select("part", "tree", "level", "at", "digest")
    return manifest.blocks.groupBy("part").cogroup(fetched.groupBy("part"))


def _expanded(n_sources: int, blocks: pd.DataFrame, fetched: pd.DataFrame) -> tuple[_Trees, Iterator[tuple]]:
    """The trees as far as the partition needs them, and (block row, place in the tree, index in the block) of its leaves."""
    trees = _Trees(n_sources, fetched)
    for row in blocks.itertuples(index=False):
        trees.nodes.update(((row.tree, 0, row.block * BLOCK + i), digest) for i, digest in enumerate(row.digests))
    for tree, n, places in _held(blocks):
        trees.derive(tree, n, {0: places})
        trees.nodes[TOP, 0, tree] = trees.nodes[tree, len(widths(n)) - 1, 0]
    trees.derive(TOP, n_sources, {0: np.unique(blocks["tree"].to_numpy(np.int64))})
    return trees, ((row, row.block * BLOCK + i, i) for row in blocks.itertuples(index=False) for i in range(len(row.ids)))


def proofs(manifest: Manifest, part_leaves: int = PART_LEAVES) -> DataFrame:
    """(doc_id, source, leaf, places, siblings) of every leaf; ``fold(leaf, places, siblings)`` is the root."""
    n_sources = manifest.n_sources

    def expand(blocks: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        trees, leaves = _expanded(n_sources, blocks, fetched)
        rows = [(row.tree, row.ids[i], row.digests[i], trees.places(row.tree, row.leaves, at), [list(s) for s in trees.above(row.tree, row.leaves, 0, at)]) for row, at, i in leaves]
        return pd.DataFrame(rows, columns=["tree", "_id", "leaf", "places", "siblings"])

    found = _partitions(manifest, part_leaves).applyInPandas(expand, "tree long, _id long, leaf string, places array<int>, siblings array<array<string>>")
    return found.join(manifest.sources.select("tree", "source"), "tree").select(given_id("_id").alias("doc_id"), "source", "leaf", "places", "siblings")


def audit(manifest: Manifest, part_leaves: int = PART_LEAVES) -> DataFrame:
    """One row per leaf: _id, leaf, subroot, proof_sha256 (hash of all siblings in order) and folded_root, which follows from the
    leaf's claim (where it has one, else the leaf) and the siblings."""
    n_sources = manifest.n_sources

    def check(blocks: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        trees, leaves = _expanded(n_sources, blocks, fetched)
        rest: dict[tuple, str] = {}
        rows = []
        for row, at, i in leaves:
            siblings = trees.above(row.tree, row.leaves, 0, at)
            # all leaves of a run share the proof above it
            key = row.tree, at // RUN
            if key not in rest:
                rest[key] = "".join(map("".join, siblings[1:]))
            proof = hashed([*(siblings[0] if siblings else ()), rest[key]])
            digest = row.digests[i] if row.claims[i] is None else row.claims[i]
            rows.append((row.ids[i], row.digests[i], trees.nodes[TOP, 0, row.tree], proof, trees.fold(row.tree, row.leaves, 0, at, digest)))
        return pd.DataFrame(rows, columns=["_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return _partitions(manifest, part_leaves).applyInPandas(check, "_id long, leaf string, subroot string, proof_sha256 string, folded_root string")


def tampered_audit(docs: DataFrame, part_leaves: int = PART_LEAVES) -> DataFrame:
    """Manifest of ``docs``, where the text of every document whose crc32(doc_id as text) 5 divides is checked in lower case (A-Z)."""
    given = [F.col(c) for c in FIELDS]
    changed = leaf_digest([*given[:-1], F.translate("text", UPPER, LOWER)])
    forged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(known_id("doc_id").alias("_id"), "source", leaf_digest(given).alias("leaf"), F.when(forged, changed).alias("claim"))
    manifest = build(leaves, part_leaves)
    root = F.lit(manifest.root).cast("string")
    found = audit(manifest, part_leaves)
    return found.select(given_id("_id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
