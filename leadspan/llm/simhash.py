"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint has 64 bits, so two fingerprints at ``bits`` or fewer differing bits differ in at most ``bits`` of their 8
bytes and share at least ``8 - bits`` bytes at the same position: the guaranteed number of matches of the count filter.
Plain postings per (position, byte) would hold 1/256 of the corpus each and the tally would be quadratic, so a posting
here is a whole set of ``8 - bits`` positions with their bytes: who meets in one has reached the count. Meetings are
then tallied over all positions and verified on the bits.

* A posting holds distinct fingerprints that differ in ``bits`` bytes only: for 2 bits never more than 65,536, however
  many copies a text has. Copies are one entry.
* Within a posting near fingerprints are found by probing single and double bit flips when there are many, and only the
  links of a spanning forest leave the task, so what is emitted grows with the entries, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspan.llm.texts import identity, packed, words_of
from leadspan.operators.graph import connected_components
from leadspan.session import cut_lineage

SHINGLES_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over ``width``-word shingles (repeats count), 0 without words."""
    words = [w.lower() for w in words_of(text)]  # bytes.lower changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1
    k = max(1, len(words) - width + 1)
    begin, stop = starts[:k].tolist(), (ends[-k:] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, k, SHINGLES_AT_ONCE):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(begin[at : at + SHINGLES_AT_ONCE], stop[at : at + SHINGLES_AT_ONCE])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > k).tobytes(), "big")


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """The fingerprint with its bits in a signed long."""
    return pd.Series([fingerprint_of(t) for t in texts], dtype="uint64").astype("int64")


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _masks(free: tuple[int, ...], bits: int) -> np.ndarray:
    """All flips of 1 to ``bits`` bits inside the byte positions that a posting leaves free."""
    single = [1 << (8 * p + b) for p in free for b in range(8)]
    return np.array([sum(c) for n in range(1, bits + 1) for c in combinations(single, n)], dtype=np.uint64)


def forest(values: np.ndarray, free: tuple[int, ...], bits: int) -> list[tuple[int, int]]:
    """Links (member, smallest of its group) among sorted distinct fingerprints that agree outside ``free``."""
    n = len(values)
    if n <= 64:
        apart = values[:, None] ^ values[None, :]
        shared = (apart.reshape(n, n, 1).view(np.uint8) == 0).sum(axis=2)
        a, b = np.nonzero((shared >= 8 - bits) & (np.bitwise_count(apart) <= bits))
    else:
        found_a, found_b = [], []
        for mask in _masks(free, bits):
            other = values ^ mask
            at = np.minimum(np.searchsorted(values, other), n - 1)
            hit = np.nonzero(values[at] == other)[0]
            found_a.append(hit)
            found_b.append(at[hit])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.nonzero(label != np.arange(n))[0]
    return [(int(values[i].astype(np.int64)), int(values[label[i]].astype(np.int64))) for i in moved]


def links(fingerprints: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints reachable over steps of ``bits`` or fewer bits.

    ``fingerprints`` has one column ``fp`` without repeats. An empty table gives no link.
    """
    free_sets = list(combinations(range(8), bits))
    keys = F.array(*[
        F.struct(F.lit(i).cast("tinyint").alias("free"), F.col("fp").bitwiseAND(F.lit(_kept_bytes(free))).alias("kept"))
        for i, free in enumerate(free_sets)
    ])
    postings = fingerprints.select("fp", F.inline(keys)).groupBy("free", "kept").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)

    def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for i, members in zip(batch["free"], batch["members"]):
                found += forest(np.sort(np.asarray(members, dtype=np.int64).view(np.uint64)), free_sets[i], bits)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return postings.select("free", "members").mapInPandas(connect, "a bigint, b bigint").distinct()


def _kept_bytes(free: tuple[int, ...]) -> int:
    """Mask of the bytes that a posting keeps, as a signed long."""
    mask = ~sum(0xFF << (8 * p) for p in free) & (2**64 - 1)
    return mask - 2**64 if mask >= 2**63 else mask


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, _id, _content, fp) of every row, kept in the shared folder since texts are read once."""
    return cut_lineage(docs.select(F.col(id_column).alias("doc_id"), *identity(id_column, text_column), simhash(F.col(text_column)).alias("fp")))


def grouped(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Adds ``component_id``: the smallest doc_id reachable from the row's fingerprint, itself included.

    Rows without an id count through their text like any other; a group of such rows only has a null component_id.
    """
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    near = cut_lineage(links(distinct.select("fp"), bits))
    if near.isEmpty():
        return prints.join(distinct.withColumnRenamed("first", "component_id"), "fp")
    components = connected_components(near).withColumnRenamed("node", "fp")
    placed = distinct.join(components, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    placed = cut_lineage(placed)
    heads = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(placed.join(heads, "component").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows share a component; other
    columns of ``docs`` are not read; an empty table gives no rows.
    """
    return grouped(fingerprints(docs, id_column, text_column), bits).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest id; repeated rows stay once.

    Rows of a group without any id stay once per distinct text.
    """
    groups = grouped(fingerprints(docs, id_column, text_column), bits)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("_id", "component_id").agg(F.min("_content").alias("_content"), F.collect_set("_content").alias("_all"))
    kept = kept.select("_id", F.explode(F.when(F.col("component_id").isNull(), F.col("_all")).otherwise(F.array("_content"))).alias("_content")).distinct()
    named = packed(docs, *identity(id_column, text_column)).join(kept, ["_id", "_content"])
    once = named.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_content").orderBy(F.lit(1)))).filter("_n = 1")
    return once.select("_row.*")
