"""Token ids in one wavelet matrix per shard.

Documents are range-partitioned by id, encoded and cut into shards of whole documents with about ``shard_tokens`` ids.
A shard is one Parquet file of one row, written through Spark to the shared folder:

| field | content |
|---|---|
| part, seq | place of the shard: ascending (part, seq) is ascending doc_id |
| n_tokens, width | number of ids and bits of each id |
| doc_ids, doc_ends | documents in order and the id position where each ends |
| zeros | zeros in each bit plane, highest bit first |
| planes | bit planes, one bit per id, lowest bit of a byte first; each plane is ordered by the planes before it |
| ranks | ones before every block of 512 bits of each plane, 32-bit |

Access, counting and the k-th occurrence take one rank or select per plane, and need this one file only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadspan.llm.encoding import encoder
from leadspan.llm.texts import identity, scratch

SHARD_TOKENS = 1 << 21
BLOCK = 512  # bits
SLICE = 1 << 16
END_ID = 2
FORMAT = (
    "part int, seq int, n_tokens bigint, width int, doc_ids array<bigint>, doc_ends array<bigint>, zeros array<bigint>, planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """A sequence of unsigned integers below ``2 ** width``."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.width, self.zeros, self.planes = n, width, [int(z) for z in zeros], [np.frombuffer(p, dtype=np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, dtype="<u4") for r in ranks]

    @staticmethod
    def build(ids: np.ndarray, width: int) -> WaveletMatrix:
        n, zeros, planes, ranks = len(ids), [], [], []
        ids, after = ids.copy(), np.empty_like(ids)
        for shift in range(width - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << shift)).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            per_block = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype="<u4") if n else np.zeros(0, "<u4")
            planes.append(packed.tobytes())
            ranks.append((np.cumsum(per_block, dtype="<u4") - per_block).astype("<u4").tobytes())
            zeros.append(n - int(np.count_nonzero(ones)))
            # a stable partition, by slices that stay in the processor's cache
            low, high = 0, zeros[-1]
            for i in range(0, n, SLICE):
                own, bits = ids[i : i + SLICE], ones[i : i + SLICE]
                a, b = own.take(np.flatnonzero(~bits)), own.take(np.flatnonzero(bits))
                after[low : low + len(a)], after[high : high + len(b)] = a, b
                low, high = low + len(a), high + len(b)
            ids, after = after, ids
        return WaveletMatrix(n, width, zeros, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7) & 1)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i <= 0:
            return 0
        block = (i - 1) // BLOCK
        bits = self.planes[level][block * BLOCK // 8 : (i + 7) // 8]
        inside = int(np.bitwise_count(bits).sum())
        if i & 7:
            inside -= int(bits[-1] >> (i & 7)).bit_count()
        return int(self.ranks[level][block]) + inside

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        ranks = self.ranks[level]
        before = ranks if bit else np.arange(len(ranks), dtype=np.int64) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.width):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.width):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``value`` among positions lo (inclusive) to hi (exclusive)."""
        if value >> self.width:
            return 0
        first, last = self._range(value, lo, self.n if hi is None else hi)
        return last - first

    def locate(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, 0, self.n)[0] + k
        for level in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """The whole sequence, by undoing the planes from the last to the first."""
        kind = np.dtype("<u2") if self.width <= 16 else np.dtype("<u4")
        ids, above = np.zeros(self.n, dtype=kind), np.empty(self.n, dtype=kind)
        for level in range(self.width - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            bit, low, high = kind.type(1 << (self.width - 1 - level)), 0, self.zeros[level]
            for i in range(0, self.n, SLICE):
                own, bits = above[i : i + SLICE], ones[i : i + SLICE]
                a, b = np.flatnonzero(~bits), np.flatnonzero(bits)
                own[a], own[b] = ids[low : low + len(a)], ids[high : high + len(b)] | bit
                low, high = low + len(a), high + len(b)
            ids, above = above, ids
        return ids


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes the shards below ``folder``.

    Null texts are empty: they have the end id only. Documents without an id come first; repeated ids are ordered by
    content, and repeated rows all keep a place. Other columns are not read; an empty table writes no shard.
    """
    path = tokenizer or default_tokenizer()

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        width = max(1, (max(enc.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
        end, part, seq = np.array([end_id], dtype=enc.dtype).tobytes(), TaskContext.get().partitionId(), 0
        ids, keys, ends, n = [], [], [], 0

        def shard() -> pd.DataFrame:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), dtype=enc.dtype), width)
            row = (part, seq, n, width, keys, ends, matrix.zeros, [p.tobytes() for p in matrix.planes], [r.tobytes() for r in matrix.ranks])
            return pd.DataFrame([row], columns=[f.split()[0] for f in FORMAT.split(", ")])

        for batch in batches:
            missing = batch["doc_id"].isna()
            for key, null, text in zip(batch["_id"], missing, batch["text"]):
                found = enc.encode(text) + end
                ids.append(found)
                n += len(found) // enc.dtype.itemsize
                keys.append(None if null else key)
                ends.append(n)
                if n >= shard_tokens:
                    yield shard()
                    ids, keys, ends, n, seq = [], [], [], 0, seq + 1
        if keys:
            yield shard()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), *identity(id_column, text_column))
    placed = rows.repartitionByRange(F.col("_id"), F.col("_content")).sortWithinPartitions("_id", "_content")
    placed.mapInPandas(shards, FORMAT).write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FORMAT).parquet(folder)


def documents_of(shards: DataFrame) -> DataFrame:
    """Per document, from the shards alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = WaveletMatrix(row.n_tokens, row.width, row.zeros, row.planes, row.ranks).decode().astype("<u4")
                ends = np.asarray(row.doc_ends, dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                keys = pd.array([None if pd.isna(k) else int(k) for k in row.doc_ids], dtype="Int64")
                yield pd.DataFrame({"part": row.part, "seq": row.seq, "doc_id": keys, "inside": starts, "n_tokens": ends - starts, "ids_crc32": crc})

    found = shards.mapInPandas(decode, "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each partition of the writing job
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_earlier")).join(parts, "part")
    return found.join(offsets, ["part", "seq"]).select("doc_id", (F.col("_before") + F.col("_earlier") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Writes the shards of ``docs`` to ``folder`` (a new shared one by default) and returns what ``documents_of`` reads back from them."""
    folder = folder or scratch(docs.sparkSession, "token-shards")
    write_shards(docs, folder, tokenizer, **options)
    return documents_of(read_shards(docs.sparkSession, folder))
