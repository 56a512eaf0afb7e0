"""Helpers shared by the corpus operators: words, row identity, session settings and intermediate folders."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspan.session import ensure_checkpoint_dir, prepare

# Separators of words everywhere in this package: space and the control characters 09 to 0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

# Rows handed to Python at a time; texts may be long, so batches are short.
BATCH_ROWS = "512"


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("bigint")


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; ``bytes.split`` separates at exactly the characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


NO_ID = -(2**63)  # stands for a null id inside tasks, where a null would turn the others into floats


def known_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NO_ID))


def given_id(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID))


def identity(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """Two non-null columns naming a row by id and content, for joins back to rows whose id may be null or repeated."""
    return [
        known_id(id_column).alias("_id"),
        F.xxhash64(F.col(text_column), F.col(id_column).isNull()).alias("_content"),
    ]


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Whole rows in one column ``_row`` beside derived ones, so that no column of ``docs`` can clash with these."""
    return docs.select(F.struct("*").alias("_row"), *more)


MAP_BITS = 26  # of a bit map: 8 MB, whatever is put in; a denser map only lets more through to the exact join behind it


def bit_map(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit for the leading bits of each 64-bit hash; at most 2 ** (MAP_BITS - 6) words come to the driver."""
    place = F.shiftrightunsigned(column, 64 - MAP_BITS)
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def in_bit_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may have been put in."""
    place = hashes >> np.uint64(64 - MAP_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place the cluster names."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
