"""Ordering helpers that stay distributed when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspan.session import cut_lineage


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows of each group in ``order``, with their 1-based rank.

    ``row_number() <= k`` lets Spark keep at most k rows per group on the map side
    (WindowGroupLimit) before the exchange, so a hot group never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= F.lit(k))


def latest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key, as a map-side combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def earliest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Exact 0-based position of every row within its group, without one task per group.

    Rows are range-partitioned on (keys, order), so a hot group spans many partitions. The placement is
    checkpointed once; rows are numbered inside (partition, group) and shifted by the number of rows the
    group has in earlier partitions. ``order`` must name columns that make the order total.
    """
    sort_cols = [F.col(c) for c in [*keys, *order]]
    placed = cut_lineage(df.repartitionByRange(*sort_cols).withColumn("_part", F.spark_partition_id()))
    group = ["_part", *keys]
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    # one row per (partition, group): a group repeats at most once per partition it spans
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*group).orderBy(*order)
    numbered = placed.withColumn("_i", F.row_number().over(local))
    cond = numbered["_part"] == offsets["_part"]
    for k in keys:
        cond = cond & numbered[k].eqNullSafe(offsets[k])
    joined = numbered.join(offsets, cond, "left")
    out = [numbered[c] for c in df.columns]
    return joined.select(*out, (F.col("_i") - 1 + F.col("_offset")).cast("bigint").alias(name))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row generator.

    Unlike withColumn, later filters on them are not rewritten in terms of the input, so long chains of derived
    columns do not multiply while the query is planned.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
