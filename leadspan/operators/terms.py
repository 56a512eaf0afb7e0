"""Texts that contain a term of a list kept as a table, however long the list.

Every term is filed under its rarest piece of three letters (shorter terms under themselves). Distinct texts meet the terms on
their pieces in an equi-join, and the whole term is looked for in what meets. Texts and pieces are distinct, so a text that many
rows share is searched once, and a piece that most texts hold is hardly ever the rarest of a term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 3


def _pieces(c: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(c) - size + 1)
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(starts, lambda i: c.substr(i, size)))).otherwise(F.array().cast("array<string>"))


def texts_with_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The distinct values of ``texts`` (text) that contain a value of ``terms`` (term), ignoring case."""
    low = texts.select("text", F.lower("text").alias("low")).filter("text IS NOT NULL").distinct()
    wanted = terms.select(F.lower("term").alias("term")).filter("term IS NOT NULL").distinct()
    size = F.least(F.length("term"), F.lit(PIECE))
    # at most four lengths
    sizes = sorted(r["size"] for r in wanted.select(size.alias("size")).distinct().collect())
    if sizes[:1] == [0]:  # every text contains the empty term
        return low.select("text")
    if not sizes:
        return low.select("text").limit(0)
    held = low.select("text", "low", F.explode(F.concat(*[_pieces(F.col("low"), s) for s in sizes])).alias("piece"))
    parts = wanted.select("term", F.explode(_pieces(F.col("term"), size)).alias("piece"))
    count = held.join(parts.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # a piece that no text holds rules its term out
    filed = parts.join(count, "piece", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("_rarest"))
    keyed = filed.filter("_rarest.n > 0").select("term", F.col("_rarest.piece").alias("piece"))
    return held.join(keyed, "piece").filter(F.col("low").contains(F.col("term"))).select("text").distinct()


def with_term_flag(df: DataFrame, text: Column, terms: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: whether ``text`` contains a term."""
    keyed = df.withColumn("_text", text)
    hits = texts_with_terms(keyed.select(F.col("_text").alias("text")), terms).select(F.col("text").alias("_text"), F.lit(True).alias(name))
    return keyed.join(hits, "_text", "left").drop("_text").withColumn(name, F.coalesce(name, F.lit(False)))


def with_value_flag(df: DataFrame, value: Column, values: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: whether ``value`` is one of ``values`` (term)."""
    listed = values.select(F.col("term").alias("_value"), F.lit(True).alias(name)).filter("_value IS NOT NULL").distinct()
    return df.withColumn("_value", value).join(listed, "_value", "left").drop("_value").withColumn(name, F.coalesce(name, F.lit(False)))
