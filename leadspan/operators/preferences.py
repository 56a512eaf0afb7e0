"""Preference rules from liked and disliked samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.stats import js_round


def preference_rules(swipes: DataFrame, dimensions: Mapping[str, Column], order: str = "sample_id") -> DataFrame:
    """One rule per dimension whose values differ in like rate by 30 points or more.

    On equal rates the value seen first last wins, for best and worst alike. Over 60 points is strong and then needs
    three samples on both sides.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("value")) for d, c in dimensions.items()])
    long = swipes.select(F.col(order).alias("_at"), (F.col("verdict") == "like").alias("_like"), F.inline(pairs)).filter("value <> ''")
    per_value = long.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_like"), 1)).alias("liked"), F.min("_at").alias("first_at")
    ).withColumn("rate", F.col("liked") / F.col("n"))
    entry = F.struct("value", "rate", "n")
    per_dim = per_value.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("values"), F.max_by(entry, F.struct("rate", "first_at")).alias("best"),
        F.max_by(entry, F.struct(-F.col("rate"), F.col("first_at"))).alias("worst"),
    )
    spread = (F.col("best.rate") - F.col("worst.rate")) * 100
    strong = spread > 60
    percent = lambda c: js_round(c * 100).cast("string")
    kept = per_dim.filter((F.col("values") >= 2) & (spread >= 30) & (~strong | ((F.col("best.n") >= 3) & (F.col("worst.n") >= 3))))
    text = F.concat(
        F.lit('Prefer "'), F.col("best.value"), F.lit('" '), F.col("dimension"), F.lit(" ("), percent(F.col("best.rate")), F.lit('% liked) over "'),
        F.col("worst.value"), F.lit('" ('), percent(F.col("worst.rate")), F.lit("%)"),
    )
    return kept.select(
        "dimension", F.when(strong, "strong").otherwise("mild").alias("strength"), text.alias("description"), js_round(spread).alias("spread"),
        F.col("best.value").alias("preferred_value"), F.col("worst.value").alias("avoid_value"),
    )


def preference_learning(rules: DataFrame, total_samples: DataFrame, skill: str, now: Column) -> DataFrame:
    """Strong rules as validated insights with their evidence; ``total_samples`` is a one-row, one-column table."""
    return rules.filter("strength = 'strong'").select(
        F.lit("content").alias("category"), F.concat(F.lit(f"[{skill}] "), "description").alias("insight"), F.lit("validated").alias("confidence"),
        F.lit("rlhf").alias("source"), F.lit("preference").alias("evidence_type"), F.lit(f"rl-{skill}").alias("source_id"), F.col("dimension").alias("metric"),
        F.col("spread").alias("value"), total_samples.scalar().alias("sample_size"), now.alias("observed_at"),
    )


def like_rate(swipes: DataFrame) -> DataFrame:
    liked = F.count(F.when(F.col("verdict") == "like", 1))
    n = F.count(F.lit(1))
    return swipes.agg(F.when(n > 0, js_round(F.try_divide(liked, n) * 100)).otherwise(F.lit(0)).alias("like_rate"), n.alias("total_samples"))


def comment_insights(swipes: DataFrame) -> DataFrame:
    """``[Liked]`` / ``[Disliked]`` lines of the samples that carry a comment."""
    label = F.when(F.col("verdict") == "like", "Liked").otherwise("Disliked")
    return swipes.filter("comment <> ''").select("sample_id", F.concat(F.lit("["), label, F.lit('] "'), "comment", F.lit('"')).alias("line"))
