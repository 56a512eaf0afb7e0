"""Review queue: order, counts, blocklist additions; small summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.stats import count_if, js_round

PRIORITIES = ["urgent", "high", "normal", "low"]


def priority_rank(c: Column) -> Column:
    pos = F.array_position(F.lit(PRIORITIES), c)
    return F.when(pos > 0, pos - 1).otherwise(4)


def review_order(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("priority_rank", priority_rank(F.col("priority"))).orderBy("priority_rank", "created_at", "review_id")


def pending_counts(reviews: DataFrame) -> DataFrame:
    p = reviews.filter("status = 'pending'")
    return p.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("priority") == "urgent").alias("urgent"), count_if(F.col("priority") == "high").alias("high")
    )


def qualification_summary(leads: DataFrame, score: str = "qualification_score") -> DataFrame:
    """Mean score with 50 for missing ones, and how many reach 70."""
    s = F.coalesce(F.col(score), F.lit(50))
    n = F.count(F.lit(1))
    return leads.agg(n.alias("total_qualified"), F.when(n > 0, js_round(F.avg(s))).otherwise(F.lit(0)).alias("average_score"), count_if(s >= 70).alias("high_score_count"))


def action_summary(actions: DataFrame) -> DataFrame:
    """Counts by channel and by status, as one long table."""
    return actions.groupingSets([["channel"], ["status"]], "channel", "status").agg(F.count(F.lit(1)).alias("actions")).select(
        F.when(F.col("channel").isNotNull(), "channel").otherwise("status").alias("kind"), F.coalesce("channel", "status").alias("label"), "actions"
    )
