"""Daily budgets: how many sends go out, in order, under caps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.operators.ranking import top_k

# Tokens per day, provider and account.
DAILY_LIMITS = {"linkedin.connect": 30, "linkedin.dm": 50, "email.send": 50, "data.search": 100}
DEFAULT_LIMIT = 100


def limit_of(provider: Column, limits: Mapping[str, int] = DAILY_LIMITS) -> Column:
    out = F.when(F.lit(False), 0)
    for name, n in limits.items():
        out = out.when(provider == name, n)
    return out.otherwise(DEFAULT_LIMIT)


def admit(requests: DataFrame, order: Sequence[str], used: DataFrame | None = None, limits: Mapping[str, int] = DAILY_LIMITS) -> DataFrame:
    """Requests granted under the daily cap of their (tenant, provider, account, day), taken in ``order``.

    A request of n tokens is granted whole or not at all, and a refused one does not block later smaller ones. Once
    size n was refused, every later n is refused too, so of each size only the first ``cap // n`` can be granted.
    That leaves a bounded set per bucket (a few hundred rows at cap 100), folded exactly by ``aggregate``.
    """
    bucket = ["tenant_id", "provider", "account_id", "day"]
    r = requests.withColumn("day", F.date_format("requested_at", "yyyy-MM-dd")).withColumn("_cap", limit_of(F.col("provider"), limits))
    if used is not None:
        spent = used.groupBy(*bucket).agg(F.sum("tokens").alias("_spent"))
        r = r.join(spent, bucket, "left").withColumn("_cap", F.col("_cap") - F.coalesce("_spent", F.lit(0))).drop("_spent")
    most = max([*limits.values(), DEFAULT_LIMIT])
    possible = r.filter((F.col("tokens") > 0) & (F.col("tokens") <= F.col("_cap")))
    first = top_k(possible, [*bucket, "tokens"], [F.col(c) for c in order], most, "_rn").filter(F.col("_rn") * F.col("tokens") <= F.col("_cap"))
    queue = first.groupBy(*bucket, "_cap").agg(
        F.array_sort(F.collect_list(F.struct(*order, F.col("tokens").cast("bigint").alias("tokens"), F.col("request_id").alias("_id")))).alias("_q")
    )
    start = F.struct(F.col("_cap").cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("ids"))

    def take(acc: Column, x: Column) -> Column:
        fits = x["tokens"] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - x["tokens"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["ids"], F.array(x["_id"].cast("bigint")))).otherwise(acc["ids"]).alias("ids"),
        )

    granted = queue.select(F.explode(F.aggregate("_q", start, take)["ids"]).alias("request_id"))
    return requests.join(granted, "request_id", "left_semi")


def remaining(requests: DataFrame, granted: DataFrame, limits: Mapping[str, int] = DAILY_LIMITS) -> DataFrame:
    """Tokens left per bucket and day after the granted requests."""
    bucket = ["tenant_id", "provider", "account_id", "day"]
    day = F.date_format("requested_at", "yyyy-MM-dd").alias("day")
    buckets = requests.select(*bucket[:3], day).distinct()
    spent = granted.select(*bucket[:3], day, "tokens").groupBy(*bucket).agg(F.sum("tokens").alias("_spent"))
    return buckets.join(spent, bucket, "left").select(*bucket, (limit_of(F.col("provider"), limits) - F.coalesce("_spent", F.lit(0))).cast("bigint").alias("tokens_remaining"))


def connect_budget(leads: DataFrame, campaigns: DataFrame, now: Column, blocked_ids: DataFrame | None = None, order: str = "lead_id") -> DataFrame:
    """Queued leads to contact today: the campaign's daily limit minus today's sends, in order.

    Blocked leads take up a slot: the budget is cut first, the block check comes after.
    """
    today = F.date_format(now, "yyyy-MM-dd")
    sent = leads.filter(F.date_format("connect_sent_at", "yyyy-MM-dd") == today).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("_today"))
    budget = campaigns.select("campaign_id", "daily_limit").join(sent, "campaign_id", "left").select(
        "campaign_id", F.greatest(F.lit(0), F.col("daily_limit") - F.coalesce("_today", F.lit(0))).alias("budget")
    )
    largest = budget.agg(F.max("budget")).first()[0] or 0  # one number
    first = top_k(leads.filter("lifecycle_status = 'Queued'"), ["campaign_id"], [F.col(order)], largest, "slot")
    chosen = first.join(budget, "campaign_id").filter(F.col("slot") <= F.col("budget")).drop("budget")
    return chosen if blocked_ids is None else chosen.join(blocked_ids, "lead_id", "left_anti")
