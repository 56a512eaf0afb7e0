"""Provider scorecards, provider choice, execution samples and credit usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.stats import js_round, safe_div
from leadspan.operators.ranking import latest_by

METRICS = {"accuracy": "accuracy", "latency_ms": "avg_latency_ms", "cost_per_call": "avg_cost_per_call", "coverage": "coverage_score"}


def provider_scorecard(stats: DataFrame, by: Sequence[str] = ("provider_id",)) -> DataFrame:
    """Sample-weighted mean per metric (a missing sample weighs 1), 0 without samples; sample_size counts stat rows."""
    weight = F.coalesce(F.col("sample_size"), F.lit(1)).cast("double")
    aggs = []
    for metric, name in METRICS.items():
        hit = F.col("metric") == metric
        total, n = F.sum(F.when(hit, F.col("value") * weight)), F.sum(F.when(hit, weight))
        aggs.append(F.coalesce(F.when(n > 0, safe_div(total, n)), F.lit(0.0)).alias(name))
    return stats.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("sample_size"))


def provider_score(prefer_quality: bool = False, budget: float = 1.0) -> Column:
    quality, cost = (0.5, 0.1) if prefer_quality else (0.3, 0.3)
    latency = F.greatest(F.lit(0.0), 1 - F.col("avg_latency_ms") / 10000.0)
    cheap = F.when(F.col("avg_cost_per_call") > 0, F.greatest(F.lit(0.0), 1 - F.col("avg_cost_per_call") / F.lit(budget))).otherwise(F.lit(1.0))
    coverage = F.least(F.lit(1.0), F.col("coverage_score") / 100.0)
    return F.col("accuracy") / 100.0 * quality + cheap * cost + latency * 0.2 + coverage * 0.2


def best_provider(stats: DataFrame, preferences: DataFrame, prefer_quality: bool = False, budget: float = 1.0) -> DataFrame:
    """Choice per skill: the newest preference if a user set it, else the best scored provider, with two alternatives."""
    scored = provider_scorecard(stats).withColumn("score", provider_score(prefer_quality, budget))
    first3 = scored.orderBy(F.col("score").desc(), "provider_id").limit(3)
    ranked = first3.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "provider_id"))).alias("r"))
    ids = ranked.select("r.provider_id").scalar()
    top = ranked.select((-F.col("r")[0]["s"]).alias("score")).scalar()
    newest = latest_by(preferences.select("skill_id", "preferred_provider", "source", "created_at", "pref_id"), ["skill_id"], F.struct("created_at", "pref_id"))
    chosen = F.col("source") == "user"
    out = newest.withColumn("_ids", ids).withColumn("_top", top)
    return out.select(
        "skill_id", F.when(chosen, F.col("preferred_provider")).otherwise(F.get("_ids", F.lit(0))).alias("provider_id"),
        F.when(chosen, F.lit("user preference")).otherwise(F.concat(F.lit("Best score: "), js_round(F.col("_top") * 100).cast("string"), F.lit("%"))).alias("reason"),
        F.when(~chosen, F.get("_ids", F.lit(1))).alias("alternative_1"), F.when(~chosen, F.get("_ids", F.lit(2))).alias("alternative_2"),
    )


def record_execution(runs: DataFrame) -> DataFrame:
    """One wide run record to four metric samples; coverage weighs itself."""
    one = F.lit(1).cast("bigint")
    row = lambda metric, value, weight: F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), weight.alias("sample_size"))
    samples = F.array(
        row("accuracy", F.coalesce("quality_score", F.lit(50)), one), row("latency_ms", F.col("latency_ms"), one),
        row("cost_per_call", F.col("cost_estimate"), one), row("coverage", F.col("row_count"), F.col("row_count").cast("bigint")),
    )
    return runs.select("provider_id", "segment", "measured_at", F.inline(samples))


# Credits per operation.
CREDITS = {
    "company_identify": 0, "company_search_db": 1, "company_search_live": 2, "company_enrich": 1, "company_enrich_realtime": 4,
    "people_search_per_100": 3, "people_search_minimum": 3, "people_search_live": 20, "people_enrich_per_person": 3, "web_search_per_10": 1,
}


def estimated_credits() -> Column:
    op = F.col("operation")
    hundreds = F.ceil(F.coalesce("result_count", F.lit(100)) / 100.0)
    tens = F.ceil(F.coalesce("result_count", F.lit(10)) / 10.0)
    return (
        F.when(op == "company_identify", CREDITS["company_identify"]).when(op == "company_search_db", CREDITS["company_search_db"])
        .when(op == "company_search_live", CREDITS["company_search_live"])
        .when(op == "company_enrich", F.when(F.col("realtime"), CREDITS["company_enrich_realtime"]).otherwise(CREDITS["company_enrich"]))
        .when(op == "people_search_db", F.greatest(F.lit(CREDITS["people_search_minimum"]), hundreds * CREDITS["people_search_per_100"]))
        .when(op == "people_search_live", CREDITS["people_search_live"])
        .when(op == "people_enrich", F.coalesce("person_count", F.lit(1)) * CREDITS["people_enrich_per_person"])
        .when(op == "web_search", tens * CREDITS["web_search_per_10"])
    ).cast("bigint")


def credit_usage(operations: DataFrame) -> DataFrame:
    """Estimate, needed balance (1.5x), block flag, and the level of the actual against the estimated cost."""
    e = operations.withColumn("estimate", estimated_credits())
    est, actual = F.col("estimate"), F.col("actual_cost")
    needed = F.ceil(est * 1.5)
    return e.select(
        "*", needed.alias("needed"), ((F.col("balance") < 0) | (F.col("balance") < needed)).alias("blocked"),
        F.when(est > 0, js_round(safe_div(actual, est))).otherwise(F.lit(0)).alias("ratio"), F.when(actual > est * 3, "WARN").otherwise("INFO").alias("level"),
    )


def credit_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("operation").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("estimate").alias("estimated"), F.sum("actual_cost").alias("actual"), F.sum(F.col("blocked").cast("int")).alias("blocked_calls"),
        F.sum((F.col("level") == "WARN").cast("int")).alias("warnings"),
    )
