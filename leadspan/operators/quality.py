"""Checks of result sets: duplicates across sets, completeness, match-rate anomaly, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.normalize import company_key
from leadspan.functions.stats import count_if
from leadspan.operators.ranking import top_k


def cross_set_dupes(rows: DataFrame) -> DataFrame:
    """Rows of a set whose company key occurs in another set, per pair of sets.

    Counted per (set, key) first, so the join meets each key once per set, however often it repeats.
    """
    keyed = rows.filter("data IS NOT NULL").select(
        "result_set_id", company_key(F.try_element_at("data", F.lit("company_name")), F.try_element_at("data", F.lit("website"))).alias("key")
    )
    per_set = keyed.filter("key IS NOT NULL").groupBy("result_set_id", "key").agg(F.count(F.lit(1)).alias("n"))
    other = per_set.select("key", F.col("result_set_id").alias("other_set_id"))
    return (
        per_set.join(other, "key").filter("result_set_id <> other_set_id").groupBy("result_set_id", "other_set_id").agg(F.sum("n").alias("duplicate_count"))
        .withColumn("severity", F.when(F.col("duplicate_count") > 5, "warning").otherwise("info"))
    )


def completeness(rows: DataFrame) -> DataFrame:
    """Incomplete row counts per set with the five most often missing fields (ties by name) and the issue severity."""
    empty = lambda c: c.isNull() | (c == "")
    fields = F.map_entries("data")
    missing = F.transform(F.filter(fields, lambda e: empty(e["value"])), lambda e: e["key"])
    ratio = 1.0 - F.size("missing") / F.greatest(F.size("data"), F.lit(1))
    filled = F.when(F.size("data") == 0, F.lit(0.0)).otherwise(ratio)
    marked = rows.select("result_set_id", "data", missing.alias("missing")).withColumn("filled", F.when(F.col("data").isNull(), F.lit(0.0)).otherwise(filled))
    counts = marked.groupBy("result_set_id").agg(
        F.count(F.lit(1)).alias("row_count"), count_if(F.col("filled") < 0.4).alias("critical_rows"), count_if((F.col("filled") >= 0.4) & (F.col("filled") < 0.6)).alias("warning_rows"),
    )
    per_field = marked.select("result_set_id", F.explode("missing").alias("field")).groupBy("result_set_id", "field").agg(F.count(F.lit(1)).alias("n"))
    top = top_k(per_field, ["result_set_id"], [F.col("n").desc(), F.col("field")], 5)
    listed = top.groupBy("result_set_id").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat("field", F.lit(" ("), "n", F.lit(" rows)")).alias("label")))).alias("t"))
    named = listed.select("result_set_id", F.array_join("t.label", ", ").alias("top_missing"))
    severity = F.when(F.col("critical_rows") > 0, "critical").when(F.col("warning_rows") > 0, "warning")
    return counts.join(named, "result_set_id", "left").withColumn("severity", severity)


def anomaly(rates: DataFrame) -> DataFrame:
    rate = F.col("match_rate")
    return rates.withColumn("severity", F.when(rate < 15, "critical").when(rate < 30, "warning"))


def freshness(sets: DataFrame, now: Column) -> DataFrame:
    age = F.floor((F.unix_micros(now) - F.unix_micros("created_at")) / F.lit(8.64e10))
    return sets.withColumn("age_days", age).withColumn("severity", F.when(age > 60, "critical").when(age > 30, "warning"))


def data_quality(rows: DataFrame, sets: DataFrame, now: Column) -> DataFrame:
    """All issues of all sets as rows: set, check, severity and the message shown."""
    d = cross_set_dupes(rows).select(
        "result_set_id", F.lit("duplicate").alias("check_type"), "severity",
        F.concat(F.lit("Found "), "duplicate_count", F.lit(' duplicates from "'), "other_set_id", F.lit('". Merge and use most recent data?')).alias("nudge"),
    )
    c = completeness(rows).filter("severity IS NOT NULL").select(
        "result_set_id", F.lit("completeness").alias("check_type"), "severity",
        F.when(
            F.col("severity") == "critical", F.concat("critical_rows", F.lit(" rows are missing key fields: "), F.coalesce("top_missing", F.lit("")), F.lit(". Enrich with a provider?"))
        ).otherwise(F.concat("warning_rows", F.lit(" rows have incomplete data. Consider enriching missing fields."))).alias("nudge"),
    )
    f = freshness(sets, now).filter("severity IS NOT NULL").select(
        "result_set_id", F.lit("freshness").alias("check_type"), "severity",
        F.when(F.col("severity") == "critical", F.concat(F.lit("Data is "), "age_days", F.lit(" days old. Re-enrich to get current information?")))
        .otherwise(F.concat(F.lit("Data is "), "age_days", F.lit(" days old. Consider re-enriching for accuracy."))).alias("nudge"),
    )
    return d.unionByName(c).unionByName(f)


def review_rows(issues: DataFrame) -> DataFrame:
    """Critical issues become review items of high priority."""
    return issues.filter("severity = 'critical'").select(
        F.lit("data_quality").alias("type"), F.concat(F.lit("Data Quality: "), "check_type", F.lit(" — "), "severity").alias("title"),
        F.col("nudge").alias("description"), F.col("result_set_id").alias("source_id"), F.lit("high").alias("priority"), F.lit("pending").alias("status"),
    )
