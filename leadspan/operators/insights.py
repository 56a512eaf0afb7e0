"""Evidence and confidence of insights. Evidence stays one row per observation; an insight carries its summary.

A popular insight may own a large share of all evidence, so nothing here gathers evidence into one array: count,
span, sample and balance are all combinable aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.scoring import DAY_MICROS, bias_passed, confidence_score, should_promote
from leadspan.functions.stats import js_round
from leadspan.operators.ranking import top_k

NEXT_LEVEL = {"hypothesis": "validated", "validated": "proven"}


def bias_check(evidence: DataFrame) -> DataFrame:
    """Sample size, whether at least two sources contribute, and the span in days, per insight."""
    n = F.count(F.lit(1))
    span = js_round((F.unix_micros(F.max("observed_at")) - F.unix_micros(F.min("observed_at"))) / F.lit(DAY_MICROS))
    return evidence.groupBy("insight_id").agg(
        n.alias("evidence_count"), F.coalesce(F.sum("sample_size"), F.lit(0)).alias("sample_size"),
        (F.min("source_id") != F.max("source_id")).alias("balanced"), F.when(n >= 2, span).otherwise(F.lit(0)).alias("span_days"),
        F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"),
    )


def accumulate_evidence(evidence: DataFrame, with_bias_check: bool = True) -> DataFrame:
    """Summary and confidence score per insight; the bias part counts only once a bias check was made."""
    s = bias_check(evidence)
    passed = bias_passed(F.col("sample_size"), F.col("balanced"), F.col("span_days")) if with_bias_check else F.lit(False)
    return s.withColumn("confidence_score", confidence_score(F.col("evidence_count"), F.col("first_at"), F.col("last_at"), passed))


def promotion(insights: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each insight with its check, the promotion verdict and the reason."""
    keep = [c for c in insights.columns if c != "confidence_score"]
    j = insights.select(*keep).join(accumulate_evidence(evidence), "insight_id", "left")
    known = F.col("evidence_count").isNotNull()
    count = F.coalesce("evidence_count", F.lit(0))
    promote, reason = should_promote(F.col("confidence"), count, known, F.col("sample_size"), F.col("balanced"), F.col("span_days"))
    return j.withColumn("evidence_count", count).withColumn("confidence_score", F.coalesce("confidence_score", F.lit(0))).withColumn(
        "promote", promote
    ).withColumn("reason", reason)


def intelligence_cycle(insights: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """Accumulate, check bias, score, promote: the next snapshot of the insights."""
    p = promotion(insights, evidence)
    nxt = F.when(F.col("confidence") == "hypothesis", "validated").otherwise("proven")
    return p.withColumn("validated_at", F.when(F.col("promote"), now)).withColumn(
        "confidence", F.when(F.col("promote"), nxt).otherwise(F.col("confidence"))
    )


def insights_for_prompt(insights: DataFrame, proven: int = 5, validated: int = 3) -> DataFrame:
    """Best proven and validated insights per tenant and segment, those without segment competing everywhere."""
    order = [F.col("confidence_score").desc(), F.col("insight_id")]
    limit = F.when(F.col("confidence") == "proven", proven).otherwise(validated)
    usable = insights.filter(F.col("confidence").isin("proven", "validated")).select("tenant_id", "segment", "confidence", "confidence_score", "insight_id")
    own = top_k(usable.filter("segment IS NOT NULL"), ["tenant_id", "segment", "confidence"], order, max(proven, validated)).drop("rn")
    shared = top_k(usable.filter("segment IS NULL").drop("segment"), ["tenant_id", "confidence"], order, max(proven, validated)).drop("rn")
    segments = insights.filter("segment IS NOT NULL").select("tenant_id", "segment").distinct()
    everywhere = segments.join(shared, "tenant_id").select(*own.columns)
    ranked = top_k(own.union(everywhere), ["tenant_id", "segment", "confidence"], order, max(proven, validated))
    return ranked.filter(F.col("rn") <= limit)


def supersede(insights: DataFrame, replacements: DataFrame, now: Column) -> DataFrame:
    """New snapshot: replaced rows expire now, replacements (with ``supersedes``) are added."""
    old = replacements.select(F.col("supersedes").alias("insight_id")).distinct().withColumn("_hit", F.lit(True))
    marked = insights.join(old, "insight_id", "left").withColumn("expires_at", F.when(F.col("_hit"), now).otherwise(F.col("expires_at"))).drop("_hit")
    return marked.withColumn("supersedes", F.lit(None).cast("bigint")).unionByName(replacements, allowMissingColumns=True)


def feedback_evidence(rows: DataFrame, now: Column) -> DataFrame:
    """Approved, rejected and flagged counts of a result set as one evidence row."""
    from leadspan.functions.stats import count_if

    counts = rows.groupBy("result_set_id").agg(*[count_if(F.col("feedback") == f).alias(f) for f in ("approved", "rejected", "flagged")])
    total = F.col("approved") + F.col("rejected") + F.col("flagged")
    return counts.filter(F.col("approved") + F.col("rejected") > 0).select(
        F.lit("rlhf").alias("evidence_type"), F.col("result_set_id").alias("source_id"), F.lit("user_feedback").alias("metric"),
        "approved", "rejected", "flagged", total.alias("sample_size"), now.alias("observed_at"),
    )
