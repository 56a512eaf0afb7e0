"""Change detection for watched entities: newest observation against the watch's baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.operators.ranking import earliest_by

HIRING_DELTA = 5
KEY = ["entity_id", "signal_type"]
STATE = ["amount", "round_name", "title", "company"]


def baselines(observations: DataFrame) -> DataFrame:
    """State of each watch after its last observation so far."""
    newest = F.max_by(F.struct(*STATE, "observed_at"), F.struct("observed_at", "obs_id")).alias("_b")
    g = observations.groupBy(*KEY).agg(newest)
    return g.select(*KEY, *[F.col(f"_b.{c}").alias(f"base_{c}") for c in STATE], F.col("_b.observed_at").alias("last_checked_at"))


def detect_signals(watches: DataFrame, observations: DataFrame, hiring_delta: int = HIRING_DELTA) -> DataFrame:
    """One row per watch whose newest observation after the last check is a change, with the state to keep.

    Observations are reduced to one row per watch (combinable max_by) before they meet the watches.
    """
    stamped = observations.join(watches.select(*KEY, "last_checked_at"), KEY).filter(F.col("observed_at") > F.col("last_checked_at"))
    latest = stamped.groupBy(*KEY).agg(
        F.max_by(F.struct(*STATE, "observed_at"), F.struct("observed_at", "obs_id")).alias("_n"), F.count(F.lit(1)).alias("new_items")
    )
    j = watches.join(latest, KEY)
    kind = F.col("signal_type")
    other = lambda c: ~F.col(f"_n.{c}").eqNullSafe(F.col(f"base_{c}"))
    delta = F.col("_n.amount") - F.col("base_amount")
    moved = F.when(other("company") & other("title"), "both").when(other("company"), "company").when(other("title"), "title")
    detail = (
        F.when(kind == "funding", F.when(delta > 0, "funding_total").when(other("round_name"), "new_round"))
        .when(kind == "hiring-surge", F.when(delta >= hiring_delta, "surge"))
        .when(kind == "job-change", moved)
        .when(kind == "news", "items")
    )
    return j.withColumn("detail", detail).filter("detail IS NOT NULL").select(
        *KEY, "detail", delta.alias("delta"), "new_items", F.col("_n.observed_at").alias("detected_at"), *[F.col(f"_n.{c}").alias(f"base_{c}") for c in STATE]
    )


def next_watches(watches: DataFrame, signals: DataFrame) -> DataFrame:
    """Watches with the baseline of their signal, if one fired."""
    new = signals.select(*KEY, F.struct(*[f"base_{c}" for c in STATE], F.col("detected_at").alias("last_checked_at")).alias("_s"))
    cols = [*[f"base_{c}" for c in STATE], "last_checked_at"]
    fired = F.col("_s").isNotNull()
    return watches.join(new, KEY, "left").select(*KEY, *[F.when(fired, F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def dedup_signals(signals: DataFrame, day: Column) -> DataFrame:
    """First signal per tenant, entity, type and UTC day."""
    keyed = signals.withColumn("signal_day", F.date_format(day, "yyyy-MM-dd"))
    return earliest_by(keyed, ["tenant_id", *KEY, "signal_day"], F.struct("detected_at", "obs_id"))
