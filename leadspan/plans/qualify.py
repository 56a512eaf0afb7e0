"""The qualification funnel as one plan: every lead keeps its row and learns the first gate it failed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.normalize import text
from leadspan.functions.segments import score_band
from leadspan.functions.stats import count_if
from leadspan.operators.filters import company_disqualified, excluded, passes_headline
from leadspan.operators.linkage import DedupConfig, dedup_leads
from leadspan.operators.ranking import earliest_by

GATES = ["dedup", "headline", "exclusion", "company", "score"]


@dataclass(frozen=True)
class Rules:
    headline: Sequence[str] = ()
    exclusions: Sequence[str] = ()
    disqualifiers: Sequence[str] = ()
    min_score: int = 50
    dedup: DedupConfig = DedupConfig()


def score_leads(leads: DataFrame, score: Column) -> DataFrame:
    """Rule score with its band; a lead without score counts as 50."""
    s = F.coalesce(score, F.lit(50))
    return leads.withColumn("icp_score", s).withColumn("icp_fit", score_band(s))


def enrich_bare(leads: DataFrame, profiles: DataFrame, lead_id: str = "lead_id", order: str = "profile_no") -> DataFrame:
    """Company and industry for leads that have neither, from the first profile of the same url, else provider id."""
    values = ["company", "industry"]
    by_url = earliest_by(profiles.filter("linkedin_url <> ''").select("linkedin_url", order, *values), ["linkedin_url"], F.col(order)).select("linkedin_url", F.struct(*values).alias("_u"))
    by_id = earliest_by(profiles.filter("provider_id <> ''").select("provider_id", order, *values), ["provider_id"], F.col(order)).select("provider_id", F.struct(*values).alias("_p"))
    # only bare leads have a key to look up; the others get one of their own that matches nothing
    bare = (text(F.col("company")) == "") & (text(F.col("industry")) == "")
    own = F.concat(F.lit("\u0000"), F.col(lead_id).cast("string"))
    key = lambda c: F.when(bare & (text(F.col(c)) != ""), F.col(c)).otherwise(own)
    keyed = leads.withColumns({"_url": key("linkedin_url"), "_id": key("provider_id")})
    j = keyed.join(by_url.withColumnRenamed("linkedin_url", "_url"), "_url", "left").join(by_id.withColumnRenamed("provider_id", "_id"), "_id", "left")
    j = j.withColumn("_r", F.coalesce("_u", "_p"))
    return j.select(*[F.when(bare, F.coalesce(F.col(f"_r.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in leads.columns])


def qualify(leads: DataFrame, suppression: DataFrame, rules: Rules, score: Callable[[DataFrame], Column], lead_id: str = "lead_id", profiles: DataFrame | None = None) -> DataFrame:
    """Every lead with ``failed_gate`` (null when qualified), its match and its score.

    Gates in order: suppression match, headline, exclusion terms, company terms, (fill bare leads), score. An
    uncertain match is kept.
    """
    checked = dedup_leads(leads, suppression, lead_id, rules.dedup)
    early = (
        F.when(F.col("verdict") == "duplicate", "dedup").when(~passes_headline(leads, rules.headline), "headline")
        .when(excluded(leads, rules.exclusions), "exclusion").when(company_disqualified(leads, rules.disqualifiers), "company")
    )
    gated = checked.withColumn("failed_gate", early)
    if profiles is not None:
        gated = enrich_bare(gated, profiles, lead_id)
    scored = score_leads(gated, score(gated))
    failed = F.coalesce("failed_gate", F.when(F.col("icp_score") < rules.min_score, "score"))
    return scored.withColumn("failed_gate", failed).withColumn("lifecycle_status", F.when(failed.isNull(), "Qualified"))


def gate_summary(qualified: DataFrame, by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    return qualified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"), *[count_if(F.col("failed_gate") == g).alias(f"failed_{g}") for g in GATES],
        count_if(F.col("failed_gate").isNull()).alias("qualified"),
    )
