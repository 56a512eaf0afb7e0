"""Row filters and gates. Each keeps or labels whole rows and stays a plain predicate Spark can push down."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.normalize import email_domain, is_personal_domain, text, url_host
from leadspan.functions.schedule import days_elapsed
from leadspan.operators.terms import with_term_flag, with_value_flag

CONFIDENCE_LEVELS = ["hypothesis", "validated", "proven"]
# Hours a cached page stays valid, per content type.
CACHE_HOURS = {"company_page": 168, "blog_post": 24, "job_posting": 72, "press_release": 24, "social_profile": 168, "search_result": 24}
RESEARCH_CACHE_HOURS = 168


def _contains_any(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.lower(c).contains(t.lower())
    return out


def headline_of(df: DataFrame) -> Column:
    names = [F.col(n) for n in ("headline", "title") if n in df.columns]
    return text(F.coalesce(*names)) if names else F.lit("")


def passes_headline(df: DataFrame, rules: Sequence[str]) -> Column:
    """Any of the user's patterns, ignoring case; without rules everything passes."""
    if not rules:
        return F.lit(True)
    return headline_of(df).rlike("(?i)" + "|".join(f"(?:{r})" for r in rules))


def exclusion_text(df: DataFrame) -> Column:
    fields = [F.when(F.col(n) != "", F.col(n)) for n in ("first_name", "last_name", "headline", "company", "linkedin_url") if n in df.columns]
    return F.concat_ws(" ", *fields)


def excluded(df: DataFrame, terms: Sequence[str]) -> Column:
    return _contains_any(exclusion_text(df), terms)


def company_texts(df: DataFrame) -> tuple[Column, Column]:
    names = [F.col(n) for n in ("company", "company_name") if n in df.columns]
    company = text(F.coalesce(*names)) if names else F.lit("")
    return company, text(F.col("industry")) if "industry" in df.columns else F.lit("")


def company_disqualified(df: DataFrame, terms: Sequence[str]) -> Column:
    company, industry = company_texts(df)
    return _contains_any(company, terms) | _contains_any(industry, terms)


def lead_score(df: DataFrame) -> Column:
    names = [F.col(n) for n in ("icp_score", "qualification_score") if n in df.columns]
    return F.coalesce(*names, F.lit(0))


def gate_headline(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    return df.filter(passes_headline(df, rules))


def gate_exclusion(df: DataFrame, terms: Sequence[str] | DataFrame) -> DataFrame:
    """Rows without any of the terms; a long list comes as a table (term)."""
    if isinstance(terms, DataFrame):
        return with_term_flag(df, exclusion_text(df), terms, "_hit").filter("NOT _hit").drop("_hit")
    return df.filter(~excluded(df, terms))


def gate_company(df: DataFrame, terms: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(terms, DataFrame):
        company, industry = company_texts(df)
        flagged = with_term_flag(with_term_flag(df, company, terms, "_company"), industry, terms, "_industry")
        return flagged.filter("NOT _company AND NOT _industry").drop("_company", "_industry")
    return df.filter(~company_disqualified(df, terms))


def gate_score(df: DataFrame, minimum: int = 50) -> DataFrame:
    return df.filter(lead_score(df) >= minimum)


def filter_leads(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    for name, value in wanted.items():
        df = df.filter(F.lower(text(F.col(name).cast("string"))).contains(value.lower()))
    return df


def query_insights(
    df: DataFrame, tenant: str, category=None, segment=None, channel=None, source=None, minimum: str | None = None
) -> DataFrame:
    """Equality filters and a lowest confidence level; best score first."""
    out = df.filter(F.col("tenant_id") == tenant)
    for name, value in {"category": category, "segment": segment, "channel": channel, "source": source}.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    if minimum:
        out = out.filter(F.col("confidence").isin(CONFIDENCE_LEVELS[CONFIDENCE_LEVELS.index(minimum):]))
    return out.orderBy(F.col("confidence_score").desc())


def reply_targets(comments: DataFrame, own_author: str, exclude: Sequence[str] = (), include: Sequence[str] = ()) -> DataFrame:
    """Comments to answer: not our own, unanswered, author not excluded, keyword hit if keywords are given, id present."""
    keep = (F.col("author_id") != own_author) & (F.coalesce(F.col("reply_count"), F.lit(0)) == 0) & ~_contains_any(text(F.col("author_name")), exclude)
    if include:
        keep = keep & _contains_any(text(F.col("text")), include)
    return comments.filter(keep & ~text(F.col("comment_id")).isin("", "undefined", "null"))


def expire_reviews(df: DataFrame, now: Column) -> DataFrame:
    due = (F.col("status") == "pending") & F.coalesce(F.col("expires_at") < now, F.lit(False))
    return df.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def fresh_cache(df: DataFrame, now: Column, hours: Mapping[str, int] = CACHE_HOURS, default_hours: int = RESEARCH_CACHE_HOURS) -> DataFrame:
    """Rows still inside the time their content type allows, without any url of a host marked gated."""
    host = F.regexp_replace(url_host(F.col("url")), ":[0-9]*$", "")
    rows = df.withColumn("_host", host)
    gated = rows.filter(F.col("content_type") == "gated").select("_host").distinct()
    limit = F.when(F.lit(False), F.lit(0))
    for kind, h in hours.items():
        limit = limit.when(F.col("content_type") == kind, F.lit(h))
    age = F.unix_micros(now) - F.unix_micros("fetched_at")
    fresh = rows.filter((F.col("content_type") != "gated") & (age < limit.otherwise(F.lit(default_hours)) * F.lit(3_600_000_000)))
    return fresh.join(gated, "_host", "left_anti").drop("_host")


def email_eligible(df: DataFrame) -> DataFrame:
    status = F.coalesce("email_status", F.lit(""))
    return df.filter((text(F.col("email")) != "") & status.isin("", "valid", "unverified") & F.col("email_campaign_id").isNull())


def stale_status(now: Column) -> Column:
    """New status of a lead that waited too long, else null."""
    return F.when(
        (F.col("lifecycle_status") == "Connect_Sent") & days_elapsed(F.col("connect_sent_at"), F.lit(30), now), F.lit("Expired")
    ).when((F.col("lifecycle_status") == "DM2_Sent") & days_elapsed(F.col("dm2_sent_at"), F.lit(14), now), F.lit("No_Reply"))


def expire_leads(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumn("lifecycle_status", F.coalesce(stale_status(now), F.col("lifecycle_status")))


# Titles that pass, words that fail.
PASS_TITLES = [
    "CTO", "Chief Technology Officer", "VP Engineering", "VP of Engineering", "Head of Engineering", "Director of Engineering", "CPO",
    "Chief Product Officer", "VP Product", "Head of Product", "COO", "Chief Operating Officer", "Chief Digital Officer", "CDO",
    "Head of Digital Transformation", "Head of Delivery", "VP Delivery", "Technical Programme Manager",
]
FAIL_TITLE_WORDS = [
    "Intern", "Junior", "Associate", "Coordinator", "Sales", "Marketing", "Finance", "Legal", "HR", "Recruiter", "Consultant", "Student", "Graduate",
]

@dataclass(frozen=True)
class GateRules:
    """``competitors`` and ``blocked_domains`` may be tables (term)."""

    extra_titles: Sequence[str] = ()
    competitors: Sequence[str] | DataFrame = ()
    competitor_domains: Sequence[str] = ()
    blocked_domains: Sequence[str] | DataFrame = ()
    min_employees: int = 100
    max_employees: int = 10_000
    pass_titles: Sequence[str] = field(default_factory=lambda: PASS_TITLES)


def _word(terms: Sequence[str]) -> str:
    return r"(?i)\b(" + "|".join(re.escape(t) for t in terms) + r")\b"


def gate_rules(df: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """Adds ``failed_rule``: the first rule a lead breaks, or null."""
    columns = df.columns
    title, domain, size = headline_of(df), email_domain(F.trim(F.col("email"))), F.col("employees")
    competitor, blocked = F.lit(False), F.lit(False)
    if isinstance(rules.competitors, DataFrame):
        df, competitor = with_term_flag(df, text(F.col("company")), rules.competitors, "_competitor"), F.col("_competitor")
    else:
        competitor = _contains_any(text(F.col("company")), rules.competitors)
    if isinstance(rules.blocked_domains, DataFrame):
        df, blocked = with_value_flag(df, domain, rules.blocked_domains, "_blocked"), F.col("_blocked")
    elif rules.blocked_domains:
        blocked = domain.isin(list(rules.blocked_domains))
    failed = (
        F.when(~title.rlike(_word([*rules.pass_titles, *rules.extra_titles])), "title")
        .when(title.rlike(_word(FAIL_TITLE_WORDS)), "auto_fail_title")
        .when(((size < rules.min_employees) & ~F.col("has_funding_signal")) | (size > rules.max_employees), "company_size")
        .when(competitor | _contains_any(domain, rules.competitor_domains), "competitor")
        .when(blocked, "blocked_domain")
        .when(is_personal_domain(domain), "personal_email")
    )
    return df.withColumn("failed_rule", failed).select(*columns, "failed_rule")


def gate_cooldown(df: DataFrame, history: DataFrame, key: str, now: Column, contact_days: int = 90, negative_days: int = 180) -> DataFrame:
    """Drops leads contacted or refused recently, or still snoozed; dropped earlier leads never count."""
    recent = history.groupBy(key).agg(
        F.max(F.when(~F.col("dropped"), F.col("contacted_at"))).alias("_contacted"), F.max("negative_reply_at").alias("_negative"),
        F.max("snoozed_until").alias("_snoozed"),
    )
    blocked = (
        (F.col("_contacted") > F.timestamp_add("DAY", F.lit(-contact_days), now))
        | (F.col("_negative") > F.timestamp_add("DAY", F.lit(-negative_days), now)) | (F.col("_snoozed") >= now)
    )
    return df.join(recent, key, "left").filter(~F.coalesce(blocked, F.lit(False))).drop("_contacted", "_negative", "_snoozed")


def to_review(df: DataFrame, score: Column) -> DataFrame:
    """Review item of a scored lead: priority, hold flag and the texts shown to the reviewer."""
    name = F.trim(F.concat_ws(" ", "first_name", "last_name"))
    described = F.concat(text(F.col("headline")), F.lit(" @ "), F.coalesce("company", F.lit("Unknown")), F.lit(" — Score: "), score.cast("string"))
    return df.select(
        "*", F.lit("lead_qualification").alias("type"), name.alias("title"), described.alias("description"),
        F.coalesce(F.when(F.col("linkedin_url") != "", F.col("linkedin_url")), name).alias("source_id"),
        F.when(score >= 95, "high").otherwise("normal").alias("priority"), (score > 85).alias("hold"),
    )


def map_fields(df: DataFrame, explicit: Mapping[str, str] = {}, target: Sequence[str] = (), literals: Mapping[str, object] = {}) -> DataFrame:  # noqa: B006
    """Fields of the next step: literals win over explicit (dotted) sources, which win over same-named columns."""
    chosen: dict[str, Column] = {name: F.col(name) for name in target if name in df.columns}
    for source, name in explicit.items():
        if _has_path(df, source):
            chosen[name] = F.col(source)
    chosen.update({name: F.lit(value) for name, value in literals.items()})
    return df.select(*[c.alias(n) for n, c in chosen.items()])


def _has_path(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "names") or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True
