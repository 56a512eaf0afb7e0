"""Matching leads against a suppression list: exact keys, fuzzy name + company, same domain + similar title."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.normalize import email_domain, norm_email, norm_linkedin, text
from leadspan.functions.stats import js_round
from leadspan.operators.simjoin import as_text, best_dice

# Order in which matchers win ties on the same suppression row.
MATCHERS = ["email", "linkedin", "fuzzy_name_company", "domain_title"]
SUPPRESSION_COLUMNS = ["ord", "entry_id", "tenant_id", "email", "linkedin_url", "first_name", "last_name", "headline", "company", "source"]
REPLIED_STATUSES = ["Replied", "Demo_Booked", "Deal_Created", "Closed_Won"]
OPEN_CAMPAIGNS = ["active", "running", "draft"]


@dataclass(frozen=True)
class DedupConfig:
    fuzzy_threshold: float = 0.8
    title_threshold: float = 0.7
    review_from: int = 60
    duplicate_from: int = 80
    matchers: Sequence[str] = tuple(MATCHERS)


def _full_name(df_cols: Sequence[str]) -> Column:
    return as_text(F.concat(text(F.col("first_name")), F.lit(" "), text(F.col("last_name")), F.lit(" "), text(F.col("company"))))


def _keys(df: DataFrame, title: Column) -> DataFrame:
    return df.select(
        "*", norm_email(F.col("email")).alias("_email"), norm_linkedin(F.col("linkedin_url")).alias("_url"), _full_name(df.columns).alias("_name"),
        email_domain(F.col("email")).alias("_domain"), as_text(text(title)).alias("_title"),
    )


def _first_entries(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Earliest suppression row per key value: later rows with the same value can never be the best match."""
    kept = entries
    for k in keys:
        kept = kept.filter(F.col(k) != "")
    return kept.groupBy("tenant_id", *keys).agg(F.min("ord").alias("ord"))


def match_candidates(leads: DataFrame, suppression: DataFrame, lead_id: str, config: DedupConfig = DedupConfig()) -> DataFrame:
    """Best suppression row per lead and matcher: tenant_id, lead id, matcher, confidence, ord.

    Both sides are reduced to distinct key values before any join, so equal values (a hot domain, a hot title)
    meet once, and each lead picks up its result through an equi-join on its own value.
    """
    left = _keys(leads, F.coalesce("headline", "title") if "title" in leads.columns else F.col("headline"))
    right = _keys(suppression, F.col("headline"))
    found: list[DataFrame] = []

    def exact(matcher: str, key: str, confidence: int) -> None:
        hits = left.filter(F.col(key) != "").select("tenant_id", lead_id, key).join(_first_entries(right, [key]), ["tenant_id", key])
        found.append(hits.select("tenant_id", lead_id, F.lit(matcher).alias("matcher"), F.lit(confidence).cast("bigint").alias("confidence"), "ord"))

    def similar(matcher: str, keys: Sequence[str], value: str, threshold: float, confidence) -> None:
        named = [F.col(k) for k in keys] + [F.col(value).alias("text")]
        has_all = F.col(value) != ""
        for k in keys:
            has_all = has_all & (F.col(k) != "")
        best = best_dice(left.filter(has_all).select("tenant_id", *named), _first_entries(right, [*keys, value]).withColumnRenamed(value, "text"), threshold, confidence, ["tenant_id", *keys])
        hits = left.filter(has_all).select("tenant_id", lead_id, *keys, value).join(best.withColumnRenamed("text", value), ["tenant_id", *keys, value])
        found.append(hits.select("tenant_id", lead_id, F.lit(matcher).alias("matcher"), "confidence", "ord"))

    if "email" in config.matchers:
        exact("email", "_email", 100)
    if "linkedin" in config.matchers:
        exact("linkedin", "_url", 95)
    if "fuzzy_name_company" in config.matchers:
        similar("fuzzy_name_company", [], "_name", config.fuzzy_threshold, lambda s: js_round(s * 100))
    if "domain_title" in config.matchers:
        similar("domain_title", ["_domain"], "_title", config.title_threshold, lambda s: js_round(s * 25 + 70))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def best_match(candidates: DataFrame, lead_id: str) -> DataFrame:
    """Highest confidence per lead; ties go to the earliest suppression row, then to the matcher order."""
    order = F.array_position(F.lit(MATCHERS), F.col("matcher"))
    best = candidates.groupBy("tenant_id", lead_id).agg(F.max_by(F.struct("matcher", "confidence", "ord"), F.struct("confidence", -F.col("ord"), -order)).alias("m"))
    return best.select("tenant_id", lead_id, "m.matcher", "m.confidence", "m.ord")


def split_label(confidence: Column, config: DedupConfig = DedupConfig()) -> Column:
    return (
        F.when(confidence >= config.duplicate_from, "duplicate").when(confidence >= config.review_from, "pending_review").otherwise("unique")
    )


def dedup_leads(leads: DataFrame, suppression: DataFrame, lead_id: str = "lead_id", config: DedupConfig = DedupConfig()) -> DataFrame:
    """Every lead with its verdict (duplicate, pending_review, unique) and the match behind it."""
    best = best_match(match_candidates(leads, suppression, lead_id, config), lead_id)
    entries = suppression.select("tenant_id", "ord", F.col("entry_id").alias("matched_id"), F.col("source").alias("matched_source"))
    named = best.join(entries, ["tenant_id", "ord"], "left")
    joined = leads.join(named.withColumnRenamed("ord", "matched_ord"), ["tenant_id", lead_id], "left")
    return joined.withColumn("verdict", split_label(F.col("confidence"), config))


def suppression_set(
    leads: DataFrame | None = None, campaigns: DataFrame | None = None, crm: DataFrame | None = None, blocklist: DataFrame | None = None,
    external: DataFrame | None = None,
) -> DataFrame:
    """Union of the suppression sources in their fixed order; ``ord`` is unique and follows that order.

    ``crm`` has tenant_id and item (an email, or a domain, which goes into company). The blocklist keeps its email
    where it has one. Positions inside a source follow the source's own id column.
    """
    parts: list[DataFrame] = []

    def add(df: DataFrame, order: Column, source: str) -> None:
        have = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in SUPPRESSION_COLUMNS if c not in ("ord", "source")}
        slot = len(parts)
        parts.append(df.select((F.lit(slot).cast("bigint") * F.lit(10**15) + order.cast("bigint")).alias("ord"), *[c.cast("string").alias(n) for n, c in have.items()], F.lit(source).alias("source")))

    if leads is not None and campaigns is not None:
        open_ids = campaigns.filter(F.col("status").isin(OPEN_CAMPAIGNS)).select("tenant_id", "campaign_id")
        add(leads.join(open_ids, ["tenant_id", "campaign_id"], "left_semi").withColumn("entry_id", F.col("lead_id")), F.col("lead_id"), "campaign_active")
    if leads is not None:
        add(leads.filter(F.col("lifecycle_status").isin(REPLIED_STATUSES)).withColumn("entry_id", F.col("lead_id")), F.col("lead_id"), "campaign_replied")
    if crm is not None:
        is_email = F.col("item").contains("@")
        typed = crm.withColumn("entry_id", F.concat(F.lit("crm:"), "item")).withColumn("email", F.when(is_email, F.col("item"))).withColumn("company", F.when(~is_email, F.col("item")))
        add(typed, F.col("item_no"), "crm")
    if blocklist is not None:
        words = F.split("name", " ")
        named = (
            blocklist.withColumn("entry_id", F.col("block_id")).withColumn("first_name", words[0])
            .withColumn("last_name", F.array_join(F.slice(words, F.lit(2), F.size(words)), " "))
        )
        add(named, F.col("block_id"), "blocklist")
    if external is not None:
        add(external, F.col("ord"), "external")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
