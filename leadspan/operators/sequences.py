"""Multi-channel sequences: next step per lead, assignment of variants and templates, planned actions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.conditions import channel_states, step_condition
from leadspan.functions.messages import broken_rules, render
from leadspan.functions.normalize import text
from leadspan.functions.schedule import days_since
from leadspan.operators.admission import DAILY_LIMITS, DEFAULT_LIMIT, limit_of
from leadspan.operators.ranking import computed, ordinals, top_k


@dataclass(frozen=True)
class Step:
    day: int
    channel: str
    action: str
    template: str | None = None
    condition: str | None = None
    subject: str | None = None


def next_step(leads: DataFrame, steps: Sequence[Step], now: Column, current: Column | None = None) -> DataFrame:
    """Adds ``days``, ``states`` and ``step_index`` of the next due step (null when none is due).

    Steps are taken in day order from ``current``; a bounced address skips email steps; a reply, pause or completion
    ends the sequence. The steps are configuration, so they become one expression per lead.
    """
    ordered = sorted(steps, key=lambda s: s.day)
    at = F.lit(0) if current is None else current
    base = computed(leads, states=channel_states(), days=days_since(F.col("started_at"), now))
    bounced = F.col("states.email.bounced")
    options = []
    for i, s in enumerate(ordered):
        due = (at <= i) & (F.col("days") >= s.day) & step_condition(s.condition)
        if s.channel == "email":
            due = due & ~bounced
        options.append(F.when(due, F.lit(i)))
    stopped = F.col("states.email.replied") | F.col("states.linkedin.replied")
    for c in ("paused_at", "completed_at"):
        if c in leads.columns:
            stopped = stopped | F.col(c).isNotNull()
    return computed(base, step_index=F.when(~stopped, F.coalesce(*options)))


def plan_sequence(leads: DataFrame, steps: Sequence[Step], now: Column, order: str = "lead_id", limits=DAILY_LIMITS) -> DataFrame:
    """One action row per lead: what to do on which channel, and why not when it is not sent.

    Sends are granted in lead order up to the daily cap of the channel; email rows carry the subject they are grouped by.
    """
    ordered = sorted(steps, key=lambda s: s.day)
    field = lambda name: F.element_at(F.lit([getattr(s, name) for s in ordered]) if name == "day" else F.array(*[F.lit(getattr(s, name)).cast("string") for s in ordered]), F.col("step_index") + 1)
    p = next_step(leads, steps, now)
    due = F.col("step_index").isNotNull()
    p = computed(
        p, day=F.when(due, field("day")).otherwise(F.col("days")), channel=F.when(due, field("channel")).otherwise("-"),
        action=F.when(due, field("action")).otherwise("skip"), _template=F.when(due, field("template")), _subject=F.when(due, field("subject")),
    )
    p = computed(p, message=F.when(F.col("_template") != "", render(F.col("_template"), {c: F.col(c) for c in ("first_name", "last_name", "company", "headline")})))
    no_message, bad = text(F.col("message")) == "", F.size(broken_rules(text(F.col("message")))) > 0
    no_id = text(F.col("provider_id")) == ""
    replied = F.col("states.email.replied") | F.col("states.linkedin.replied")
    linkedin = (
        F.when(F.col("action") == "connect", F.when(no_id, "skipped_no_provider_id").when(~no_message & bad, "blocked_validator").otherwise("want:linkedin.connect"))
        .when(F.col("action") == "dm", F.when(no_message, "skipped_no_template").when(no_id, "skipped_no_provider_id").when(bad, "blocked_validator").otherwise("want:linkedin.dm"))
        .when(F.col("action") == "view_profile", "logged").otherwise("sent")
    )
    email = F.when(text(F.col("email")) == "", "skipped_no_email").when(no_message, "skipped_no_template").when(bad, "blocked_validator").otherwise("want:email.send")
    status = (
        F.when(~due, F.when(replied, "replied").otherwise("waiting")).when(F.col("channel") == "linkedin", linkedin).when(F.col("channel") == "email", email)
        .otherwise("channel_not_supported")
    )
    p = computed(p, _status=status)
    wanting = p.filter(F.col("_status").startswith("want:")).select("tenant_id", "lead_id", "_status", *([order] if order != "lead_id" else []))
    first = top_k(wanting, ["tenant_id", "_status"], [F.col(order)], max([*limits.values(), DEFAULT_LIMIT]))
    granted = first.filter(F.col("rn") <= limit_of(F.substring("_status", 6, 40), limits)).select("lead_id")
    j = p.join(granted.withColumn("_ok", F.lit(True)), "lead_id", "left")
    asked = F.col("_status").startswith("want:")
    final = F.when(asked & F.col("_ok").isNull(), "rate_limited").when(F.col("_status") == "want:email.send", "queued_email").when(asked, "sent").otherwise(F.col("_status"))
    first_line = F.substring(F.split("_template", "\n")[0], 1, 80)
    return j.select(
        "tenant_id", "lead_id", "day", "channel", "action", final.alias("status"), "message",
        F.when(F.col("channel") == "email", F.coalesce(F.when(F.col("_subject") != "", F.col("_subject")), first_line)).alias("email_subject"),
    )


def assign_variants(leads: DataFrame, variants: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Round-robin by position in the group, without one task per group."""
    numbered = ordinals(leads, keys, order, "position")
    return numbered.withColumn("variant", F.element_at(F.lit(list(variants)), (F.col("position") % len(variants) + 1).cast("int")))


def rotate_templates(targets: DataFrame, templates: Sequence[str], keys: Sequence[str], order: Sequence[str], name: Column) -> DataFrame:
    """Templates in turn over the targets, with the author's first name filled in."""
    numbered = ordinals(targets, keys, order, "position")
    chosen = F.element_at(F.lit(list(templates)), (F.col("position") % len(templates) + 1).cast("int"))
    return numbered.withColumn("reply_text", render(chosen, {"name": F.split(name, " ")[0]}))


def create_campaign(leads: DataFrame, variants: Sequence[str], wanted: dict[str, str], campaign_id: int, order: str = "lead_id") -> DataFrame:
    """Qualified leads that pass the field filter, queued in the new campaign with a variant each."""
    from leadspan.operators.filters import filter_leads

    pool = filter_leads(leads.filter("lifecycle_status = 'Qualified'"), wanted)
    out = assign_variants(pool, variants, ["tenant_id"], [order])
    return out.withColumn("campaign_id", F.lit(campaign_id)).withColumn("lifecycle_status", F.lit("Queued"))
