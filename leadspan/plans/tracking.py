"""One tracking run: from a snapshot of leads and what came in since, the next snapshot and the actions to take.

All phases look at the same snapshot: a lead accepted now gets its first message in a later run, and staleness, the
last phase, overrides an acceptance or reply found in the same run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.messages import broken_rules, render
from leadspan.functions.normalize import text
from leadspan.functions.schedule import delay_elapsed, send_window, should_activate
from leadspan.operators.admission import DAILY_LIMITS, DEFAULT_LIMIT, connect_budget, limit_of
from leadspan.operators.filters import stale_status
from leadspan.operators.matching import accepted, apply_email_status, blocked, replies
from leadspan.operators.ranking import computed, top_k

MERGE_FIELDS = ("first_name", "last_name", "company", "headline")


def activate(campaigns: DataFrame, now: Column) -> DataFrame:
    due = (F.col("status") == "scheduled") & should_activate(now, F.col("timezone"), F.col("start_at"))
    return campaigns.withColumn("status", F.when(due, "active").otherwise(F.col("status")))


def open_campaigns(campaigns: DataFrame, now: Column) -> DataFrame:
    allowed, _ = send_window(now, F.col("timezone"), F.col("active_days"), F.col("window_start"), F.col("window_end"))
    return activate(campaigns, now).filter((F.col("status") == "active") & allowed)


def track(
    leads: DataFrame, campaigns: DataFrame, variants: DataFrame, relations: DataFrame, chats: DataFrame, blocklist: DataFrame, now: Column,
    dm1_days: int = 2, dm2_days: int = 3, limits=DAILY_LIMITS,
) -> DataFrame:
    """Leads of the open campaigns with ``action`` (null when nothing happens) and ``next_status``.

    ``variants`` carry connect_note, dm1_template and dm2_template. Sends are capped per tenant and day; within the cap
    first messages go before second ones, in lead order.
    """
    chosen = open_campaigns(campaigns, now).select("campaign_id", "delay_mode", "active_days", "timezone", "daily_limit")
    now_open = leads.join(chosen.select("campaign_id"), "campaign_id", "left_semi")
    got_in = accepted(now_open, relations).select("lead_id", F.lit(True).alias("_accepted"))
    answered = replies(now_open, chats).select("lead_id", F.lit(True).alias("_replied"))
    history = leads.join(answered, "lead_id", "left").withColumn("replied_at", F.coalesce("replied_at", F.when(F.col("_replied"), now)))
    stop = blocked(now_open, history, blocklist).select("lead_id", F.lit(True).alias("_blocked"))
    slots = connect_budget(now_open, chosen, now).select("lead_id", F.lit(True).alias("_slot"))
    arms = variants.select("tenant_id", "variant_id", "connect_note", "dm1_template", "dm2_template")
    rows = (
        now_open.join(got_in, "lead_id", "left").join(answered, "lead_id", "left").join(stop, "lead_id", "left").join(slots, "lead_id", "left")
        .join(chosen.drop("daily_limit"), "campaign_id").join(arms, ["tenant_id", "variant_id"], "left")
    )
    status = F.col("lifecycle_status")
    wait = lambda ts, days: delay_elapsed(F.col(ts), days, F.col("delay_mode"), F.col("active_days"), F.col("timezone"), now)
    wanted = (
        F.when((status == "Connected") & wait("connected_at", dm1_days), "dm1").when((status == "DM1_Sent") & wait("dm1_sent_at", dm2_days), "dm2")
        .when((status == "Queued") & F.col("_slot"), "connect")
    )
    rows = computed(rows, _want=wanted)
    template = F.when(F.col("_want") == "dm1", F.col("dm1_template")).when(F.col("_want") == "dm2", F.col("dm2_template")).when(F.col("_want") == "connect", F.col("connect_note"))
    rows = computed(rows, message=render(template, {c: F.col(c) for c in MERGE_FIELDS}))
    silent = text(F.col("message")) == ""
    fine = ~silent & (F.size(broken_rules(text(F.col("message")))) == 0)
    may = F.when(F.col("_blocked"), "skipped_blocked").when((F.col("_want") != "connect") & ~fine, "skipped_message").when(F.col("_want").isNotNull(), F.col("_want"))
    rows = computed(rows, _may=F.when(F.col("_want").isNotNull(), may))
    channel = F.when(F.col("_may") == "connect", "linkedin.connect").otherwise("linkedin.dm")
    asks = rows.filter(F.col("_may").isin("dm1", "dm2", "connect")).select("tenant_id", "lead_id", channel.alias("provider"), F.when(F.col("_may") == "dm2", 1).otherwise(0).alias("_second"))
    first = top_k(asks, ["tenant_id", "provider"], [F.col("_second"), F.col("lead_id")], max([*limits.values(), DEFAULT_LIMIT]))
    granted = first.filter(F.col("rn") <= limit_of(F.col("provider"), limits)).select("lead_id", F.lit(True).alias("_granted"))
    rows = rows.join(granted, "lead_id", "left")
    asked = F.col("_may").isin("dm1", "dm2", "connect")
    action = F.when(asked & F.col("_granted").isNull(), "rate_limited").otherwise(F.col("_may"))
    sent = F.when(action == "dm1", "DM1_Sent").when(action == "dm2", "DM2_Sent").when(action == "connect", "Connect_Sent")
    found = F.when(F.col("_accepted"), "Connected").when(F.col("_replied"), "Replied")
    out = rows.withColumn("action", F.coalesce(action, F.when(F.col("_accepted"), "accepted").when(F.col("_replied"), "replied"), F.when(stale_status(now).isNotNull(), "expired")))
    return out.withColumn("next_status", F.coalesce(stale_status(now), sent, found, status)).select(*leads.columns, "action", "next_status", "message")


def next_snapshot(leads: DataFrame, tracked: DataFrame, now: Column) -> DataFrame:
    """All leads with the outcome of the run applied; leads of closed campaigns stay as they are."""
    t = tracked.select("lead_id", "next_status", F.col("action").alias("_action"))
    j = leads.join(t, "lead_id", "left")
    stamp = lambda c, name: F.when(F.col("_action") == name, now).otherwise(F.col(c)).alias(c)
    stamps = {"connected_at": "accepted", "replied_at": "replied", "dm1_sent_at": "dm1", "dm2_sent_at": "dm2", "connect_sent_at": "connect"}
    changed = F.col("next_status").isNotNull() & (F.col("next_status") != F.col("lifecycle_status"))
    cols = []
    for c in leads.columns:
        if c in stamps:
            cols.append(stamp(c, stamps[c]))
        elif c == "lifecycle_status":
            cols.append(F.coalesce("next_status", "lifecycle_status").alias(c))
        elif c == "updated_at":
            cols.append(F.when(changed, now).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def track_run(leads, campaigns, variants, relations, chats, blocklist, email_statuses, now) -> DataFrame:
    """A whole run: lifecycle first, email events after it."""
    moved = next_snapshot(leads, track(leads, campaigns, variants, relations, chats, blocklist, now), now)
    return apply_email_status(moved, email_statuses, now)
