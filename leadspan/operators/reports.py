"""Campaign reporting: every section for all campaigns at once, one aggregation per section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.segments import segment_of
from leadspan.functions.stats import ab_test, count_if, js_round, pearson, rate1, ratio
from leadspan.operators.ranking import top_k

# Funnel order; statuses outside it count only in the total.
FUNNEL_STAGES = [
    "Queued", "Connect_Sent", "Connected", "DM1_Sent", "DM2_Sent", "Replied", "Demo_Booked", "Deal_Created", "Closed_Won",
]
SCORE_RANGES = [("0-20", 0, 20), ("21-40", 21, 40), ("41-60", 41, 60), ("61-80", 61, 80), ("81-100", 81, 100)]
DEMO_STATUSES = ["Demo_Booked", "Deal_Created", "Closed_Won"]
ACCEPTED_STATUSES = ["Connected", "DM1_Sent", "DM2_Sent", "Replied", "Demo_Booked"]


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b, null unless b is later."""
    micros = F.unix_micros(b) - F.unix_micros(a)
    return F.when(micros > 0, micros / F.lit(3.6e9))


def week_start(ts: Column) -> Column:
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def iso_week(ts: Column) -> Column:
    year = F.extract(F.lit("YEAROFWEEK"), ts)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def funnel(leads: DataFrame, by: Sequence[str] = ("campaign_id",)) -> DataFrame:
    """Cumulative stage counts with the drop-off from the stage before, one row per group and stage."""
    rank = F.array_position(F.lit(FUNNEL_STAGES), F.col("lifecycle_status"))
    counts = leads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_leads"),
        *[count_if(rank > i).alias(f"_s{i}") for i in range(len(FUNNEL_STAGES))],
    )
    reached = [F.col(f"_s{i}") for i in range(len(FUNNEL_STAGES))]
    stages = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_index"),
                F.lit(stage).alias("stage"),
                reached[i].alias("stage_count"),
                rate1((reached[i - 1] if i else F.col("total_leads")) - reached[i], reached[i - 1] if i else F.col("total_leads")).alias("dropoff_rate"),
            )
            for i, stage in enumerate(FUNNEL_STAGES)
        ]
    )
    return counts.select(
        *by, "total_leads", rate1(reached[-1], F.col("total_leads")).alias("overall_conversion_rate"), F.inline(stages)
    )


def variant_stats(leads: DataFrame, variants: DataFrame) -> DataFrame:
    accept = hours_between(F.col("connect_sent_at"), F.col("connected_at"))
    reply = hours_between(F.col("dm1_sent_at"), F.col("replied_at"))
    stats = leads.groupBy("tenant_id", "variant_id").agg(
        F.count("connect_sent_at").alias("sends"),
        F.count("connected_at").alias("accepts"),
        F.count("dm1_sent_at").alias("dms_sent"),
        F.count("replied_at").alias("replies"),
        F.count(F.lit(1)).alias("leads_assigned"),
        F.avg(accept).alias("_accept"),
        F.avg(reply).alias("_reply"),
    )
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("sends", "accepts", "dms_sent", "replies", "leads_assigned")]
    return (
        variants.select("tenant_id", "campaign_id", "variant_id", "name")
        .join(stats, ["tenant_id", "variant_id"], "left")
        .select("campaign_id", "variant_id", "name", *zero, "_accept", "_reply")
        .select(
            "campaign_id", "variant_id", "name", "sends", "accepts", rate1(F.col("accepts"), F.col("sends")).alias("accept_rate"),
            "dms_sent", "replies", rate1(F.col("replies"), F.col("dms_sent")).alias("reply_rate"), "leads_assigned",
            (js_round(F.col("_accept") * 10) / 10).alias("avg_hours_to_accept"),
            (js_round(F.col("_reply") * 10) / 10).alias("avg_hours_to_reply"),
        )
    )


def breakdown(leads: DataFrame, key: str, by: Sequence[str] = ("campaign_id",)) -> DataFrame:
    """Count with acceptance and reply percentages per value of ``key``."""
    return leads.groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("lead_count"),
        rate1(F.count("connected_at"), F.count(F.lit(1))).alias("accept_rate"),
        rate1(F.count("replied_at"), F.count(F.lit(1))).alias("reply_rate"),
    )


def tag_stats(leads: DataFrame, by: Sequence[str] = ("campaign_id",)) -> DataFrame:
    return breakdown(leads.select(*by, "connected_at", "replied_at", F.explode("tags").alias("tag")), "tag", by)


def source_stats(leads: DataFrame, by: Sequence[str] = ("campaign_id",)) -> DataFrame:
    return breakdown(leads.withColumn("source", F.coalesce("source", F.lit("unknown"))), "source", by)


def segment_stats(leads: DataFrame, by: Sequence[str] = ("campaign_id",)) -> DataFrame:
    return breakdown(leads.withColumn("segment", segment_of(F.col("headline"))), "segment", by)


def score_buckets(leads: DataFrame, by: Sequence[str] = ("campaign_id",)) -> DataFrame:
    """Five fixed ranges per group, also those without leads; a missing score counts as 0."""
    score = F.coalesce(F.col("qualification_score"), F.lit(0))
    aggs = []
    for i, (_, low, high) in enumerate(SCORE_RANGES):
        inside = score.between(low, high)
        aggs += [
            count_if(inside).alias(f"_n{i}"),
            count_if(inside & F.col("connected_at").isNotNull()).alias(f"_a{i}"),
            count_if(inside & F.col("replied_at").isNotNull()).alias(f"_r{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("score_range"), F.col(f"_n{i}").alias("lead_count"),
                rate1(F.col(f"_a{i}"), F.col(f"_n{i}")).alias("accept_rate"), rate1(F.col(f"_r{i}"), F.col(f"_n{i}")).alias("reply_rate"),
            )
            for i, (label, _, _) in enumerate(SCORE_RANGES)
        ]
    )
    return leads.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))


def score_correlation(leads: DataFrame, by: Sequence[str] = ("campaign_id",)) -> DataFrame:
    outcome = F.when(F.col("replied_at").isNotNull(), 1.0).when(F.col("connected_at").isNotNull(), 0.5).otherwise(0.0)
    return leads.groupBy(*by).agg(pearson(F.col("qualification_score"), outcome).alias("pearson"))


def weekly_trend(leads: DataFrame, by: Sequence[str] = ("campaign_id",)) -> DataFrame:
    sent = leads.filter(F.col("connect_sent_at").isNotNull()).withColumn("week_start", week_start(F.col("connect_sent_at")))
    grouped = sent.groupBy(*by, "week_start").agg(
        F.count(F.lit(1)).alias("sends"), F.count("connected_at").alias("accepts"), F.count("replied_at").alias("replies")
    )
    return grouped.select(
        "*", rate1(F.col("accepts"), F.col("sends")).alias("accept_rate"), rate1(F.col("replies"), F.col("sends")).alias("reply_rate")
    )


def declare_winner(stats: DataFrame, min_dms: int = 15, multiplier: float = 1.5) -> DataFrame:
    """Best variant per campaign when its reply rate leads the runner-up by the multiplier."""
    order = [F.col("reply_rate").desc(), F.col("variant_id")]
    pair = top_k(stats.filter(F.col("dms_sent") >= min_dms), ["campaign_id"], order, 2)
    both = pair.groupBy("campaign_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("name"))).alias("winner"),
        F.max(F.when(F.col("rn") == 1, F.col("reply_rate"))).alias("best_reply_rate"),
        F.max(F.when(F.col("rn") == 2, F.col("reply_rate"))).alias("runner_up_reply_rate"),
    )
    best, second = F.col("best_reply_rate"), F.col("runner_up_reply_rate")
    margin = F.try_divide(best, second)
    wins = F.when(second == 0, best > 0).otherwise(margin >= multiplier)
    return both.filter(second.isNotNull() & wins).select(
        "campaign_id", "winner", F.when(second == 0, F.lit(100)).otherwise(js_round((margin - 1) * 100)).cast("bigint").alias("margin_percent"),
        "best_reply_rate", "runner_up_reply_rate",
    )


def variant_recount(leads: DataFrame, variants: DataFrame) -> DataFrame:
    """Stored counters: fractions, and replies without those that came by email."""
    stats = leads.groupBy("tenant_id", "variant_id").agg(
        F.count("connect_sent_at").alias("sends"), F.count("connected_at").alias("accepts"), F.count("dm1_sent_at").alias("dms_sent"),
        count_if(F.col("replied_at").isNotNull() & F.col("email_replied_at").isNull()).alias("replies"),
    )
    counts = ("sends", "accepts", "dms_sent", "replies")
    full = variants.join(stats, ["tenant_id", "variant_id"], "left").select(
        "tenant_id", "campaign_id", "variant_id", "name", "position", "status", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts]
    )
    return full.select(
        "*", ratio(F.col("accepts"), F.col("sends")).alias("accept_rate"), ratio(F.col("replies"), F.col("dms_sent")).alias("reply_rate")
    )


def variant_pairs(variants: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Each unordered pair of arms of one experiment, as ``a_*`` and ``b_*`` columns.

    The pairs are the report itself (one row per comparison); arms per experiment are few by nature.
    """
    rest = [c for c in variants.columns if c not in keys]
    left = variants.select(*keys, *[F.col(c).alias(f"a_{c}") for c in rest])
    right = variants.select(*keys, *[F.col(c).alias(f"b_{c}") for c in rest])
    return left.join(right, list(keys)).filter(F.col(f"a_{order}") < F.col(f"b_{order}"))


def ab_verdicts(recounted: DataFrame) -> DataFrame:
    """Significance of each pair of active arms; conversions are replies, trials are sends."""
    arms = recounted.filter(F.col("status") == "active").select("campaign_id", "variant_id", "position", "name", "sends", "replies")
    test = ab_test(F.col("a_sends"), F.col("a_replies"), F.col("b_sends"), F.col("b_replies"))
    tested = variant_pairs(arms, ["campaign_id"], "position").select("*", *[c.alias(n) for n, c in test.items()])
    won_by_a = F.col("winner") == "A"
    return tested.withColumn("winner_name", F.when(won_by_a, F.col("a_name")).when(~won_by_a, F.col("b_name"))).withColumn(
        "retired_name", F.when(won_by_a, F.col("b_name")).when(~won_by_a, F.col("a_name"))
    )


def ab_ratio_verdicts(metrics: DataFrame) -> DataFrame:
    """Rule form: both rates positive, one at least twice the other, 50 sends each."""
    pairs = variant_pairs(metrics, ["campaign_id"], "variant")
    rate_a, rate_b = ratio(F.col("a_replied"), F.col("a_sent")), ratio(F.col("b_replied"), F.col("b_sent"))
    clear = (
        (rate_a > 0) & (rate_b > 0) & (F.try_divide(F.greatest(rate_a, rate_b), F.least(rate_a, rate_b)) >= 2)
        & (F.col("a_sent") >= 50) & (F.col("b_sent") >= 50)
    )
    significant = F.coalesce(clear, F.lit(False))
    return pairs.select(
        "campaign_id", F.col("a_variant").alias("variant_a"), F.col("b_variant").alias("variant_b"), rate_a.alias("a_value"), rate_b.alias("b_value"),
        F.col("a_sent").alias("sample_size_a"), F.col("b_sent").alias("sample_size_b"), significant.alias("significant"),
        F.when(significant, F.when(rate_a > rate_b, F.col("a_variant")).otherwise(F.col("b_variant"))).alias("winner"),
    )


def with_variant(leads: DataFrame, variants: DataFrame) -> DataFrame:
    names = variants.select("tenant_id", "variant_id", F.col("name").alias("variant_name"))
    return leads.join(names, ["tenant_id", "variant_id"], "left")


def with_step(content: DataFrame, steps: DataFrame) -> DataFrame:
    found = content.join(steps, ["campaign_id", "step_no"], "left")
    return found.withColumn(
        "step_key", F.when(F.col("step_index").isNotNull(), F.concat(F.lit("step_"), F.col("step_index"))).otherwise("unknown")
    ).withColumn("channel", F.coalesce("channel", F.lit("unknown")))


CONTENT_COUNTS = ["total_leads", "qualified", "sent", "opened", "replied", "converted", "bounced"]


def content_metrics(content: DataFrame, steps: DataFrame) -> DataFrame:
    """Eight counts per campaign overall, by step, by channel and by variant.

    The events are counted once on (campaign, step, variant); steps and the four groupings only meet those counts.
    """
    once = content.groupBy("campaign_id", "step_no", F.coalesce("variant", F.lit("default")).alias("variant")).agg(
        F.count(F.lit(1)).alias("total_leads"), count_if(F.col("status") != "failed").alias("qualified"), F.count("sent_at").alias("sent"), F.count("opened_at").alias("opened"),
        F.count("replied_at").alias("replied"), F.count("converted_at").alias("converted"), F.count("bounced_at").alias("bounced"),
    )
    summed = with_step(once, steps).groupingSets(
        [["campaign_id"], ["campaign_id", "step_key"], ["campaign_id", "channel"], ["campaign_id", "variant"]],
        "campaign_id", "step_key", "channel", "variant",
    ).agg(*[F.sum(c).alias(c) for c in CONTENT_COUNTS])
    grouping = (
        F.when(F.col("step_key").isNotNull(), "step").when(F.col("channel").isNotNull(), "channel")
        .when(F.col("variant").isNotNull(), "variant").otherwise("overall")
    )
    return summed.select(
        "campaign_id", grouping.alias("grouping"), F.coalesce("step_key", "channel", "variant", F.lit("all")).alias("group_key"),
        "total_leads", "qualified", F.col("total_leads").alias("content_generated"), "sent", "opened", "replied", "converted", "bounced",
    )


def active_in_month(campaigns: DataFrame, month: str) -> DataFrame:
    created, updated = F.date_format("created_at", "yyyy-MM"), F.date_format("updated_at", "yyyy-MM")
    return campaigns.filter((created <= month) & ((updated >= month) | (F.col("status") == "active")))


def previous_month(month: str) -> str:
    year, m = (int(x) for x in month.split("-"))
    return f"{year - (m == 1)}-{12 if m == 1 else m - 1:02d}"


def _campaign_counts(leads: DataFrame) -> DataFrame:
    return leads.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("leads"), F.count("connect_sent_at").alias("sends"), F.count("connected_at").alias("accepted"),
        F.count("dm1_sent_at").alias("dms"), F.count("replied_at").alias("replies"), count_if(F.col("lifecycle_status") == "Demo_Booked").alias("demos"),
    )


def campaign_comparison(campaigns: DataFrame, leads: DataFrame, month: str) -> DataFrame:
    chosen = active_in_month(campaigns, month).select("campaign_id", "title")
    joined = chosen.join(_campaign_counts(leads), "campaign_id", "left").fillna(0)
    return joined.select(
        "campaign_id", "title", "leads", rate1(F.col("accepted"), F.col("sends")).alias("accept_rate"),
        rate1(F.col("replies"), F.col("dms")).alias("reply_rate"), "demos",
    )


def _totals(campaigns: DataFrame, leads: DataFrame, month: str) -> DataFrame:
    per = active_in_month(campaigns, month).select("campaign_id").join(_campaign_counts(leads), "campaign_id", "left").fillna(0)
    names = ("leads", "sends", "accepted", "dms", "replies", "demos")
    return per.agg(F.count(F.lit(1)).alias("campaigns"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def monthly_overview(campaigns: DataFrame, leads: DataFrame, month: str) -> DataFrame:
    t = _totals(campaigns, leads, month)
    return t.select(
        F.lit(month).alias("month"), F.col("campaigns").alias("total_campaigns"), F.col("leads").alias("total_leads"),
        F.col("sends").alias("total_connections"), F.col("accepted").alias("total_accepted"), F.col("dms").alias("total_dms"),
        F.col("replies").alias("total_replies"), F.col("demos").alias("total_demos"),
        rate1(F.col("accepted"), F.col("sends")).alias("accept_rate"), rate1(F.col("replies"), F.col("dms")).alias("reply_rate"),
        rate1(F.col("demos"), F.col("leads")).alias("conversion_rate"),
    )


def month_over_month(campaigns: DataFrame, leads: DataFrame, month: str) -> DataFrame:
    """Deltas to the month before: this month's rounded rates minus last month's unrounded ones; no row without one."""
    now = active_in_month(campaigns, month).select("campaign_id", F.lit(1).alias("slot"))
    before = active_in_month(campaigns, previous_month(month)).select("campaign_id", F.lit(0).alias("slot"))
    per = now.unionByName(before).join(_campaign_counts(leads), "campaign_id", "left").fillna(0)
    sums = per.agg(
        *[F.sum(F.when(F.col("slot") == s, F.col(n)).otherwise(0)).alias(f"{n}_{s}") for s in (0, 1) for n in ("leads", "sends", "accepted", "dms", "replies")],
        count_if(F.col("slot") == 0).alias("previous_campaigns"),
    )
    old_accept = ratio(F.col("accepted_0"), F.col("sends_0")) * 100
    old_reply = ratio(F.col("replies_0"), F.col("dms_0")) * 100
    return sums.filter(F.col("previous_campaigns") > 0).select(
        F.lit(month).alias("month"),
        (js_round((rate1(F.col("accepted_1"), F.col("sends_1")) - old_accept) * 10) / 10).alias("accept_rate_delta"),
        (js_round((rate1(F.col("replies_1"), F.col("dms_1")) - old_reply) * 10) / 10).alias("reply_rate_delta"),
        (F.col("leads_1") - F.col("leads_0")).alias("leads_delta"),
    )


def lifecycle_counts(leads: DataFrame) -> DataFrame:
    return leads.groupBy("campaign_id", "lifecycle_status").agg(F.count(F.lit(1)).alias("lead_count"))


def campaign_dashboard(campaigns: DataFrame, leads: DataFrame, variants: DataFrame) -> DataFrame:
    """Per-campaign counts plus a grand-total row (title ``ALL``)."""
    per = leads.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("lead_count"), count_if(F.col("lifecycle_status") == "Replied").alias("replied"),
        count_if(F.col("lifecycle_status").isin(DEMO_STATUSES)).alias("demos"),
    )
    arms = variants.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("variant_count"))
    joined = campaigns.select("campaign_id", "title", "status").join(per, "campaign_id", "left").join(arms, "campaign_id", "left").fillna(0)
    names = ("lead_count", "replied", "demos", "variant_count")
    return joined.groupingSets([["title"], []], "title").agg(
        *[F.sum(n).alias(n) for n in names], count_if(F.col("status") == "active").alias("active"), F.count(F.lit(1)).alias("campaigns"),
    ).withColumn("title", F.coalesce("title", F.lit("ALL")))


def timeline(leads: DataFrame) -> DataFrame:
    """ISO week by event type; a week appears once any of the five events falls in it."""
    fields = {"connect_sent_at": "connect_sent", "connected_at": "connected", "dm1_sent_at": "dm1_sent", "dm2_sent_at": "dm2_sent", "replied_at": "replied"}
    long = leads.select(
        "campaign_id", F.explode(F.array(*[F.struct(F.lit(n).alias("event"), F.col(c).alias("at")) for c, n in fields.items()])).alias("e")
    ).filter("e.at IS NOT NULL")
    weekly = long.groupBy("campaign_id", iso_week(F.col("e.at")).alias("week"))
    return weekly.agg(*[count_if(F.col("e.event") == n).alias(n) for n in fields.values()])


def campaign_summary(campaigns: DataFrame, leads: DataFrame) -> DataFrame:
    per = leads.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("total_contacts"), count_if(F.col("lifecycle_status").isin(ACCEPTED_STATUSES)).alias("accepted"),
        count_if(F.col("lifecycle_status") == "Replied").alias("replied"), F.count("dm1_sent_at").alias("dm1_sent"),
        count_if(F.col("lifecycle_status") == "Connect_Sent").alias("pending"),
    )
    joined = campaigns.select("campaign_id", "title", "status").join(per, "campaign_id", "left").fillna(0)
    percent = lambda n, d: F.concat(js_round(ratio(n, d) * 100).cast("string"), F.lit("%"))
    return joined.select(
        "*", percent(F.col("accepted"), F.col("total_contacts")).alias("acceptance_rate"), percent(F.col("replied"), F.col("accepted")).alias("reply_rate")
    )


def sync_metrics(leads: DataFrame) -> DataFrame:
    """Metrics in the form pushed to the page database; rates are text with one decimal."""
    percent = lambda n, d: F.format_string("%.1f%%", ratio(F.col(n), F.col(d)) * 100)
    per = leads.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("total_leads"), F.count("connect_sent_at").alias("connects_sent"), F.count("connected_at").alias("connected"),
        F.count("dm1_sent_at").alias("dm1"), F.count("dm2_sent_at").alias("dm2"), F.count("replied_at").alias("replies"),
    )
    return per.select(
        "campaign_id", "total_leads", "connects_sent", "connected", percent("connected", "connects_sent").alias("accept_rate"),
        (F.col("dm1") + F.col("dm2")).alias("dms_sent"), "replies", percent("replies", "dm1").alias("reply_rate"),
    )
