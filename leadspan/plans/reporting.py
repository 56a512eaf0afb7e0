"""Whole reports: the sections of a campaign, the month of a team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspan.functions.segments import segment_of
from leadspan.functions.stats import js_round, rate1
from leadspan.operators import reports as R
from leadspan.session import cut_lineage


def campaign_report(leads: DataFrame, variants: DataFrame) -> dict[str, DataFrame]:
    stats = R.variant_stats(leads, variants)
    return {
        "funnel": R.funnel(leads), "variants": stats, "tags": R.tag_stats(leads), "sources": R.source_stats(leads), "segments": R.segment_stats(leads),
        "score_buckets": R.score_buckets(leads), "score_correlation": R.score_correlation(leads), "trends": R.weekly_trend(leads), "winner": R.declare_winner(stats),
    }


def report_cells(leads: DataFrame) -> DataFrame:
    """(campaign_id, section, label) with counts and sums: every section of the report from one scan and one shuffle."""
    score = F.coalesce(F.col("qualification_score"), F.lit(0))
    bucket = F.lit(None).cast("string")
    for label, low, high in R.SCORE_RANGES:
        bucket = F.when(score.between(low, high), label).otherwise(bucket)
    cell = lambda section, label: F.struct(F.lit(section).alias("section"), label.cast("string").alias("label"))
    fixed = F.array(
        cell("all", F.lit("")), cell("sources", F.coalesce(F.col("source"), F.lit("unknown"))), cell("segments", segment_of(F.col("headline"))), cell("score_buckets", bucket),
        cell("status", F.col("lifecycle_status")), cell("variants", F.concat_ws("|", "tenant_id", "variant_id")), cell("trends", F.when(F.col("connect_sent_at").isNotNull(), R.week_start(F.col("connect_sent_at")))),
    )
    tags = F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda t: cell("tags", t))
    wanted = F.filter(F.concat(fixed, tags), lambda c: c["label"].isNotNull() | (c["section"] == "tags"))
    scored = F.col("qualification_score").isNotNull()
    x = F.when(scored, F.col("qualification_score").cast("double"))
    y = F.when(scored, F.when(F.col("replied_at").isNotNull(), 1.0).when(F.col("connected_at").isNotNull(), 0.5).otherwise(0.0))
    rows = leads.select("campaign_id", "connect_sent_at", "connected_at", "dm1_sent_at", "replied_at", x.alias("x"), y.alias("y"), F.inline(wanted))
    return cut_lineage(
        rows.groupBy("campaign_id", "section", "label").agg(
            F.count(F.lit(1)).alias("n"), F.count("connect_sent_at").alias("sent"), F.count("connected_at").alias("connected"), F.count("dm1_sent_at").alias("dms"), F.count("replied_at").alias("replied"),
            F.count("x").alias("scored"), *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "yy", "xy")], F.sum("x").alias("x"), F.sum("y").alias("y"),
        )
    )


def campaign_report_rows(leads: DataFrame, variants: DataFrame, winner_multiplier: float = 1.5) -> DataFrame:
    """All nine sections as one long table: section, campaign_id, label, lead_count, accept_rate, reply_rate, value.

    ``value`` is the drop-off of a funnel stage, the overall conversion, the correlation and the winner's margin.
    """
    cells = report_cells(leads)
    none = F.lit(None).cast("double")

    def rows(df, section, label, count, accept, reply, value=none):
        return df.select(F.lit(section).alias("section"), "campaign_id", label.alias("label"), count.cast("bigint").alias("lead_count"), accept.alias("accept_rate"), reply.alias("reply_rate"), value.alias("value"))

    part = lambda *names: cells.filter(F.col("section").isin(*names))
    n, connected, replied = F.col("n"), F.col("connected"), F.col("replied")
    plain = part("tags", "sources", "segments", "trends").select(
        "section", "campaign_id", "label", F.col("n").alias("lead_count"), rate1(connected, n).alias("accept_rate"), rate1(replied, n).alias("reply_rate"), none.alias("value")
    )
    every_range = part("all").select("campaign_id", F.explode(F.lit([r[0] for r in R.SCORE_RANGES])).alias("label"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "connected", "replied")])
    ranges = part("score_buckets").select(*every_range.columns).union(every_range).groupBy("campaign_id", "label").agg(*[F.sum(c).alias(c) for c in ("n", "connected", "replied")])
    rank = F.array_position(F.lit(R.FUNNEL_STAGES), F.col("label"))
    reached = part("status", "all").groupBy("campaign_id").agg(
        F.sum(F.when(F.col("section") == "all", n)).alias("total"), *[F.coalesce(F.sum(F.when((F.col("section") == "status") & (rank > i), n)), F.lit(0)).alias(f"s{i}") for i in range(len(R.FUNNEL_STAGES))]
    )
    before = [F.col("total"), *[F.col(f"s{i}") for i in range(len(R.FUNNEL_STAGES))]]
    stages = F.array(
        *[F.struct(F.lit(s).alias("label"), before[i + 1].alias("reached"), rate1(before[i] - before[i + 1], before[i]).alias("lost")) for i, s in enumerate(R.FUNNEL_STAGES)],
        F.struct(F.lit("overall").alias("label"), F.col("total").alias("reached"), rate1(before[-1], F.col("total")).alias("lost")),
    )
    funnel = reached.select("campaign_id", F.inline(stages))
    k = F.col("scored")
    spread = F.sqrt((F.col("xx") - F.col("x") * F.col("x") / k) * (F.col("yy") - F.col("y") * F.col("y") / k))
    pearson = F.when(k >= 3, js_round(F.try_divide(F.col("xy") - F.col("x") * F.col("y") / k, F.when(spread > 1e-9, spread)) * 100) / 100)
    counted = part("variants").groupBy("label").agg(F.sum("n").alias("leads_assigned"), F.sum("sent").alias("sends"), F.sum("connected").alias("accepts"), F.sum("dms").alias("dms_sent"), F.sum("replied").alias("replies"))
    named = variants.select("campaign_id", "variant_id", "name", F.concat_ws("|", "tenant_id", "variant_id").alias("label")).join(counted, "label", "left").fillna(0)
    stats = named.withColumns({"accept_rate": rate1(F.col("accepts"), F.col("sends")), "reply_rate": rate1(F.col("replies"), F.col("dms_sent"))})
    winner = R.declare_winner(stats, multiplier=winner_multiplier)
    sections = [
        plain, rows(stats, "variants", F.col("name"), F.col("leads_assigned"), F.col("accept_rate"), F.col("reply_rate")), rows(ranges, "score_buckets", F.col("label"), n, rate1(connected, n), rate1(replied, n)),
        rows(funnel, "funnel", F.col("label"), F.col("reached"), none, none, F.col("lost")), rows(part("all"), "score_correlation", F.lit("pearson"), F.lit(None), none, none, pearson),
        rows(winner, "winner", F.col("winner"), F.lit(None), none, F.col("best_reply_rate"), F.col("margin_percent").cast("double")),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def month_tags(campaigns: DataFrame, leads: DataFrame, month: str, top: int = 15) -> DataFrame:
    """Most frequent tags over the campaigns of the month."""
    chosen = R.active_in_month(campaigns, month).select("campaign_id")
    rows = leads.join(chosen, "campaign_id", "left_semi").withColumn("month", F.lit(month))
    return R.tag_stats(rows, ("month",)).orderBy(F.col("lead_count").desc(), "tag").limit(top)


def monthly_report(campaigns: DataFrame, leads: DataFrame, month: str) -> dict[str, DataFrame]:
    return {
        "overview": R.monthly_overview(campaigns, leads, month), "comparison": R.campaign_comparison(campaigns, leads, month).orderBy(F.col("reply_rate").desc()),
        "tags": month_tags(campaigns, leads, month), "month_over_month": R.month_over_month(campaigns, leads, month),
    }


def monthly_report_rows(campaigns: DataFrame, leads: DataFrame, month: str) -> DataFrame:
    """The four sections of a month as (section, label, metric, value)."""
    report = monthly_report(campaigns, leads, month)
    labels = {"overview": F.lit("all"), "comparison": F.col("campaign_id").cast("string"), "tags": F.col("tag"), "month_over_month": F.lit("all")}
    out = None
    for section, df in report.items():
        metrics = [c for c, kind in df.dtypes if kind != "string" and c != "campaign_id"]
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])
        rows = df.select(F.lit(section).alias("section"), labels[section].alias("label"), F.inline(pairs))
        out = rows if out is None else out.unionByName(rows)
    return out
