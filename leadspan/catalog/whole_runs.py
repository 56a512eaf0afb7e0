"""Queries over whole plans: qualification, reports, tracking, discovery runs, declared steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadspan.catalog import discovery as DC
from leadspan.catalog import linkage as LK
from leadspan.catalog import reports as RP
from leadspan.catalog import snippets as S
from leadspan.catalog.registry import query
from leadspan.catalog.scalars import FUND, SCORED_SQL
from leadspan.functions import scoring as G
from leadspan.plans import mining, qualify, reporting, steps, tracking

RULES = qualify.Rules(headline=["ceo", "vp", "head of", "product", "director", "engineer"], exclusions=["gauss", "recruit"], disqualifiers=["umbrella"], dedup=LK.CONFIG)


def _qualified(v, leads=None, profiles=None):
    funding = F.element_at(F.lit(FUND), (F.col("contact_id") % 7 + 1).cast("int"))
    score = lambda df: G.icp_score(F.col("headline"), F.col("contact_id") * 37 % 6000, funding, F.col("contact_id") % 8)
    return qualify.qualify(v.contacts if leads is None else leads, v.suppression, RULES, score, "contact_id", profiles)


QUALIFY_SQL = f"""{LK.BEST}, {SCORED_SQL}, q AS (SELECT c.contact_id, c.tenant_id, s.icp_score, CASE WHEN b.conf >= 80 THEN 'dedup' WHEN NOT regexp_matches(coalesce(c.headline, ''), '(?i)ceo|vp|head of|product|director|engineer') THEN 'headline'
    WHEN regexp_matches(lower(concat_ws(' ', c.first_name, c.last_name, c.headline, c.company, c.linkedin_url)), 'gauss|recruit') THEN 'exclusion' WHEN contains(lower(c.company), 'umbrella') OR contains(lower(c.industry), 'umbrella') THEN 'company' WHEN s.icp_score < 50 THEN 'score' END AS failed_gate
    FROM contacts c LEFT JOIN best b ON b.contact_id = c.contact_id AND b.rn = 1 JOIN scored s ON s.contact_id = c.contact_id)"""


@query("qualify_leads", f"WITH {QUALIFY_SQL} SELECT contact_id, icp_score, failed_gate FROM q", LK.NEEDS)
def _(v):
    return _qualified(v).select("contact_id", "icp_score", "failed_gate")


# every seventh contact without company and industry, which profiles of the same url, else the same person, fill in
BARE = """bare AS (SELECT * REPLACE (CASE WHEN contact_id % 7 = 0 THEN NULL ELSE company END AS company, CASE WHEN contact_id % 7 = 0 THEN NULL ELSE industry END AS industry) FROM contacts),
    prof AS (SELECT contact_id AS profile_no, CASE WHEN contact_id % 3 <> 0 THEN linkedin_url END AS linkedin_url, CASE WHEN contact_id % 2 = 0 THEN provider_id END AS provider_id, 'Found ' || company AS company, industry FROM contacts),
    pu AS (SELECT linkedin_url, arg_min({'c': company, 'i': industry}, profile_no) AS r FROM prof WHERE linkedin_url IS NOT NULL GROUP BY 1), pp AS (SELECT provider_id, arg_min({'c': company, 'i': industry}, profile_no) AS r FROM prof WHERE provider_id IS NOT NULL GROUP BY 1)"""
ENRICHED = QUALIFY_SQL.replace("FROM contacts", "FROM bare")


@query("qualify_enriched", f"""WITH {BARE}, {ENRICHED} SELECT q.contact_id, q.icp_score, q.failed_gate, CASE WHEN b.company IS NULL THEN coalesce(pu.r, pp.r).c ELSE b.company END AS company, CASE WHEN b.company IS NULL THEN coalesce(pu.r, pp.r).i ELSE b.industry END AS industry
    FROM q JOIN bare b ON b.contact_id = q.contact_id LEFT JOIN pu ON pu.linkedin_url = b.linkedin_url LEFT JOIN pp ON pp.provider_id = b.provider_id""", LK.NEEDS)
def _(v):
    n, blank = F.col("contact_id"), F.col("contact_id") % 7 == 0
    bare = v.contacts.withColumns({c: F.when(~blank, F.col(c)) for c in ("company", "industry")})
    profiles = v.contacts.select(
        n.alias("profile_no"), F.when(n % 3 != 0, F.col("linkedin_url")).alias("linkedin_url"), F.when(n % 2 == 0, F.col("provider_id")).alias("provider_id"),
        F.concat(F.lit("Found "), "company").alias("company"), "industry",
    )
    return _qualified(v, bare, profiles).select("contact_id", "icp_score", "failed_gate", "company", "industry")


@query("gate_summary", f"""WITH {QUALIFY_SQL} SELECT tenant_id, count(*) AS processed, count(CASE WHEN failed_gate = 'dedup' THEN 1 END) AS failed_dedup, count(CASE WHEN failed_gate = 'headline' THEN 1 END) AS failed_headline, count(CASE WHEN failed_gate = 'exclusion' THEN 1 END) AS failed_exclusion,
    count(CASE WHEN failed_gate = 'company' THEN 1 END) AS failed_company, count(CASE WHEN failed_gate = 'score' THEN 1 END) AS failed_score, count(*) - count(failed_gate) AS qualified FROM q GROUP BY 1""", LK.NEEDS)
def _(v):
    return qualify.gate_summary(_qualified(v))


@query("score_leads", f"WITH {SCORED_SQL} SELECT contact_id, CASE WHEN contact_id % 9 = 0 THEN 50 ELSE icp_score END AS icp_score, CASE WHEN contact_id % 9 = 0 THEN 'Moderate' WHEN icp_score >= 85 THEN 'Very Strong' WHEN icp_score >= 70 THEN 'Strong' WHEN icp_score >= 50 THEN 'Moderate' ELSE 'Reject' END AS icp_fit FROM scored", ("contacts",))
def _(v):
    from leadspan.catalog.scalars import scored_contacts

    rows = scored_contacts(v)
    return qualify.score_leads(rows, F.when(F.col("contact_id") % 9 != 0, F.col("icp_score"))).select("contact_id", "icp_score", "icp_fit")


def _section(name: str, label: str, sql: str) -> str:
    return f"SELECT '{name}' AS section, campaign_id, {label} AS label, lead_count, accept_rate, reply_rate, NULL::DOUBLE AS value FROM ({sql}) s_{name}"


SECTIONS = " UNION ALL ".join([
    f"SELECT 'variants' AS section, campaign_id, name AS label, leads_assigned AS lead_count, accept_rate, reply_rate, NULL::DOUBLE AS value FROM ({RP.VARIANT_STATS_SQL}) s_v",
    _section("tags", "tag", RP.breakdown_sql("tag", "SELECT campaign_id, connected_at, replied_at, unnest(tags) AS tag FROM campaign_leads")),
    _section("sources", "source", RP.breakdown_sql("source", "SELECT campaign_id, connected_at, replied_at, coalesce(source, 'unknown') AS source FROM campaign_leads")),
    _section("segments", "segment", RP.breakdown_sql("segment", f"SELECT campaign_id, connected_at, replied_at, {RP.SEGMENT_SQL.format(h='headline')} AS segment FROM campaign_leads")),
    f"""SELECT 'score_buckets', g.campaign_id, r.score_range, count(l.lead_id), {RP.r1('count(l.connected_at)', 'count(l.lead_id)')}, {RP.r1('count(l.replied_at)', 'count(l.lead_id)')}, NULL
      FROM (SELECT DISTINCT campaign_id FROM campaign_leads) g CROSS JOIN (VALUES {RP.RANGES_SQL}) r(score_range, lo, hi) LEFT JOIN campaign_leads l ON l.campaign_id = g.campaign_id AND coalesce(l.qualification_score, 0) BETWEEN r.lo AND r.hi GROUP BY g.campaign_id, r.score_range""",
    _section("trends", "week_start", f"SELECT campaign_id, week_start, sends AS lead_count, accept_rate, reply_rate FROM ({RP.TREND_SQL}) s_w"),
    f"SELECT 'funnel', campaign_id, stage, stage_count, NULL, NULL, dropoff_rate FROM ({RP.FUNNEL_SQL}) s_f",
    f"SELECT DISTINCT 'funnel', campaign_id, 'overall', total_leads, NULL::DOUBLE, NULL::DOUBLE, overall_conversion_rate FROM ({RP.FUNNEL_SQL}) s_o",
    f"SELECT 'score_correlation', campaign_id, 'pearson', NULL, NULL, NULL, pearson FROM ({RP.CORRELATION_SQL}) s_c",
    f"SELECT 'winner', campaign_id, winner, NULL, NULL, best_reply_rate, margin_percent FROM ({RP.WINNER_SQL}) s_b",
])


@query("campaign_report", SECTIONS, RP.NEEDS_LV)
def _(v):
    return reporting.campaign_report_rows(v.campaign_leads, v.campaign_variants, winner_multiplier=1.1)


TOP_TAGS_SQL = f"""SELECT '{RP.MONTH}' AS month, tag, count(*) AS lead_count, {RP.r1('count(connected_at)', 'count(*)')} AS accept_rate, {RP.r1('count(replied_at)', 'count(*)')} AS reply_rate
    FROM (SELECT l.connected_at, l.replied_at, unnest(l.tags) AS tag FROM campaign_leads l WHERE campaign_id IN (SELECT campaign_id FROM campaigns WHERE {RP.ACTIVE_SQL.format(m=RP.MONTH)})) x GROUP BY tag ORDER BY lead_count DESC, tag LIMIT 15"""


@query("monthly_top_tags", TOP_TAGS_SQL, ("campaigns", "campaign_leads"))
def _(v):
    return reporting.month_tags(v.campaigns, v.campaign_leads, RP.MONTH)


def _long(section: str, label: str, metrics: str, sql: str) -> str:
    names = metrics.split()
    pairs = ", ".join(f"{{'m': '{n}', 'v': CAST({n} AS DOUBLE)}}" for n in names)
    return f"SELECT section, label, p.m AS metric, p.v AS value FROM (SELECT '{section}' AS section, CAST({label} AS VARCHAR) AS label, unnest([{pairs}]) AS p FROM ({sql}) s_{section}) x_{section}"


MONTH_SQL = " UNION ALL ".join([
    _long("overview", "'all'", "total_campaigns total_leads total_connections total_accepted total_dms total_replies total_demos accept_rate reply_rate conversion_rate", RP.OVERVIEW_SQL),
    _long("comparison", "campaign_id", "leads accept_rate reply_rate demos", RP.COMPARISON_SQL),
    _long("tags", "tag", "lead_count accept_rate reply_rate", TOP_TAGS_SQL),
    _long("month_over_month", "'all'", "accept_rate_delta reply_rate_delta leads_delta", RP.CHANGE_SQL),
])


@query("monthly_report", MONTH_SQL, ("campaigns", "campaign_leads"))
def _(v):
    return reporting.monthly_report_rows(v.campaigns, v.campaign_leads, RP.MONTH)


def _tracked(v):
    at = F.lit("1997-06-16 15:30:00").cast("timestamp")
    arms = v.campaign_variants.select(
        "*", F.lit("Hello {{first_name}}").alias("connect_note"), F.lit("Hello {{first_name}}, a word on {{company}}").alias("dm1_template"),
        F.when(F.col("name") == "C", "Hi again").otherwise("Hello again {{first_name}}").alias("dm2_template"),
    )
    return tracking.track(v.campaign_leads, v.campaigns, arms, v.relations, v.chat_messages, v.blocklist, at), at


# the phases work on one snapshot; every rule is tested on a fixture
@query("track_campaigns")
def _(v):
    tracked, _ = _tracked(v)
    return tracked.select("lead_id", "lifecycle_status", "action", "next_status", "message")


@query("track_snapshot")
def _(v):
    tracked, at = _tracked(v)
    out = tracking.next_snapshot(v.campaign_leads, tracked, at)
    return out.groupBy("campaign_id", "lifecycle_status").agg(F.count(F.lit(1)).alias("leads"))


def _mined(v):
    q = v.new_profiles.withColumn("query_no", F.substring("query_hash", 2, 9).cast("int")).withColumn("position", F.floor(F.col("ordinal") / 9))
    at = F.lit("2024-02-01").cast("timestamp")
    contacts = v.profiles.select(F.col("ordinal").alias("contact_no"), "rr_id", "linkedin_url", F.concat(F.lit("p"), "ordinal", F.lit("@x.com")).alias("email"), F.lit(None).cast("string").alias("phone"))
    companies = v.supplier.select(F.concat(F.lit("d"), "s_suppkey", F.lit(".com")).alias("domain"), F.col("s_name").alias("name"), F.lit(3).cast("bigint").alias("people_count"), at.alias("last_mined_at"))
    cursors = q.select("query_hash").distinct().select("query_hash", F.lit(1).cast("bigint").alias("next_start"), F.lit(0).cast("bigint").alias("low_yield_streak"), F.lit("active").alias("status"), F.lit(None).cast("bigint").alias("total_matches"))
    waiting = v.mined_people.filter("status = 'seen'").count()
    return mining.mine(q, v.mined_people, contacts, companies, cursors, at, target=waiting + 60)


# pages of a hundred results in query order, until enough new people wait; the oldest are delivered with what is known of them
@query("mine_profiles", f"""WITH RECURSIVE {DC.FIRST_COME}, p AS (SELECT *, CAST(substr(query_hash, 2) AS INTEGER) AS query_no, ordinal // 9 // 100 AS page FROM new_profiles), n AS (SELECT count(*) AS n FROM mined_people WHERE status = 'seen'),
    pg AS (SELECT query_no, page, count(*) FILTER (ordinal IN (SELECT ordinal FROM fc WHERE kept)) AS fresh FROM p GROUP BY 1, 2),
    tk AS (SELECT query_no, page FROM (SELECT *, coalesce(sum(fresh) OVER (ORDER BY query_no, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pg) x WHERE before < 60),
    m AS (SELECT mined_id, rr_id, name, linkedin_url, first_seen_at FROM mined_people WHERE status = 'seen' UNION ALL SELECT p.ordinal, rr_id, name, linkedin_url, TIMESTAMP '2024-02-01' FROM p JOIN tk ON tk.query_no = p.query_no AND tk.page = p.page WHERE p.ordinal IN (SELECT ordinal FROM fc WHERE kept)),
    due AS (SELECT * FROM m ORDER BY first_seen_at, mined_id LIMIT (SELECT n + 60 FROM n)), ct AS (SELECT CASE WHEN rr_id IS NOT NULL THEN 'rr:' || rr_id ELSE 'li:' || {S.linkedin('linkedin_url')} END AS key, arg_min('p' || ordinal || '@x.com', ordinal) AS email FROM profiles GROUP BY 1)
    SELECT mined_id, rr_id, name, email FROM (SELECT *, CASE WHEN rr_id IS NOT NULL THEN 'rr:' || rr_id ELSE 'li:' || {S.linkedin('linkedin_url')} END AS key FROM due) d LEFT JOIN ct ON ct.key = d.key""", ("new_profiles", "mined_people", "profiles"))
def _(v):
    return _mined(v)["delivered"].select("mined_id", "rr_id", "name", "email")


@query("declared_steps", """SELECT campaign_id, count(*) AS leads, max(score) AS best FROM (SELECT campaign_id, qualification_score AS score FROM campaign_leads WHERE qualification_score >= 40 AND email IS NOT NULL) x GROUP BY 1""", ("campaign_leads",))
def _(v):
    declared = [
        steps.RunStep("pick", lambda df: df, condition="qualification_score >= 40 AND email exists", fields={"qualification_score": "score"}, target=["campaign_id"]),
        steps.RunStep("count", lambda df: df.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("leads"), F.max("score").alias("best")), source="pick"),
    ]
    return steps.run_steps(v.campaign_leads, declared)["count"]
