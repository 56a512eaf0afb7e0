"""Queries for suppression matching, blocking and look-up joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadspan.catalog import snippets as S
from leadspan.catalog.registry import query
from leadspan.operators import linkage as L
from leadspan.operators import matching as J

CONFIG = L.DedupConfig(fuzzy_threshold=0.65)  # below the default, so the given tables also reach the review band
NEEDS = ("contacts", "suppression")

KEYED = f"""
    l AS (SELECT tenant_id, contact_id, lower(trim(coalesce(email, ''))) AS e, {S.linkedin('linkedin_url')} AS u, lower(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '') || ' ' || coalesce(company, ''))) AS n,
      {S.email_domain('email')} AS d, lower(trim(coalesce(headline, ''))) AS t FROM contacts),
    s AS (SELECT tenant_id, ord, entry_id, source, lower(trim(coalesce(email, ''))) AS e, {S.linkedin('linkedin_url')} AS u, lower(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '') || ' ' || coalesce(company, ''))) AS n,
      {S.email_domain('email')} AS d, lower(trim(coalesce(headline, ''))) AS t FROM suppression),
    names AS (SELECT DISTINCT tenant_id, n, {S.bigrams('n')} AS b FROM (SELECT tenant_id, n FROM l UNION ALL SELECT tenant_id, n FROM s) z),
    name_pairs AS (SELECT a.tenant_id, a.n AS ln, c.n AS sn, {S.dice_sets('a.b', 'c.b')} AS score FROM (SELECT * FROM names WHERE (tenant_id, n) IN (SELECT tenant_id, n FROM l)) a
      JOIN (SELECT * FROM names WHERE (tenant_id, n) IN (SELECT tenant_id, n FROM s)) c ON a.tenant_id = c.tenant_id AND len(c.b) >= 0.48 * len(a.b) AND len(a.b) >= 0.48 * len(c.b)),
    titles AS (SELECT DISTINCT tenant_id, t FROM (SELECT tenant_id, t FROM l UNION ALL SELECT tenant_id, t FROM s) z WHERE t <> ''),
    title_pairs AS (SELECT a.tenant_id, a.t AS lt, c.t AS st, CASE WHEN a.t = c.t THEN 1.0 ELSE {S.dice_sets(S.bigrams('a.t'), S.bigrams('c.t'))} END AS score FROM titles a JOIN titles c ON a.tenant_id = c.tenant_id),
    m AS (SELECT l.tenant_id, l.contact_id, s.ord, 1 AS mo, 100 AS conf FROM l JOIN s ON l.tenant_id = s.tenant_id AND l.e = s.e AND l.e <> ''
      UNION ALL SELECT l.tenant_id, l.contact_id, s.ord, 2, 95 FROM l JOIN s ON l.tenant_id = s.tenant_id AND l.u = s.u AND l.u <> ''
      UNION ALL SELECT l.tenant_id, l.contact_id, s.ord, 3, CAST(floor(p.score * 100 + 0.5) AS INT) FROM l JOIN name_pairs p ON p.tenant_id = l.tenant_id AND p.ln = l.n AND p.score >= 0.65 AND l.n <> '' JOIN s ON s.tenant_id = p.tenant_id AND s.n = p.sn
      UNION ALL SELECT l.tenant_id, l.contact_id, s.ord, 4, CAST(floor(p.score * 25 + 70 + 0.5) AS INT) FROM l JOIN s ON l.tenant_id = s.tenant_id AND l.d = s.d AND l.d <> '' JOIN title_pairs p ON p.tenant_id = l.tenant_id AND p.lt = l.t AND p.st = s.t AND p.score >= 0.7)"""
MATCHER = "['email', 'linkedin', 'fuzzy_name_company', 'domain_title'][mo]"


@query("match_by_key", f"WITH {KEYED} SELECT contact_id, {MATCHER} AS matcher, conf AS confidence, min(ord) AS ord FROM m WHERE mo <= 2 GROUP BY ALL", NEEDS)
def _(v):
    out = L.match_candidates(v.contacts, v.suppression, "contact_id", L.DedupConfig(matchers=("email", "linkedin")))
    return out.drop("tenant_id")


@query("match_fuzzy_name", f"""WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY conf DESC, ord) AS rn FROM m WHERE mo = 3)
    SELECT contact_id, {MATCHER} AS matcher, conf AS confidence, ord FROM r WHERE rn = 1""", NEEDS)
def _(v):
    return L.match_candidates(v.contacts, v.suppression, "contact_id", L.DedupConfig(0.65, matchers=("fuzzy_name_company",))).drop("tenant_id")


@query("match_domain_title", f"""WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY conf DESC, ord) AS rn FROM m WHERE mo = 4)
    SELECT contact_id, {MATCHER} AS matcher, conf AS confidence, ord FROM r WHERE rn = 1""", NEEDS)
def _(v):
    return L.match_candidates(v.contacts, v.suppression, "contact_id", L.DedupConfig(matchers=("domain_title",))).drop("tenant_id")


BEST = f"{KEYED}, best AS (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY conf DESC, ord, mo) AS rn FROM m)"
VERDICT = "CASE WHEN b.conf >= 80 THEN 'duplicate' WHEN b.conf >= 60 THEN 'pending_review' ELSE 'unique' END"


@query("dedup_leads", f"""WITH {BEST} SELECT l.contact_id, {VERDICT} AS verdict, {MATCHER} AS matcher, b.conf AS confidence, s.entry_id AS matched_id, s.source AS matched_source
    FROM l LEFT JOIN best b ON b.contact_id = l.contact_id AND b.rn = 1 LEFT JOIN s ON s.tenant_id = b.tenant_id AND s.ord = b.ord""", NEEDS)
def _(v):
    out = L.dedup_leads(v.contacts, v.suppression, "contact_id", CONFIG)
    return out.select("contact_id", "verdict", "matcher", "confidence", "matched_id", "matched_source")


@query("dedup_summary", f"""WITH {BEST} SELECT l.tenant_id, {VERDICT} AS verdict, count(*) AS leads FROM l LEFT JOIN best b ON b.contact_id = l.contact_id AND b.rn = 1 GROUP BY 1, 2""", NEEDS)
def _(v):
    return L.dedup_leads(v.contacts, v.suppression, "contact_id", CONFIG).groupBy("tenant_id", "verdict").agg(F.count(F.lit(1)).alias("leads"))


@query("suppression_union", """
    SELECT 'campaign_active' AS source, l.lead_id AS ord, CAST(l.lead_id AS VARCHAR) AS entry_id, l.tenant_id, l.email, l.company, l.first_name, l.last_name FROM campaign_leads l JOIN campaigns c ON c.campaign_id = l.campaign_id AND c.tenant_id = l.tenant_id WHERE c.status IN ('active', 'running', 'draft')
    UNION ALL SELECT 'campaign_replied', 1000000000000000 + lead_id, CAST(lead_id AS VARCHAR), tenant_id, email, company, first_name, last_name FROM campaign_leads WHERE lifecycle_status IN ('Replied', 'Demo_Booked', 'Deal_Created', 'Closed_Won')
    UNION ALL SELECT 'crm', 2000000000000000 + s_suppkey, 'crm:' || item, 't' || (s_nationkey % 3), CASE WHEN contains(item, '@') THEN item END, CASE WHEN NOT contains(item, '@') THEN item END, NULL, NULL FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'a' || s_suppkey || '@x.com' ELSE 'dom' || s_suppkey || '.com' END AS item FROM supplier) q
    UNION ALL SELECT 'blocklist', 3000000000000000 + block_id, CAST(block_id AS VARCHAR), tenant_id, NULL, company, string_split(name, ' ')[1], array_to_string(string_split(name, ' ')[2:], ' ') FROM blocklist""", ("campaign_leads", "campaigns", "blocklist"))
def _(v):
    item = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("a"), "s_suppkey", F.lit("@x.com"))).otherwise(F.concat(F.lit("dom"), "s_suppkey", F.lit(".com")))
    crm = v.supplier.select(F.col("s_suppkey").alias("item_no"), F.concat(F.lit("t"), F.col("s_nationkey") % 3).alias("tenant_id"), item.alias("item"))
    return L.suppression_set(v.campaign_leads, v.campaigns, crm, v.blocklist).select("source", "ord", "entry_id", "tenant_id", "email", "company", "first_name", "last_name")


@query("blocked_leads", """
    WITH k AS (SELECT tenant_id, lead_id, campaign_id, replied_at, 'p' AS kind, provider_id AS key FROM campaign_leads UNION ALL SELECT tenant_id, lead_id, campaign_id, replied_at, 'u', linkedin_url FROM campaign_leads UNION ALL SELECT tenant_id, lead_id, campaign_id, replied_at, 'e', email FROM campaign_leads),
    k2 AS (SELECT * FROM k WHERE coalesce(key, '') <> ''), b AS (SELECT tenant_id, scope, campaign_id, 'p' AS kind, provider_id AS key FROM blocklist UNION ALL SELECT tenant_id, scope, campaign_id, 'u', linkedin_url FROM blocklist)
    SELECT DISTINCT lead_id FROM k2 WHERE (tenant_id, kind, key) IN (SELECT tenant_id, kind, key FROM k2 WHERE replied_at IS NOT NULL) OR (tenant_id, kind, key) IN (SELECT tenant_id, kind, key FROM b WHERE scope = 'permanent' AND key IS NOT NULL)
      OR (tenant_id, campaign_id, kind, key) IN (SELECT tenant_id, campaign_id, kind, key FROM b WHERE scope = 'campaign' AND key IS NOT NULL)""", ("campaign_leads", "blocklist"))
def _(v):
    return J.blocked(v.campaign_leads, v.campaign_leads, v.blocklist).select("lead_id")


@query("accepted_leads", "SELECT lead_id FROM campaign_leads WHERE lifecycle_status = 'Connect_Sent' AND provider_id IN (SELECT provider_id FROM relations)", ("campaign_leads", "relations"))
def _(v):
    return J.accepted(v.campaign_leads, v.relations).select("lead_id")


@query("replied_leads", """WITH a AS (SELECT DISTINCT chat_id, attendee_id FROM chat_messages), r AS (SELECT DISTINCT m.chat_id FROM chat_messages m JOIN a ON a.chat_id = m.chat_id AND a.attendee_id = m.sender_id WHERE m.sender_id <> 'me')
    SELECT lead_id FROM campaign_leads WHERE lifecycle_status IN ('DM1_Sent', 'DM2_Sent') AND replied_at IS NULL AND provider_id IN (SELECT attendee_id FROM a WHERE chat_id IN (SELECT chat_id FROM r))""", ("campaign_leads", "chat_messages"))
def _(v):
    return J.replies(v.campaign_leads, v.chat_messages).select("lead_id")


RESULTS_SQL = """results AS (SELECT contact_id AS result_no, CASE WHEN contact_id % 3 = 0 THEN NULL ELSE linkedin_url END AS linkedin_url, upper(first_name) AS first_name, last_name || ' ' AS last_name,
    CASE WHEN contact_id % 4 = 0 THEN NULL ELSE 'found' || contact_id || '@x.com' END AS email, CASE WHEN contact_id % 5 = 0 THEN NULL ELSE 'valid' END AS email_status, '+1' || contact_id AS phone FROM contacts)"""


@query("merge_enrichment", f"""
    WITH {RESULTS_SQL}, r AS (SELECT *, lower(trim(coalesce(linkedin_url, ''))) AS u, lower(trim(coalesce(first_name, ''))) || '|' || lower(trim(coalesce(last_name, ''))) AS n FROM results),
    bu AS (SELECT * FROM r WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY u ORDER BY result_no) = 1), bn AS (SELECT * FROM r WHERE n <> '|' QUALIFY row_number() OVER (PARTITION BY n ORDER BY result_no) = 1),
    j AS (SELECT l.contact_id, l.email AS old, CASE WHEN bu.u IS NOT NULL THEN bu.email ELSE bn.email END AS found, CASE WHEN bu.u IS NOT NULL THEN bu.email_status ELSE bn.email_status END AS st, CASE WHEN bu.u IS NOT NULL THEN bu.phone ELSE bn.phone END AS ph
      FROM contacts l LEFT JOIN bu ON l.email IS NULL AND bu.u = lower(trim(coalesce(l.linkedin_url, ''))) LEFT JOIN bn ON l.email IS NULL AND bn.n = lower(trim(l.first_name)) || '|' || lower(trim(l.last_name)))
    SELECT contact_id, coalesce(old, found) AS email, old IS NULL AND found IS NOT NULL AS enriched, CASE WHEN old IS NULL AND found IS NOT NULL THEN coalesce(st, 'unverified') END AS email_status, CASE WHEN old IS NULL AND found IS NOT NULL THEN ph END AS phone FROM j""", ("contacts",))
def _(v):
    c = v.contacts
    results = c.select(
        F.col("contact_id").alias("result_no"), F.when(F.col("contact_id") % 3 != 0, F.col("linkedin_url")).alias("linkedin_url"), F.upper("first_name").alias("first_name"),
        F.concat("last_name", F.lit(" ")).alias("last_name"), F.when(F.col("contact_id") % 4 != 0, F.concat(F.lit("found"), "contact_id", F.lit("@x.com"))).alias("email"),
        F.when(F.col("contact_id") % 5 != 0, "valid").alias("email_status"), F.concat(F.lit("+1"), "contact_id").alias("phone"),
    )
    leads = c.select("contact_id", "first_name", "last_name", "linkedin_url", "email", F.lit(None).cast("string").alias("email_status"), F.lit(None).cast("string").alias("phone"))
    return J.merge_enrichment(leads, results).select("contact_id", "email", "enriched", "email_status", "phone")


@query("email_status_merge", f"""
    WITH s AS (SELECT *, lower(email) AS k FROM email_status QUALIFY row_number() OVER (PARTITION BY lower(email) ORDER BY status_no DESC) = 1),
    j AS (SELECT l.*, s.k, s.status AS st, s.bounced_at AS sb, s.replied_at AS sr, s.opened_at AS so FROM campaign_leads l LEFT JOIN s ON l.email_campaign_id IS NOT NULL AND s.k = lower(l.email)),
    f AS (SELECT *, coalesce(st = 'bounced' AND email_bounced_at IS NULL, false) AS b, k IS NOT NULL AND sr IS NOT NULL AND email_replied_at IS NULL AS r, k IS NOT NULL AND so IS NOT NULL AND email_opened_at IS NULL AS o, coalesce(st = 'active' AND coalesce(email_status, '') <> 'sent', false) AS a FROM j)
    SELECT lead_id, CASE WHEN r THEN 'replied' WHEN o THEN 'opened' WHEN a THEN 'sent' WHEN b THEN 'bounced' ELSE email_status END AS email_status, CASE WHEN r THEN 'Replied' ELSE lifecycle_status END AS lifecycle_status,
      strftime(CASE WHEN b THEN coalesce(sb, {S.NOW}) ELSE email_bounced_at END, '%Y-%m-%d %H:%M:%S') AS bounced, strftime(CASE WHEN r THEN sr ELSE email_replied_at END, '%Y-%m-%d %H:%M:%S') AS replied,
      strftime(CASE WHEN NOT r AND o THEN so ELSE email_opened_at END, '%Y-%m-%d %H:%M:%S') AS opened, strftime(CASE WHEN NOT r AND NOT o AND a THEN coalesce(email_sent_at, {S.NOW}) ELSE email_sent_at END, '%Y-%m-%d %H:%M:%S') AS sent, b OR r OR o OR a AS changed FROM f""", ("campaign_leads", "email_status"))
def _(v):
    out = J.apply_email_status(v.campaign_leads, v.email_status, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select(
        "lead_id", "email_status", "lifecycle_status", ts("email_bounced_at").alias("bounced"), ts("email_replied_at").alias("replied"),
        ts("email_opened_at").alias("opened"), ts("email_sent_at").alias("sent"), F.col("email_changed").alias("changed"),
    )


@query("variant_lookup", "SELECT l.lead_id, v.name AS variant_name FROM campaign_leads l LEFT JOIN campaign_variants v ON v.variant_id = l.variant_id AND v.tenant_id = l.tenant_id", ("campaign_leads", "campaign_variants"))
def _(v):
    from leadspan.operators.reports import with_variant

    return with_variant(v.campaign_leads, v.campaign_variants).select("lead_id", "variant_name")


@query("step_lookup", """SELECT c.content_id, c.step_no, c.campaign_id, c.variant, coalesce('step_' || s.step_index, 'unknown') AS step_key, coalesce(s.channel, 'unknown') AS channel
    FROM campaign_content c LEFT JOIN campaign_steps s ON s.campaign_id = c.campaign_id AND s.step_no = c.step_no""", ("campaign_content", "campaign_steps"))
def _(v):
    from leadspan.operators.reports import with_step

    return with_step(v.campaign_content, v.campaign_steps).select("content_id", "step_no", "campaign_id", "variant", "step_key", "channel")


@query("pull_manual_status", """WITH pages_ AS (SELECT o_orderkey AS page_id, CASE o_orderstatus WHEN 'O' THEN 'Demo_Booked' WHEN 'P' THEN 'Connected' ELSE 'Closed_Won' END AS status FROM orders)
    SELECT l.lead_id, p.status AS new_status FROM campaign_leads l JOIN pages_ p ON p.page_id = l.lead_id WHERE p.status IN ('Demo_Booked', 'Deal_Created', 'Closed_Won', 'Closed_Lost') AND p.status <> l.lifecycle_status""", ("campaign_leads",))
def _(v):
    return _pulled(v).select("lead_id", "new_status")


def _pulled(v):
    pages = v.orders.select(F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "O", "Demo_Booked").when(F.col("o_orderstatus") == "P", "Connected").otherwise("Closed_Won").alias("status"))
    return J.pull_status(v.campaign_leads.withColumn("page_id", F.col("lead_id")), pages)


@query("conversion_evidence", """WITH pages_ AS (SELECT o_orderkey AS page_id, CASE o_orderstatus WHEN 'O' THEN 'Demo_Booked' WHEN 'P' THEN 'Connected' ELSE 'Closed_Won' END AS status FROM orders)
    SELECT l.campaign_id AS source_id, lower(p.status) AS metric, count(*) AS evidence_rows FROM campaign_leads l JOIN pages_ p ON p.page_id = l.lead_id WHERE p.status IN ('Demo_Booked', 'Closed_Won') AND p.status <> l.lifecycle_status GROUP BY 1, 2""", ("campaign_leads",))
def _(v):
    e = J.conversion_evidence(_pulled(v), F.lit("2025-01-01").cast("timestamp"))
    return e.groupBy("source_id", "metric").agg(F.count(F.lit(1)).alias("evidence_rows"))


RESOLVE_SQL = """
    WITH leads AS (SELECT contact_id, company, first_name || ' ' || last_name AS name FROM contacts), cand AS (SELECT ord AS candidate_no, company, first_name || ' ' || last_name AS cname, CASE WHEN ord % 10 = 0 THEN '' ELSE 'https://x/' || ord END AS url FROM suppression),
    p AS (SELECT l.*, c.candidate_no, c.url, lower(l.name) AS x, lower(c.cname) AS y, string_split(lower(l.name), ' ') AS px, string_split(lower(c.cname), ' ') AS py FROM leads l JOIN cand c ON c.company = l.company),
    sc AS (SELECT *, CASE WHEN x = y THEN 1.0 WHEN len(px) >= 2 AND len(list_filter(px, lambda a: len(list_filter(py, lambda q: contains(q, a) OR contains(a, q))) = 0)) = 0 THEN 0.9 WHEN px[1] = py[1] AND px[-1] = py[-1] THEN 0.85 ELSE 0.0 END AS score FROM p),
    b AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY score DESC, candidate_no) = 1)
    SELECT l.contact_id, coalesce(b.url, '') AS linkedin_url, CASE WHEN coalesce(b.url, '') = '' THEN 'not_found' WHEN b.score >= 0.9 THEN 'medium' ELSE 'low' END AS confidence FROM leads l LEFT JOIN b ON b.contact_id = l.contact_id"""


@query("resolve_profiles", RESOLVE_SQL, NEEDS)
def _(v):
    return _resolved(v).select("contact_id", "linkedin_url", "confidence")


def _resolved(v):
    full = F.concat_ws(" ", "first_name", "last_name")
    leads = v.contacts.select("contact_id", "company", full.alias("name"))
    cand = v.suppression.select(F.col("ord").alias("candidate_no"), "company", full.alias("name"), F.when(F.col("ord") % 10 == 0, "").otherwise(F.concat(F.lit("https://x/"), "ord")).alias("linkedin_url"))
    return J.resolve_profiles(leads, cand)


@query("resolution_stats", f"""SELECT count(*) AS total, count(*) FILTER (confidence <> 'not_found') AS found, count(*) FILTER (confidence = 'high') AS high_confidence, count(*) FILTER (confidence = 'medium') AS medium_confidence,
    count(*) FILTER (confidence = 'low') AS low_confidence, count(*) FILTER (confidence = 'not_found') AS not_found, 0 AS method_web_search, count(*) FILTER (confidence <> 'not_found') AS method_directory FROM ({RESOLVE_SQL}) r""", NEEDS)
def _(v):
    return J.resolution_stats(_resolved(v))


@query("route_webhooks", """
    WITH subs AS (SELECT s_suppkey AS hook_id, ['view', 'click', 'purchase', 'error', 'signup'][s_suppkey % 5 + 1] AS event, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 25 END AS campaign_id, s_suppkey % 4 <> 0 AS active FROM supplier),
    e AS (SELECT event_id, event_type AS event, user_id % 25 AS campaign_id FROM events)
    SELECT e.event_id, s.hook_id FROM e JOIN subs s ON s.event = e.event AND s.active AND (s.campaign_id IS NULL OR s.campaign_id = e.campaign_id)""")
def _(v):
    kinds = F.array(*[F.lit(k) for k in ("view", "click", "purchase", "error", "signup")])
    subs = v.supplier.select(
        F.col("s_suppkey").alias("hook_id"), F.element_at(kinds, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("event"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 25).alias("campaign_id"), (F.col("s_suppkey") % 4 != 0).alias("active"),
    )
    e = v.events.select("event_id", F.col("event_type").alias("event"), (F.col("user_id") % 25).alias("campaign_id"))
    return J.route_events(e, subs).select("event_id", "hook_id")


TRIGGERS = [
    ("funding", "enrich", "Funding at {{entity}}: {{data.amount}}"), ("funding", "slack", "{{type}} {{data.company}}"), ("hiring-surge", "qualify", "{{entity}} hires {{data.amount}}"),
    ("job-change", "campaign", "{{entity}} is now {{data.title}} at {{data.company}}"),
]
TRIGGER_SQL = ", ".join("(" + ", ".join(S.quoted(x) for x in t) + ")" for t in TRIGGERS)


@query("route_signals", f"""WITH t(signal_type, action, template) AS (VALUES {TRIGGER_SQL})
    SELECT o.obs_id, t.action, replace(replace(replace(replace(replace(t.template, '{{{{entity}}}}', CAST(o.entity_id AS VARCHAR)), '{{{{type}}}}', o.signal_type), '{{{{data.amount}}}}', CAST(o.amount AS VARCHAR)), '{{{{data.title}}}}', coalesce(o.title, '')), '{{{{data.company}}}}', o.company) AS message
    FROM observations o JOIN t ON t.signal_type = o.signal_type""", ("observations",))
def _(v):
    triggers = v.spark.createDataFrame(TRIGGERS, "signal_type string, action string, template string")
    return J.route_signals(v.observations, triggers).select("obs_id", "action", "message")


@query("enrich_from_pages", f"""
    WITH p AS (SELECT page_id, url, {S.domain('url')} AS site, html FROM pages), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1),
    l AS (SELECT page_id AS lead_id, {S.domain('url')} AS site, CASE WHEN page_id % 4 = 0 THEN 'known' ELSE '' END AS description, page_id % 5 = 0 AS no_site FROM pages)
    SELECT l.lead_id, CASE WHEN l.description <> '' THEN 'known' WHEN l.no_site OR f.html IS NULL THEN '' ELSE f.html END AS description, CASE WHEN l.description = '' AND NOT l.no_site THEN f.url END AS source_url FROM l LEFT JOIN f ON f.site = l.site""")
def _(v):
    leads = v.pages.select(
        F.col("page_id").alias("lead_id"), F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("www."), F.regexp_replace(F.lower("url"), r"^https?://(www\.)?", ""))).alias("website"),
        F.when(F.col("page_id") % 4 == 0, "known").otherwise("").alias("description"),
    )
    pages = v.pages.select("page_id", "url", F.col("html").alias("markdown"))
    return J.enrich_from_pages(leads, pages).select("lead_id", "description", "source_url")
