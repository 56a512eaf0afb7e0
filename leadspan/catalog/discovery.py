"""Queries for ledgers, feeds, signals, budgets and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadspan.catalog import snippets as S
from leadspan.catalog.registry import now, query
from leadspan.operators import admission as A
from leadspan.operators import feeds as FE
from leadspan.operators import ledger as L
from leadspan.operators import sequences as SQ
from leadspan.operators import signals as SG

FMT = "'%Y-%m-%d %H:%M:%S'"


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def keys_sql(table: str, row: str) -> str:
    return f"""SELECT {row} AS r, 'rr:' || rr_id AS k FROM {table} WHERE rr_id IS NOT NULL UNION ALL SELECT {row}, 'li:' || {S.linkedin('linkedin_url')} FROM {table} WHERE {S.linkedin('linkedin_url')} <> ''
      UNION ALL SELECT {row}, 'id:' || {S.person('name', 'company_name')} FROM {table} WHERE {S.person('name', 'company_name')} <> ''"""


@query("unseen_profiles", f"""WITH seen AS ({keys_sql('mined_people', 'mined_id')}), k AS ({keys_sql('new_profiles', 'ordinal')})
    SELECT ordinal FROM new_profiles WHERE ordinal NOT IN (SELECT r FROM k WHERE k IN (SELECT k FROM seen))""", ("new_profiles", "mined_people"))
def _(v):
    return L.unseen(v.new_profiles, v.mined_people).select("ordinal")


# one profile after the other; hashes stand for the keys
FIRST_COME = f"""known AS ({keys_sql('mined_people', 'mined_id')}), k AS ({keys_sql('new_profiles', 'ordinal')}), kl AS (SELECT r, list(hash(k)) AS ks FROM k GROUP BY 1),
    c AS (SELECT ordinal, coalesce(ks, []) AS ks, row_number() OVER (ORDER BY ordinal) AS step FROM new_profiles LEFT JOIN kl ON kl.r = ordinal WHERE ordinal NOT IN (SELECT r FROM k WHERE k IN (SELECT k FROM known))),
    fc AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS UBIGINT[]) AS held, CAST(NULL AS BIGINT) AS ordinal, false AS kept
      UNION ALL SELECT c.step, CASE WHEN list_has_any(fc.held, c.ks) THEN fc.held ELSE list_concat(fc.held, c.ks) END, c.ordinal, NOT list_has_any(fc.held, c.ks) FROM fc JOIN c ON c.step = fc.step + 1)"""


@query("filter_new_profiles", f"WITH RECURSIVE {FIRST_COME} SELECT ordinal FROM fc WHERE kept", ("new_profiles", "mined_people"))
def _(v):
    return L.filter_new(v.new_profiles, v.mined_people).select("ordinal")


@query("record_urls", f"""WITH b AS (SELECT sha1({S.norm_url('link')}) AS h, count(*) AS n, arg_min(link, item_no) AS u FROM feed_items GROUP BY 1), o AS (SELECT sha1({S.norm_url('url')}) AS h, url, times_seen, last_seen_at FROM stored_urls)
    SELECT coalesce(o.h, b.h) AS url_hash, coalesce(o.url, b.u) AS url, CASE WHEN o.h IS NOT NULL THEN o.times_seen + coalesce(b.n, 0) ELSE 1 END AS times_seen, strftime(CASE WHEN b.h IS NOT NULL THEN {S.NOW} ELSE o.last_seen_at END, {FMT}) AS last_seen FROM o FULL JOIN b ON b.h = o.h""", ("feed_items", "stored_urls"))
def _(v):
    out = L.record_urls(v.stored_urls, v.feed_items.withColumnRenamed("link", "url"), now(), "item_no")
    return out.select("url_hash", "url", "times_seen", ts("last_seen_at").alias("last_seen"))


COMPANIES_SQL = "stored AS (SELECT 'd' || s_suppkey || '.com' AS domain, s_name AS name, 3 AS people_count, TIMESTAMP '2024-01-01' AS last_mined_at FROM supplier)"


def _stored_companies(v):
    return v.supplier.select(F.concat(F.lit("d"), "s_suppkey", F.lit(".com")).alias("domain"), F.col("s_name").alias("name"), F.lit(3).cast("bigint").alias("people_count"), F.lit("2024-01-01").cast("timestamp").alias("last_mined_at"))


@query("record_companies", f"""WITH {COMPANIES_SQL}, p AS (SELECT {S.domain('company_domain')} AS domain, arg_min(company_name, ordinal) AS name FROM profiles GROUP BY 1)
    SELECT s.domain, s.name, s.people_count, strftime(CASE WHEN p.domain IS NOT NULL THEN {S.NOW} ELSE s.last_mined_at END, {FMT}) AS mined FROM stored s LEFT JOIN p ON p.domain = s.domain
    UNION ALL SELECT domain, name, 1, strftime({S.NOW}, {FMT}) FROM p WHERE domain <> '' AND domain NOT IN (SELECT domain FROM stored)""", ("profiles",))
def _(v):
    return L.record_companies(v.profiles, _stored_companies(v), now(), "ordinal").select("domain", "name", "people_count", ts("last_mined_at").alias("mined"))


@query("new_company_count", f"WITH {COMPANIES_SQL} SELECT count(DISTINCT {S.domain('company_domain')}) AS new_companies FROM profiles WHERE {S.domain('company_domain')} <> '' AND {S.domain('company_domain')} NOT IN (SELECT domain FROM stored)", ("profiles",))
def _(v):
    return L.new_companies(v.profiles, _stored_companies(v), "ordinal").agg(F.count(F.lit(1)).alias("new_companies"))


@query("backlog_count", "SELECT count(*) AS backlog FROM mined_people WHERE status = 'seen'", ("mined_people",))
def _(v):
    return L.backlog(v.mined_people)


@query("take_backlog", "SELECT mined_id, name FROM mined_people WHERE status = 'seen' ORDER BY first_seen_at, mined_id LIMIT 75", ("mined_people",))
def _(v):
    return L.take_backlog(v.mined_people, 75).select("mined_id", "name")


@query("advance_cursor", """WITH runs AS (SELECT 'q' || (l_suppkey % 50) AS q, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS run_no, CAST(l_quantity AS BIGINT) AS fetched, CAST(l_quantity AS BIGINT) % 12 AS fresh, l_quantity < 2 AS hit_end, CASE WHEN l_linenumber = 1 THEN l_orderkey END AS total FROM lineitem),
    cur AS (SELECT 'q' || s_suppkey AS q, s_suppkey * 10 + 1 AS next_start, s_suppkey % 3 AS streak, 'active' AS status, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS total FROM supplier),
    g AS (SELECT q, max(CASE WHEN fresh >= 5 THEN run_no END) AS good FROM runs GROUP BY q), a AS (SELECT r.q, sum(fetched) AS f, arg_max(hit_end, run_no) AS e, arg_max(total, run_no) FILTER (total IS NOT NULL) AS t, count(CASE WHEN g.good IS NULL OR r.run_no > g.good THEN 1 END) AS low, any_value(g.good) AS good FROM runs r JOIN g ON g.q = r.q GROUP BY r.q),
    s AS (SELECT c.*, a.q AS ran, a.f, a.e, a.t, CASE WHEN a.q IS NULL THEN c.streak WHEN a.good IS NULL THEN c.streak + a.low ELSE a.low END AS st FROM cur c LEFT JOIN a ON a.q = c.q)
    SELECT q AS query_hash, CAST(next_start + coalesce(f, 0) AS BIGINT) AS next_start, st AS low_yield_streak, CASE WHEN ran IS NULL THEN status WHEN e OR st >= 3 THEN 'exhausted' ELSE 'active' END AS status, coalesce(t, total) AS total_matches FROM s""")
def _(v):
    q = F.col("l_quantity").cast("bigint")
    runs = v.lineitem.select(
        F.concat(F.lit("q"), F.col("l_suppkey") % 50).alias("query_hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_no"), q.alias("fetched"), (q % 12).alias("fresh"),
        (F.col("l_quantity") < 2).alias("hit_end"), F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("total_matches"),
    )
    k = F.col("s_suppkey")
    cursors = v.supplier.select(F.concat(F.lit("q"), k).alias("query_hash"), (k * 10 + 1).alias("next_start"), (k % 3).alias("low_yield_streak"), F.lit("active").alias("status"), F.when(k % 2 == 0, k).alias("total_matches"))
    return L.advance_cursor(cursors, runs)


@query("dedup_engagers", """WITH e AS (SELECT event_id, CASE WHEN event_id % 90 = 0 THEN '' ELSE 'p' || user_id END AS provider_id, CASE WHEN event_type = 'click' THEN 'Commented' ELSE 'Reacted' END AS kind FROM events)
    SELECT provider_id, coalesce(min(CASE WHEN kind = 'Commented' THEN event_id END), min(event_id)) AS event_id, count(DISTINCT kind) = 2 AS also_reacted FROM e WHERE provider_id <> '' GROUP BY 1""")
def _(v):
    e = v.events.select("event_id", F.when(F.col("event_id") % 90 == 0, "").otherwise(F.concat(F.lit("p"), "user_id")).alias("provider_id"), F.when(F.col("event_type") == "click", "Commented").otherwise("Reacted").alias("engagement_type"))
    return L.dedup_engagers(e, "event_id").select("provider_id", "event_id", "also_reacted")


@query("union_distinct", """SELECT c_custkey AS id, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey * 3, 'supplier' FROM supplier WHERE s_suppkey * 3 NOT IN (SELECT c_custkey FROM customer)""")
def _(v):
    a = v.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    return L.union_distinct(a, v.supplier.select((F.col("s_suppkey") * 3).alias("id"), F.lit("supplier").alias("origin")), "id")


# in-batch repeats of incoming rows cannot occur here (unique ids), so plain SQL gives the same answer
@query("add_blocklist", """WITH i AS (SELECT c_custkey AS row_no, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'p' || c_custkey END AS provider_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'user-' || c_custkey END AS slug FROM customer),
    b AS (SELECT block_id, provider_id, CASE WHEN linkedin_url IS NOT NULL THEN regexp_replace(linkedin_url, '.*/in/', '') END AS slug FROM blocklist)
    SELECT provider_id, slug AS linkedin_slug FROM b UNION ALL SELECT provider_id, slug FROM i WHERE (provider_id IS NOT NULL OR slug IS NOT NULL) AND coalesce(provider_id NOT IN (SELECT provider_id FROM b WHERE provider_id IS NOT NULL), true) AND coalesce(slug NOT IN (SELECT slug FROM b WHERE slug IS NOT NULL), true)""", ("blocklist",))
def _(v):
    k = F.col("c_custkey")
    incoming = v.customer.select(k.alias("row_no"), F.when(k % 4 != 0, F.concat(F.lit("p"), k)).alias("provider_id"), F.when(k % 3 != 0, F.concat(F.lit("user-"), k)).alias("linkedin_slug"))
    stored = v.blocklist.select("provider_id", F.regexp_replace("linkedin_url", ".*/in/", "").alias("linkedin_slug"))
    return L.add_blocklist(incoming, stored)


SOURCES = ["click", "error", "purchase", "signup", "view"]
FRESH_SQL = f"""it AS (SELECT *, sha1({S.norm_url('link')}) AS h, list_position({SOURCES}, source_key) AS fo FROM feed_items), sn AS (SELECT sha1({S.norm_url('url')}) AS h FROM stored_urls),
    nw AS (SELECT it.* FROM it LEFT JOIN watermarks w ON w.source_key = it.source_key WHERE h NOT IN (SELECT h FROM sn) AND (published_at IS NULL OR w.last_published_at IS NULL OR published_at > w.last_published_at)),
    fresh AS (SELECT nw.* FROM nw JOIN (SELECT h, min(fo) AS o FROM nw GROUP BY h) x ON x.h = nw.h AND x.o = nw.fo)"""
FRESH_NEEDS = ("feed_items", "watermarks", "stored_urls")


def _items(v):
    from leadspan.functions.normalize import hash_url

    return v.feed_items.withColumn("feed_order", FE.feed_order(F.col("source_key"), SOURCES)), v.stored_urls.select(hash_url(F.col("url")).alias("url_hash"))


@query("fresh_items", f"WITH {FRESH_SQL} SELECT item_no, source_key FROM fresh", FRESH_NEEDS)
def _(v):
    items, seen = _items(v)
    return FE.fresh_items(items, v.watermarks, seen).select("item_no", "source_key")


@query("next_watermarks", f"""WITH n AS (SELECT source_key, max(published_at) AS m FROM feed_items GROUP BY 1) SELECT coalesce(n.source_key, w.source_key) AS source_key, strftime(coalesce(n.m, w.last_published_at), {FMT}) AS mark FROM n FULL JOIN watermarks w ON w.source_key = n.source_key""", ("feed_items", "watermarks"))
def _(v):
    return FE.next_watermarks(v.feed_items, v.watermarks).select("source_key", ts("last_published_at").alias("mark"))


@query("poll_report", f"""WITH {FRESH_SQL} SELECT i.source_key, count(*) AS total_fetched, strftime(max(i.published_at), {FMT}) AS newest, count(CASE WHEN i.item_no IN (SELECT item_no FROM fresh) THEN 1 END) AS new_items FROM it i GROUP BY 1""", FRESH_NEEDS)
def _(v):
    items, seen = _items(v)
    return FE.poll_report(items, FE.fresh_items(items, v.watermarks, seen)).select("source_key", "total_fetched", ts("newest").alias("newest"), "new_items")


SIGNAL_SQL = """b AS (SELECT entity_id, signal_type, arg_max({'a': amount, 'r': round_name, 't': title, 'c': company, 'o': observed_at}, {'o': observed_at, 'i': obs_id}) AS x FROM observations WHERE observed_at < TIMESTAMP '2024-01-15' GROUP BY 1, 2),
    n AS (SELECT o.entity_id, o.signal_type, count(*) AS new_items, arg_max({'a': amount, 'r': round_name, 't': title, 'c': company, 'o': observed_at}, {'o': observed_at, 'i': obs_id}) AS y FROM observations o JOIN b ON b.entity_id = o.entity_id AND b.signal_type = o.signal_type AND o.observed_at > b.x.o GROUP BY 1, 2),
    d AS (SELECT b.entity_id, b.signal_type, new_items, b.x, n.y, CASE b.signal_type WHEN 'funding' THEN CASE WHEN y.a > x.a THEN 'funding_total' WHEN y.r IS DISTINCT FROM x.r THEN 'new_round' END WHEN 'hiring-surge' THEN CASE WHEN y.a - x.a >= 5 THEN 'surge' END
      WHEN 'job-change' THEN CASE WHEN y.c IS DISTINCT FROM x.c AND y.t IS DISTINCT FROM x.t THEN 'both' WHEN y.c IS DISTINCT FROM x.c THEN 'company' WHEN y.t IS DISTINCT FROM x.t THEN 'title' END ELSE 'items' END AS detail FROM b JOIN n ON n.entity_id = b.entity_id AND n.signal_type = b.signal_type)"""


def _watches(v):
    return SG.baselines(v.observations.filter("observed_at < TIMESTAMP '2024-01-15 00:00:00'"))


@query("detect_signals", f"WITH {SIGNAL_SQL} SELECT entity_id, signal_type, detail, y.a - x.a AS delta, new_items, strftime(y.o, {FMT}) AS detected, y.t AS base_title, y.c AS base_company FROM d WHERE detail IS NOT NULL", ("observations",))
def _(v):
    return SG.detect_signals(_watches(v), v.observations).select("entity_id", "signal_type", "detail", "delta", "new_items", ts("detected_at").alias("detected"), "base_title", "base_company")


@query("next_watches", f"WITH {SIGNAL_SQL} SELECT b.entity_id, b.signal_type, CASE WHEN d.detail IS NOT NULL THEN d.y.a ELSE b.x.a END AS base_amount, strftime(CASE WHEN d.detail IS NOT NULL THEN d.y.o ELSE b.x.o END, {FMT}) AS checked FROM b LEFT JOIN d ON d.entity_id = b.entity_id AND d.signal_type = b.signal_type AND d.detail IS NOT NULL", ("observations",))
def _(v):
    w = _watches(v)
    return SG.next_watches(w, SG.detect_signals(w, v.observations)).select("entity_id", "signal_type", "base_amount", ts("last_checked_at").alias("checked"))


@query("dedup_signals", "SELECT entity_id, signal_type, strftime(observed_at, '%Y-%m-%d') AS signal_day, min(obs_id) AS obs_id FROM observations GROUP BY 1, 2, 3", ("observations",))
def _(v):
    s = v.observations.select(F.lit("default").alias("tenant_id"), "entity_id", "signal_type", "obs_id", F.col("observed_at").alias("detected_at"))
    return SG.dedup_signals(s, F.col("detected_at")).select("entity_id", "signal_type", "signal_day", "obs_id")


CAP_SQL = "CASE provider WHEN 'linkedin.connect' THEN 30 WHEN 'linkedin.dm' THEN 50 WHEN 'email.send' THEN 50 WHEN 'data.search' THEN 100 ELSE 100 END"


@query("admit_single_tokens", f"""SELECT request_id FROM send_requests QUALIFY row_number() OVER (PARTITION BY tenant_id, provider, account_id ORDER BY requested_at, request_id) <= {CAP_SQL}""", ("send_requests",))
def _(v):
    # all requests put on one day, so that the caps bind
    one = v.send_requests.withColumn("tokens", F.lit(1)).withColumn("at", F.col("requested_at")).withColumn("requested_at", F.lit("2024-01-01").cast("timestamp"))
    return A.admit(one, ["at", "request_id"]).select("request_id")


# one request after the other in every bucket
@query("admit_requests", """WITH RECURSIVE q AS (SELECT tenant_id, provider, account_id, tokens, row_number() OVER (PARTITION BY tenant_id, provider, account_id ORDER BY requested_at, request_id) AS step FROM send_requests),
    r AS (SELECT DISTINCT tenant_id, provider, account_id, CAST(0 AS BIGINT) AS step, CAST(CASE provider WHEN 'linkedin.connect' THEN 30 WHEN 'linkedin.dm' THEN 50 WHEN 'email.send' THEN 50 WHEN 'data.search' THEN 100 ELSE 100 END AS BIGINT) AS rest FROM q
      UNION ALL SELECT r.tenant_id, r.provider, r.account_id, q.step, CASE WHEN q.tokens <= r.rest THEN r.rest - q.tokens ELSE r.rest END FROM r JOIN q ON q.tenant_id = r.tenant_id AND q.provider = r.provider AND q.account_id = r.account_id AND q.step = r.step + 1)
    SELECT tenant_id, provider, account_id, '2024-01-01' AS day, arg_max(rest, step) AS tokens_remaining FROM r GROUP BY 1, 2, 3""", ("send_requests",))
def _(v):
    one_day = v.send_requests.withColumn("at", F.col("requested_at")).withColumn("requested_at", F.lit("2024-01-01").cast("timestamp"))
    granted = A.admit(one_day, ["at", "request_id"])
    return A.remaining(one_day, granted)


@query("connect_budget", """WITH today AS (SELECT campaign_id, count(*) AS n FROM campaign_leads WHERE strftime(connect_sent_at, '%Y-%m-%d') = '1997-03-03' GROUP BY 1), q AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY lead_id) AS slot FROM campaign_leads WHERE lifecycle_status = 'Queued')
    SELECT q.lead_id, q.slot FROM q JOIN campaigns c ON c.campaign_id = q.campaign_id LEFT JOIN today t ON t.campaign_id = q.campaign_id WHERE q.slot <= greatest(0, c.daily_limit - coalesce(t.n, 0))""", ("campaign_leads", "campaigns"))
def _(v):
    return A.connect_budget(v.campaign_leads, v.campaigns, F.lit("1997-03-03 10:00:00").cast("timestamp")).select("lead_id", "slot")


STEPS = [
    SQ.Step(0, "linkedin", "view_profile"), SQ.Step(1, "linkedin", "connect", "Hello {{first_name}}, saw {{company}}", "!connect_sent_linkedin"),
    SQ.Step(3, "email", "send", "Hello {{first_name}}\nHow is {{headline}}?", "!opened_email AND !sent_email", "Quick question"),
    SQ.Step(5, "linkedin", "dm", "Hello {{first_name}}, about {{headline}} - ok?", "connected_linkedin AND !dm_sent_linkedin"),
    SQ.Step(9, "email", "send", "Hello again {{first_name}}", "sent_email"), SQ.Step(12, "twitter", "follow", None, "connect_sent_linkedin"),
]
STEP_NOW = "TIMESTAMP '2001-01-01 00:00:00'"
NEXT_SQL = f"""x AS (SELECT *, CAST(floor((epoch_us({STEP_NOW}) - epoch_us(created_at)) / 8.64e10) AS BIGINT) AS days FROM campaign_leads),
    st AS (SELECT *, CASE WHEN replied_at IS NOT NULL OR email_replied_at IS NOT NULL THEN NULL WHEN days >= 1 AND connect_sent_at IS NULL THEN 1 WHEN days >= 3 AND email_bounced_at IS NULL AND email_opened_at IS NULL AND email_sent_at IS NULL THEN 2
      WHEN days >= 5 AND connected_at IS NOT NULL AND dm1_sent_at IS NULL AND dm2_sent_at IS NULL THEN 3 WHEN days >= 9 AND email_bounced_at IS NULL AND email_sent_at IS NOT NULL THEN 4 WHEN days >= 12 AND connect_sent_at IS NOT NULL THEN 5 END AS step_index FROM x)"""


@query("next_step", f"WITH {NEXT_SQL} SELECT lead_id, days, step_index FROM st", ("campaign_leads",))
def _(v):
    leads = v.campaign_leads.withColumn("started_at", F.col("created_at"))
    return SQ.next_step(leads, STEPS, F.lit("2001-01-01").cast("timestamp"), F.lit(1)).select("lead_id", "days", "step_index")


def _plan_sql() -> str:
    msg = {1: "'Hello ' || coalesce(first_name, '') || ', saw ' || coalesce(company, '')", 2: "'Hello ' || coalesce(first_name, '') || chr(10) || 'How is ' || coalesce(headline, '') || '?'", 3: "'Hello ' || coalesce(first_name, '') || ', about ' || coalesce(headline, '') || ' - ok?'", 4: "'Hello again ' || coalesce(first_name, '')"}
    cases = " ".join(f"WHEN {i} THEN {m}" for i, m in msg.items())
    return f"""WITH {NEXT_SQL}, m AS (SELECT *, CASE step_index {cases} END AS message FROM st),
      w AS (SELECT *, CASE WHEN step_index IS NULL THEN CASE WHEN replied_at IS NOT NULL OR email_replied_at IS NOT NULL THEN 'replied' ELSE 'waiting' END WHEN step_index = 5 THEN 'channel_not_supported'
        WHEN step_index = 1 THEN CASE WHEN {S.broken_list('message')} <> '' THEN 'blocked_validator' ELSE 'want:linkedin.connect' END WHEN step_index = 3 THEN CASE WHEN {S.broken_list('message')} <> '' THEN 'blocked_validator' ELSE 'want:linkedin.dm' END
        ELSE CASE WHEN coalesce(email, '') = '' THEN 'skipped_no_email' WHEN {S.broken_list('message')} <> '' THEN 'blocked_validator' ELSE 'want:email.send' END END AS s FROM m),
      r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, s ORDER BY lead_id) AS rn FROM w)
      SELECT lead_id, CASE step_index WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 9 WHEN 5 THEN 12 ELSE days END AS day, CASE step_index WHEN 1 THEN 'linkedin' WHEN 3 THEN 'linkedin' WHEN 2 THEN 'email' WHEN 4 THEN 'email' WHEN 5 THEN 'twitter' ELSE '-' END AS channel,
        CASE WHEN s LIKE 'want:%' AND rn > CASE s WHEN 'want:linkedin.connect' THEN 30 ELSE 50 END THEN 'rate_limited' WHEN s = 'want:email.send' THEN 'queued_email' WHEN s LIKE 'want:%' THEN 'sent' ELSE s END AS status FROM r"""


PLAN_STEPS = STEPS[1:]


@query("plan_sequence", _plan_sql(), ("campaign_leads",))
def _(v):
    return _planned(v).select("lead_id", "day", "channel", "status")


def _planned(v):
    leads = v.campaign_leads.withColumn("started_at", F.col("created_at"))
    return SQ.plan_sequence(leads, PLAN_STEPS, F.lit("2001-01-01").cast("timestamp"))


@query("action_summary", f"WITH plan AS ({_plan_sql()}) SELECT 'channel' AS kind, channel AS label, count(*) AS actions FROM plan GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM plan GROUP BY 2", ("campaign_leads",))
def _(v):
    from leadspan.operators.reviews import action_summary

    return action_summary(_planned(v))


@query("assign_variants", "SELECT lead_id, ['A', 'B', 'C', 'D'][(row_number() OVER (PARTITION BY campaign_id ORDER BY created_at, lead_id) - 1) % 4 + 1] AS variant FROM campaign_leads", ("campaign_leads",))
def _(v):
    return SQ.assign_variants(v.campaign_leads.select("campaign_id", "created_at", "lead_id"), ["A", "B", "C", "D"], ["campaign_id"], ["created_at", "lead_id"]).select("lead_id", "variant")


@query("rotate_templates", "SELECT message_id, replace(['Hello {{name}}!', 'Thanks {{name}}', '{{name}}, sent'][(row_number() OVER (ORDER BY message_id) - 1) % 3 + 1], '{{name}}', string_split(role || ' x', ' ')[1]) AS reply_text FROM messages", ("messages",))
def _(v):
    targets = v.messages.select(F.lit("post").alias("post"), "message_id", F.concat("role", F.lit(" x")).alias("author"))
    return SQ.rotate_templates(targets, ["Hello {{name}}!", "Thanks {{name}}", "{{name}}, sent"], ["post"], ["message_id"], F.col("author")).select("message_id", "reply_text")


@query("create_campaign", """WITH q AS (SELECT *, CASE WHEN lifecycle_status = 'Queued' OR lifecycle_status = 'Expired' THEN 'Qualified' ELSE lifecycle_status END AS ls FROM campaign_leads), f AS (SELECT * FROM q WHERE ls = 'Qualified' AND contains(lower(coalesce(headline, '')), 'e'))
    SELECT lead_id, 777 AS campaign_id, 'Queued' AS lifecycle_status, ['A', 'B'][(row_number() OVER (PARTITION BY tenant_id ORDER BY lead_id) - 1) % 2 + 1] AS variant FROM f""", ("campaign_leads",))
def _(v):
    status = F.when(F.col("lifecycle_status").isin("Queued", "Expired"), "Qualified").otherwise(F.col("lifecycle_status"))
    out = SQ.create_campaign(v.campaign_leads.withColumn("lifecycle_status", status).select("tenant_id", "lead_id", "headline", "lifecycle_status"), ["A", "B"], {"headline": "E"}, 777)
    return out.select("lead_id", "campaign_id", "lifecycle_status", "variant")
