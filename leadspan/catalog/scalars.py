"""Queries over row-level functions: keys, similarity, messages, schedules, scores and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadspan.catalog import snippets as S
from leadspan.catalog.registry import now, query
from leadspan.functions import conditions as C
from leadspan.functions import messages as M
from leadspan.functions import normalize as N
from leadspan.functions import schedule as SC
from leadspan.functions import scoring as G
from leadspan.functions import segments as SG
from leadspan.functions import similarity as SIM
from leadspan.functions.stats import js_round
from leadspan.operators import filters as FL
from leadspan.operators import reports as R
from leadspan.operators.ranking import computed
from leadspan.session import spread

BOOL = "CAST({} AS INTEGER)"


@query("normalize_linkedin", f"SELECT contact_id, {S.linkedin('linkedin_url')} AS profile FROM contacts", ("contacts",))
def _(v):
    return v.contacts.select("contact_id", N.norm_linkedin(F.col("linkedin_url")).alias("profile"))


@query("normalize_email", f"SELECT contact_id, lower(trim(coalesce(email, ''))) AS email_key, {S.email_domain('email')} AS domain FROM contacts", ("contacts",))
def _(v):
    return v.contacts.select("contact_id", N.norm_email(F.col("email")).alias("email_key"), N.email_domain(F.col("email")).alias("domain"))


@query("normalize_domain", f"SELECT ordinal, {S.domain('company_domain')} AS domain FROM profiles", ("profiles",))
def _(v):
    return v.profiles.select("ordinal", N.norm_domain(F.col("company_domain")).alias("domain"))


@query("normalize_person", f"""SELECT ordinal, {S.name('name')} AS name_key, {S.company('company_name')} AS company_name_key,
    {S.person('name', 'company_name')} AS identity_key FROM profiles""", ("profiles",))
def _(v):
    n, c = F.col("name"), F.col("company_name")
    return v.profiles.select("ordinal", N.norm_name(n).alias("name_key"), N.norm_company(c).alias("company_name_key"), N.person_key(n, c).alias("identity_key"))


@query("normalize_name_text", r"""SELECT doc_id, trim(regexp_replace(lower(strip_accents(regexp_replace(text, '([À-ÖØ-öø-ÿŒœ])', '\1 ', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS words FROM documents""")
def _(v):
    return v.documents.select("doc_id", N.norm_name(F.col("text")).alias("words"))


@query("normalize_url", f"SELECT page_id, {S.norm_url('url')} AS url_key, sha1({S.norm_url('url')}) AS url_hash FROM pages")
def _(v):
    return v.pages.select("page_id", N.norm_url(F.col("url")).alias("url_key"), N.hash_url(F.col("url")).alias("url_hash"))


@query("query_hash", r"""SELECT ordinal, sha1('{"titles":[' || CASE WHEN title IS NULL THEN '' ELSE '"' || lower(title) || '"' END || '],"companyNames":[' ||
    array_to_string(list_transform(list_sort([lower(trim(company_name)), 'zeta']), lambda s: '"' || s || '"'), ',') || '],"companyIndustry":[],"location":[],"keywords":[]}') AS query_key FROM profiles""", ("profiles",))
def _(v):
    lists = {"titles": F.array_compact(F.array("title")), "companyNames": F.array(F.lit(" ZETA"), "company_name")}
    return v.profiles.select("ordinal", N.hash_query(lists).alias("query_key"))


@query("content_hash", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))) AS hash FROM documents")
def _(v):
    return v.documents.select("doc_id", N.content_hash(F.col("text")).alias("hash"))


@query("company_quality_key", f"SELECT result_set_id, row_index, {S.company_key('company_name', 'website')} AS company_key FROM result_rows", ("result_rows",))
def _(v):
    return v.result_rows.select("result_set_id", "row_index", N.company_key(F.col("company_name"), F.col("website")).alias("company_key"))


PAIRS_SQL = """pairs AS (SELECT c.contact_id, lower(trim(concat_ws(' ', c.first_name, c.last_name, c.company))) AS a, lower(trim(concat_ws(' ', s.first_name, s.last_name, s.company))) AS b,
    concat_ws(' ', c.first_name, c.last_name) AS na, concat_ws(' ', s.first_name, s.last_name) AS nb FROM contacts c JOIN suppression s ON s.ord = c.contact_id + 1000000000000)"""


def _pairs(v):
    s = v.suppression.select((F.col("ord") - 1000000000000).alias("contact_id"), *[F.col(c).alias("s_" + c) for c in ("first_name", "last_name", "company")])
    both = v.contacts.join(s, "contact_id")
    return both.select(
        "contact_id", F.concat_ws(" ", "first_name", "last_name", "company").alias("a"), F.concat_ws(" ", "s_first_name", "s_last_name", "s_company").alias("b"),
        F.concat_ws(" ", "first_name", "last_name").alias("na"), F.concat_ws(" ", "s_first_name", "s_last_name").alias("nb"),
    )


@query("dice_similarity", f"WITH {PAIRS_SQL} SELECT contact_id, round(CASE WHEN a = b THEN 1.0 ELSE {S.dice_sets(S.bigrams('a'), S.bigrams('b'))} END, 6) AS dice FROM pairs", ("contacts", "suppression"))
def _(v):
    return _pairs(v).select("contact_id", F.round(SIM.dice(F.col("a"), F.col("b")), 6).alias("dice"))


@query("field_similarity", f"""
    WITH names AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS x, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS y,
      regexp_replace(lower(substr(p_name, 1, 4) || ' ' || p_brand), '[^a-z0-9]+', '_', 'g') AS z FROM part)
    SELECT p_partkey, round(CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.85 ELSE {S.dice_sets(S.bigrams('x'), S.bigrams('y'))} END, 6) AS to_type,
      round(CASE WHEN x = z THEN 1.0 WHEN contains(x, z) OR contains(z, x) THEN 0.85 ELSE {S.dice_sets(S.bigrams('x'), S.bigrams('z'))} END, 6) AS to_short FROM names""")
def _(v):
    short = F.concat(F.substring("p_name", 1, 4), F.lit(" "), F.col("p_brand"))
    return spread(v.part.select("p_partkey", "p_name", "p_type", "p_brand")).select(
        "p_partkey", F.round(SIM.field_sim(F.col("p_name"), F.col("p_type")), 6).alias("to_type"), F.round(SIM.field_sim(F.col("p_name"), short), 6).alias("to_short")
    )


@query("name_match", f"""WITH {PAIRS_SQL}, parts AS (SELECT contact_id, lower(na) AS x, lower(nb) AS y, string_split(lower(na), ' ') AS px, string_split(lower(nb), ' ') AS py FROM pairs)
    SELECT contact_id, CASE WHEN x = y THEN 1.0 WHEN len(px) >= 2 AND len(list_filter(px, lambda p: len(list_filter(py, lambda q: contains(q, p) OR contains(p, q))) = 0)) = 0 THEN 0.9
      WHEN len(px) >= 2 AND len(py) >= 2 AND px[1] = py[1] AND px[-1] = py[-1] THEN 0.85 ELSE 0.0 END AS score FROM parts""", ("contacts", "suppression"))
def _(v):
    return _pairs(v).select("contact_id", SIM.name_match(F.col("na"), F.col("nb")).alias("score"))


@query("title_has_name", r"""WITH m AS (SELECT page_id, lower(strip_accents(html)) AS t, string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.') AS p FROM pages)
    SELECT page_id, len(p[1]) > 1 AND contains(t, p[1]) AND len(p[-1]) > 1 AND contains(t, p[-1]) AS found,
      regexp_replace(regexp_replace(array_to_string(p, '.'), '(?i)\.(com|io|co|net|org|ai|dev|app|tech|xyz|us|uk|de|fr|es|it|nl|be|ch|at|ca|au)$', ''), '\.', ' ', 'g') AS company_guess FROM m""")
def _(v):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return v.pages.select(
        "page_id", SIM.title_has_name(F.col("html"), F.regexp_replace(host, r"\.", " ")).alias("found"), N.company_from_domain(host).alias("company_guess")
    )


@query("token_estimates", "SELECT doc_id, CAST(ceil(len(text) * 0.28::DOUBLE) AS BIGINT) AS tokens_028, CAST(ceil(len(text) / 4.0::DOUBLE) AS BIGINT) AS tokens_4 FROM documents")
def _(v):
    return v.documents.select("doc_id", N.approx_tokens(F.col("text")).alias("tokens_028"), N.quarter_tokens(F.col("text")).alias("tokens_4"))


QUERY_TEXT = "the nation of that queue reading"


@query("keyword_score", f"""SELECT doc_id, len(tk) AS token_count, array_to_string(list_sort(list_distinct(list_intersect(tk, {S.tokens(S.quoted(QUERY_TEXT))}))), ',') AS hits,
    round(CASE WHEN len(tk) = 0 THEN 0.0 ELSE len(list_distinct(list_intersect(tk, {S.tokens(S.quoted(QUERY_TEXT))}))) / greatest(1, log2(len(tk) + 2)) END, 6) AS score
    FROM (SELECT doc_id, {S.tokens('text')} AS tk FROM documents) d""")
def _(v):
    read = computed(v.documents.select("doc_id", "text"), _q=F.array_distinct(N.tokens(F.lit(QUERY_TEXT))), _t=N.tokens(F.col("text")))
    q, t = F.col("_q"), F.col("_t")
    return read.select(
        "doc_id", F.size(t).alias("token_count"), F.array_join(F.array_sort(F.array_intersect(t, q)), ",").alias("hits"), F.round(SIM.keyword_score(q, t), 6).alias("score")
    )


@query("cosine_similarity", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(v):
    nxt = v.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.embeddings.join(nxt, "vec_id").select("vec_id", F.round(SIM.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("rerank_terms", f"""SELECT node_id, CASE confidence WHEN 'proven' THEN 0.4 WHEN 'validated' THEN 0.2 ELSE 0.0 END AS confidence_boost,
    round(CASE WHEN last_accessed_at IS NULL THEN 0.0 ELSE -0.2 * (1 - exp(-((epoch_us({S.NOW}) - epoch_us(last_accessed_at)) / 8.64e10) / 90)) END, 6) AS recency_decay,
    round(CASE WHEN access_count <= 0 THEN 0.0 ELSE least(0.15, log2(access_count + 1) * 0.03) END, 6) AS access_boost FROM memory_nodes""", ("memory_nodes",))
def _(v):
    from leadspan.operators.memory import rerank_terms

    terms = rerank_terms(now())
    return v.memory_nodes.select("node_id", *[F.round(c, 6).alias(n) for n, c in terms.items()])


@query("hours_between", """SELECT lead_id, round(CASE WHEN connected_at > connect_sent_at THEN (epoch_us(connected_at) - epoch_us(connect_sent_at)) / 3.6e9 END, 6) AS hours_to_accept,
    strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week_start, strftime(created_at, '%G-W%V') AS iso_week FROM campaign_leads""", ("campaign_leads",))
def _(v):
    return v.campaign_leads.select(
        "lead_id", F.round(R.hours_between(F.col("connect_sent_at"), F.col("connected_at")), 6).alias("hours_to_accept"),
        R.week_start(F.col("created_at")).alias("week_start"), R.iso_week(F.col("created_at")).alias("iso_week"),
    )


LOCAL = "timezone(s.timezone, timezone('UTC', CAST(e.ts AS TIMESTAMP)))"


@query("send_window", f"""
    WITH s AS (SELECT * FROM campaigns), e AS (SELECT event_id, ts, user_id % 25 AS cid FROM events),
    x AS (SELECT e.event_id, s.*, {LOCAL} AS local FROM e JOIN s ON s.campaign_id = e.cid),
    y AS (SELECT *, isodow(local) AS dow, hour(local) * 60 + minute(local) AS mins,
       CAST(split_part(window_start, ':', 1) AS INT) * 60 + CAST(split_part(window_start, ':', 2) AS INT) AS ws, CAST(split_part(window_end, ':', 1) AS INT) * 60 + CAST(split_part(window_end, ':', 2) AS INT) AS we,
       ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'] AS dn FROM x)
    SELECT event_id, list_contains(active_days, dow) AND mins >= ws AND mins < we AS allowed,
      CASE WHEN NOT list_contains(active_days, dow) THEN dn[dow] || ' is not an active day (active: ' || array_to_string(list_transform(active_days, lambda d: dn[d]), ',') || ')'
        WHEN mins < ws OR mins >= we THEN 'current: ' || dn[dow] || ' ' || strftime(local, '%H:%M') || ' ' || timezone || ', window: ' || window_start || '-' || window_end ELSE '' END AS reason,
      coalesce(strftime(local, '%Y-%m-%d') >= start_at, false) AS activate FROM y""", ("campaigns",))
def _(v):
    e = v.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 25).alias("campaign_id"))
    j = e.join(v.campaigns, "campaign_id")
    allowed, reason = SC.send_window(F.col("ts"), F.col("timezone"), F.col("active_days"), F.col("window_start"), F.col("window_end"))
    return j.select("event_id", allowed.alias("allowed"), reason.alias("reason"), SC.should_activate(F.col("ts"), F.col("timezone"), F.col("start_at")).alias("activate"))


@query("delay_elapsed", """
    WITH x AS (SELECT l.lead_id, l.connected_at AS ts, c.delay_mode, c.active_days, c.timezone, TIMESTAMP '1997-06-15 12:00:00' AS now_ FROM campaign_leads l JOIN campaigns c ON c.campaign_id = l.campaign_id),
    due AS (SELECT *, list_filter(range(1, 22), lambda i: list_contains(active_days, isodow(timezone(timezone, timezone('UTC', ts + to_days(CAST(i AS INTEGER))))))) AS steps FROM x)
    SELECT lead_id, CASE WHEN ts IS NULL THEN false WHEN delay_mode = 'business' THEN coalesce(ts + to_days(CAST(steps[3] AS INTEGER)) <= now_, false) ELSE epoch_us(now_) - epoch_us(ts) >= 3 * 86400000000 END AS due,
      CASE WHEN ts IS NOT NULL THEN CAST(floor((epoch_us(now_) - epoch_us(ts)) / 8.64e10) AS BIGINT) END AS days_since FROM due""", ("campaign_leads", "campaigns"))
def _(v):
    now = F.lit("1997-06-15 12:00:00").cast("timestamp")
    j = v.campaign_leads.select("lead_id", "campaign_id", "connected_at").join(v.campaigns.select("campaign_id", "delay_mode", "active_days", "timezone"), "campaign_id")
    return j.select(
        "lead_id", SC.delay_elapsed(F.col("connected_at"), 3, F.col("delay_mode"), F.col("active_days"), F.col("timezone"), now).alias("due"),
        SC.days_since(F.col("connected_at"), now).alias("days_since"),
    )


TEMPLATE = "Hello {{first_name}} {{last_name}}, how is {{company}}? {{headline}}"


@query("render_template", f"""SELECT contact_id, replace(replace(replace(replace({S.quoted(TEMPLATE)}, '{{{{first_name}}}}', coalesce(first_name, '')), '{{{{last_name}}}}', coalesce(last_name, '')),
    '{{{{company}}}}', coalesce(company, '')), '{{{{headline}}}}', coalesce(headline, '')) AS message FROM contacts""", ("contacts",))
def _(v):
    return v.contacts.select("contact_id", M.render(F.lit(TEMPLATE), {c: F.col(c) for c in ("first_name", "last_name", "company", "headline")}).alias("message"))


@query("validate_messages", f"""SELECT message_id, {S.broken_list('text')} AS violations, {S.broken_list('text')} = '' AS valid,
    CASE WHEN {S.broken_list('text')} <> '' THEN CASE WHEN len(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END END AS excerpt FROM messages""", ("messages",))
def _(v):
    out = M.validate_messages(v.messages, "text")
    return out.select("message_id", F.array_join("violations", ",").alias("violations"), "valid", "excerpt")


def _fix_sql() -> str:
    sql, flags = "SELECT message_id, text AS t0 FROM messages", []
    for i, rule in enumerate(M.RULE_NAMES):
        fix = S.rule_fix(rule, f"t{i}")
        nxt = f"CASE WHEN {S.rule_broken(rule, f't{i}')} THEN {fix} ELSE t{i} END" if fix else f"t{i}"
        sql = f"SELECT *, CASE WHEN {S.rule_broken(rule, f't{i}')} THEN '{rule}' END AS b{i}, {nxt} AS t{i + 1} FROM ({sql}) q{i}"
    n = len(M.RULE_NAMES)
    bad = ", ".join(f"b{i}" for i in range(n))
    did = ", ".join(f"CASE WHEN t{i} <> t{i + 1} THEN '{r}' END" for i, r in enumerate(M.RULE_NAMES))
    return f"""SELECT message_id, t{n} AS fixed_text, array_to_string(list_filter([{bad}], lambda r: r IS NOT NULL), ',') AS violations,
      array_to_string(list_filter([{did}], lambda r: r IS NOT NULL), ',') AS fixes FROM ({sql}) q"""


@query("fix_messages", _fix_sql(), ("messages",))
def _(v):
    out = M.fix_messages(v.messages, "text")
    return out.select("message_id", "fixed_text", F.array_join("violations", ",").alias("violations"), F.array_join("fixes", ",").alias("fixes"))


@query("copy_qa", r"""SELECT doc_id, len(regexp_split_to_array(text, '[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+')) AS word_count,
    len(regexp_split_to_array(text, '[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+')) > 90 AS too_long, contains(text, '—') AS has_em_dash FROM documents""")
def _(v):
    return M.copy_qa(v.documents.select("doc_id", "text"), "text").drop("text")


@query("channel_states", """SELECT lead_id, connected_at IS NOT NULL AS connected, connect_sent_at IS NOT NULL AS connect_sent, dm1_sent_at IS NOT NULL OR dm2_sent_at IS NOT NULL AS dm_sent,
    replied_at IS NOT NULL AS replied, email_sent_at IS NOT NULL AS email_sent, email_opened_at IS NOT NULL AS email_opened, email_replied_at IS NOT NULL AS email_replied, email_bounced_at IS NOT NULL AS email_bounced FROM campaign_leads""", ("campaign_leads",))
def _(v):
    s = v.campaign_leads.select("lead_id", C.channel_states().alias("states"))
    li, em = F.col("states.linkedin"), F.col("states.email")
    return s.select(
        "lead_id", li["connected"].alias("connected"), li["connect_sent"].alias("connect_sent"), li["dm_sent"].alias("dm_sent"), li["replied"].alias("replied"),
        em["sent"].alias("email_sent"), em["opened"].alias("email_opened"), em["replied"].alias("email_replied"), em["bounced"].alias("email_bounced"),
    )


STEP_TEXT = "connected_linkedin AND !replied_any OR (opened_email AND !(bounced_email OR unknown_name))"


@query("step_condition", """SELECT lead_id, (connected_at IS NOT NULL AND NOT (email_replied_at IS NOT NULL OR replied_at IS NOT NULL)) OR (email_opened_at IS NOT NULL AND NOT (email_bounced_at IS NOT NULL)) AS ready FROM campaign_leads""", ("campaign_leads",))
def _(v):
    return v.campaign_leads.withColumn("states", C.channel_states()).select("lead_id", C.step_condition(STEP_TEXT).alias("ready"))


ROW_TEXT = "qualification_score >= 50 AND email exists OR tags contains MACHINERY AND source != 'BUILDING' AND headline contains 'vp'"


@query("row_condition", """SELECT lead_id FROM campaign_leads WHERE (coalesce(qualification_score >= 50, false) AND email IS NOT NULL)
    OR (list_contains(tags, 'MACHINERY') AND coalesce(source <> 'BUILDING', true) AND coalesce(contains(lower(headline), 'vp'), false))""", ("campaign_leads",))
def _(v):
    return C.where_condition(v.campaign_leads, ROW_TEXT).select("lead_id")


SIZE_SQL = "CASE WHEN {e} BETWEEN 100 AND 250 THEN 15 WHEN {e} BETWEEN 251 AND 500 THEN 25 WHEN {e} BETWEEN 501 AND 1000 THEN 20 WHEN {e} BETWEEN 1001 AND 5000 THEN 10 ELSE 0 END"
FUND = ["Series A", "Series B", "Series C", "Growth", "PE-backed", "Public", "Seed"]
SCORED_SQL = f"""scored AS (SELECT contact_id, CASE WHEN regexp_matches(lower(coalesce(headline, '')), '\\b(ceo|cto|cpo|coo|cfo|cmo|cdo|chief)\\b') THEN 30
      WHEN regexp_matches(lower(coalesce(headline, '')), '\\b(vp|vice president)\\b') THEN 25 WHEN contains(lower(coalesce(headline, '')), 'head of') THEN 20
      WHEN contains(lower(coalesce(headline, '')), 'director') THEN 15 WHEN contains(lower(coalesce(headline, '')), 'manager') THEN 5 ELSE 0 END
    + {SIZE_SQL.format(e='(contact_id * 37 % 6000)')}
    + CASE contact_id % 7 WHEN 0 THEN 15 WHEN 1 THEN 25 WHEN 2 THEN 20 WHEN 3 THEN 20 WHEN 4 THEN 15 WHEN 5 THEN 10 ELSE 0 END + least(contact_id % 8 * 5, 25) AS icp_score FROM contacts)"""


def scored_contacts(v):
    funding = F.element_at(F.array(*[F.lit(x) for x in FUND]), (F.col("contact_id") % 7 + 1).cast("int"))
    return v.contacts.withColumn("icp_score", G.icp_score(F.col("headline"), F.col("contact_id") * 37 % 6000, funding, F.col("contact_id") % 8))


@query("icp_score", f"""WITH {SCORED_SQL} SELECT contact_id, icp_score, CASE WHEN icp_score >= 85 THEN 'Very Strong' WHEN icp_score >= 70 THEN 'Strong' WHEN icp_score >= 50 THEN 'Moderate' ELSE 'Reject' END AS band,
    CASE WHEN icp_score >= 80 THEN 'high' WHEN icp_score >= 50 THEN 'medium' ELSE 'low' END AS provider_band,
    CASE WHEN icp_score >= 80 THEN 'hot' WHEN icp_score >= 50 THEN 'warm' WHEN icp_score >= 20 THEN 'monitor' ELSE 'disqualified' END AS temperature FROM scored""", ("contacts",))
def _(v):
    s = F.col("icp_score")
    return scored_contacts(v).select(
        "contact_id", "icp_score", SG.score_band(s).alias("band"), SG.provider_band(s).alias("provider_band"), SG.temperature_band(s).alias("temperature")
    )


@query("review_from_score", f"""WITH {SCORED_SQL} SELECT contact_id, CASE WHEN icp_score >= 95 THEN 'high' ELSE 'normal' END AS priority, icp_score > 85 AS hold,
    coalesce(headline, '') || ' @ ' || coalesce(company, 'Unknown') || ' — Score: ' || icp_score AS description, trim(first_name || ' ' || last_name) AS title,
    coalesce(nullif(linkedin_url, ''), first_name || ' ' || last_name) AS source_id FROM scored JOIN contacts USING (contact_id)""", ("contacts",))
def _(v):
    return FL.to_review(scored_contacts(v), F.col("icp_score")).select("contact_id", "priority", "hold", "description", "title", "source_id")


@query("personal_domain", f"SELECT doc_id, regexp_extract(text, '[a-z0-9._]+@([a-z0-9.-]+)', 1) AS domain, regexp_extract(text, '[a-z0-9._]+@([a-z0-9.-]+)', 1) IN ({', '.join(S.quoted(d) for d in N.PERSONAL_DOMAINS)}) AS personal FROM documents")
def _(v):
    domain = F.regexp_extract("text", r"[a-z0-9._]+@([a-z0-9.-]+)", 1)
    return v.documents.select("doc_id", domain.alias("domain"), N.is_personal_domain(domain).alias("personal"))


@query("activity_id", "SELECT event_id, CAST(CASE WHEN event_id % 3 = 2 THEN 'urn:li:ugcPost:' || (event_id * 11) ELSE CAST(event_id * 7 AS VARCHAR) END AS VARCHAR) AS post FROM events")
def _(v):
    url = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://www.linkedin.com/posts/x-activity-"), F.col("event_id") * 7, F.lit("-ab")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("linkedin.com/feed/update/urn:li:activity:"), F.col("event_id") * 7))
        .otherwise(F.concat(F.lit("linkedin.com/feed/update/urn:li:ugcPost:"), F.col("event_id") * 11, F.lit("/")))
    )
    return v.events.select("event_id", N.activity_id(url).alias("post"))


@query("watch_cost", """WITH w AS (SELECT entity_id, list_distinct(list(signal_type)) AS types FROM observations GROUP BY entity_id),
    c AS (SELECT entity_id, 3 * CAST(list_contains(types, 'job-change') AS INT) + CAST(list_contains(types, 'hiring-surge') AS INT) + CAST(list_contains(types, 'funding') AS INT) AS daily FROM w)
    SELECT entity_id, daily, false AS over_budget FROM c UNION ALL SELECT -1, sum(daily), sum(daily) > 50 FROM c""", ("observations",))
def _(v):
    watches = v.observations.groupBy("entity_id").agg(F.collect_set("signal_type").alias("signal_types"))
    per = watches.select("entity_id", G.watch_cost(F.col("signal_types")).alias("daily"))
    total = per.agg(F.sum("daily").alias("daily")).select(F.lit(-1).cast("bigint").alias("entity_id"), "daily", (F.col("daily") > 50).alias("over_budget"))
    return per.select("entity_id", F.col("daily").cast("bigint").alias("daily"), F.lit(False).alias("over_budget")).unionByName(total)


@query("answer_confidence", f"""WITH e AS (SELECT p_partkey AS insight_id, p_size * 3 AS raw, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_discount > 0.09 GROUP BY 1, 2),
    c AS (SELECT *, CASE WHEN n = 0 THEN least(least(greatest(raw, 0), 100), 20) WHEN n = 1 THEN least(least(raw, 100), 60) ELSE least(raw, 100) END AS conf FROM e)
    SELECT insight_id, CAST(conf AS DOUBLE) AS confidence, CASE WHEN conf >= 70 THEN 'validated' ELSE 'hypothesis' END AS level, strftime({S.NOW} + INTERVAL 90 DAY, '%Y-%m-%d') AS expires_on FROM c""")
def _(v):
    strong = v.lineitem.filter("l_discount > 0.09").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    e = v.part.select("p_partkey", "p_size").join(strong, "p_partkey", "left").fillna(0, ["n"])
    conf = G.capped_answer_confidence(F.col("p_size") * 3, F.col("n"))
    return e.select(
        F.col("p_partkey").alias("insight_id"), conf.alias("confidence"), F.when(conf >= 70, "validated").otherwise("hypothesis").alias("level"),
        F.date_format(F.timestamp_add("DAY", F.lit(90), now()), "yyyy-MM-dd").alias("expires_on"),
    )


@query("map_fields", """SELECT l_orderkey AS order_ref, l_linenumber, l_quantity AS quantity, 'fixed' AS channel, l_returnflag, {'a': l_shipdate IS NULL}.a AS no_date FROM lineitem""")
def _(v):
    nested = v.lineitem.withColumn("info", F.struct(F.col("l_orderkey").alias("key"), F.struct(F.col("l_shipdate").isNull().alias("missing")).alias("date")))
    return FL.map_fields(
        nested, explicit={"info.key": "order_ref", "info.date.missing": "no_date", "l_quantity": "quantity", "not.there": "gone"},
        target=["l_linenumber", "l_returnflag", "channel", "absent"], literals={"channel": "fixed"},
    )


RULES = ["ceo", "vp", "head of", "product"]
TERMS = ["initech", "gauss", "recruit"]
BAD_COMPANIES = ["umbrella", "furniture"]


@query("gate_headline", "SELECT contact_id FROM contacts WHERE regexp_matches(coalesce(headline, ''), '(?i)ceo|vp|head of|product')", ("contacts",))
def _(v):
    return FL.gate_headline(v.contacts, RULES).select("contact_id")


@query("gate_exclusion", "SELECT contact_id FROM contacts WHERE NOT regexp_matches(lower(concat_ws(' ', first_name, last_name, headline, company, linkedin_url)), 'initech|gauss|recruit')", ("contacts",))
def _(v):
    return FL.gate_exclusion(v.contacts, TERMS).select("contact_id")


@query("gate_company", "SELECT contact_id FROM contacts WHERE NOT (contains(lower(coalesce(company, '')), 'umbrella') OR contains(lower(coalesce(industry, '')), 'umbrella') OR contains(lower(coalesce(company, '')), 'furniture') OR contains(lower(coalesce(industry, '')), 'furniture'))", ("contacts",))
def _(v):
    return FL.gate_company(v.contacts, BAD_COMPANIES).select("contact_id")


# lists as tables: full names of the blocklist, companies with many suppressed people, companies and mail domains of the suppression list
@query("gate_exclusion_table", """WITH x AS (SELECT DISTINCT lower(name) AS term FROM blocklist WHERE name IS NOT NULL), t AS (SELECT contact_id, lower(concat_ws(' ', first_name, last_name, headline, company, linkedin_url)) AS body FROM contacts)
    SELECT contact_id FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE contains(t.body, x.term))""", ("contacts", "blocklist"))
def _(v):
    return FL.gate_exclusion(v.contacts, v.blocklist.select(F.col("name").alias("term"))).select("contact_id")


@query("gate_company_table", """WITH n AS (SELECT company, count(*) AS n FROM suppression WHERE company IS NOT NULL GROUP BY 1), x AS (SELECT DISTINCT lower(company) AS term FROM n WHERE n > (SELECT avg(n) FROM n))
    SELECT contact_id FROM contacts c WHERE NOT EXISTS (SELECT 1 FROM x WHERE contains(lower(coalesce(c.company, '')), x.term) OR contains(lower(coalesce(c.industry, '')), x.term))""", ("contacts", "suppression"))
def _(v):
    known = v.suppression.filter("company IS NOT NULL").groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    many = known.filter(F.col("n") > known.agg(F.avg("n")).scalar())
    return FL.gate_company(v.contacts, many.select(F.col("company").alias("term"))).select("contact_id")


@query("gate_score", f"WITH {SCORED_SQL} SELECT contact_id, icp_score FROM scored WHERE coalesce(icp_score, 0) >= 50", ("contacts",))
def _(v):
    return FL.gate_score(scored_contacts(v), 50).select("contact_id", "icp_score")


@query("filter_leads", "SELECT contact_id FROM contacts WHERE contains(lower(coalesce(headline, '')), 'vp') AND contains(lower(coalesce(company, '')), 'inc')", ("contacts",))
def _(v):
    return FL.filter_leads(v.contacts, {"headline": "VP", "company": "inc"}).select("contact_id")


@query("query_insights", """SELECT insight_id, confidence, confidence_score FROM insights WHERE category = 'ECONOMY' AND confidence IN ('validated', 'proven') AND tenant_id = 't1'""", ("insights",))
def _(v):
    return FL.query_insights(v.insights, tenant="t1", category="ECONOMY", minimum="validated").select("insight_id", "confidence", "confidence_score")


@query("comment_targets", """SELECT doc_id FROM (SELECT doc_id, text, source, doc_id % 10 AS replies, CASE WHEN doc_id % 37 = 0 THEN '' ELSE 'x' END AS cid FROM documents) c
    WHERE source <> 'src1' AND replies = 0 AND NOT contains(lower(source), 'src2') AND (contains(lower(text), 'the') OR contains(lower(text), 'und')) AND cid <> ''""")
def _(v):
    comments = v.documents.select(
        F.col("doc_id"), F.when(F.col("doc_id") % 37 == 0, "").otherwise("x").alias("comment_id"), F.col("source").alias("author_id"), F.col("source").alias("author_name"),
        (F.col("doc_id") % 10).alias("reply_count"), "text",
    )
    return FL.reply_targets(comments, own_author="src1", exclude=["SRC2"], include=["The", "und"]).select("doc_id")


@query("expire_reviews", """SELECT review_id, CASE WHEN status = 'pending' AND expires_at < TIMESTAMP '1998-01-01' THEN 'expired' ELSE status END AS status FROM reviews""", ("reviews",))
def _(v):
    return FL.expire_reviews(v.reviews, F.lit("1998-01-01 00:00:00").cast("timestamp")).select("review_id", "status")


CACHE_SQL = """cache AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
    ['company_page', 'blog_post', 'job_posting', 'press_release', 'social_profile', 'search_result'][page_id % 6 + 1] AS content_type, TIMESTAMP '2024-12-24 00:00:00' + to_hours(page_id * 5 % 240) AS fetched_at, page_id % 41 = 0 AS gated FROM pages)"""


@query("fresh_cache", f"""WITH {CACHE_SQL} SELECT page_id FROM cache WHERE NOT gated AND {S.NOW} - fetched_at < CASE content_type WHEN 'blog_post' THEN INTERVAL 24 HOUR WHEN 'press_release' THEN INTERVAL 24 HOUR
    WHEN 'search_result' THEN INTERVAL 24 HOUR WHEN 'job_posting' THEN INTERVAL 72 HOUR ELSE INTERVAL 168 HOUR END AND host NOT IN (SELECT host FROM cache WHERE gated)""")
def _(v):
    kinds = F.array(*[F.lit(k) for k in ("company_page", "blog_post", "job_posting", "press_release", "social_profile", "search_result")])
    cache = v.pages.select(
        "page_id", "url", F.when(F.col("page_id") % 41 == 0, "gated").otherwise(F.element_at(kinds, (F.col("page_id") % 6 + 1).cast("int"))).alias("content_type"),
        F.timestamp_add("HOUR", (F.col("page_id") * 5 % 240).cast("int"), F.lit("2024-12-24 00:00:00").cast("timestamp")).alias("fetched_at"),
    )
    return FL.fresh_cache(cache, now()).select("page_id")


@query("email_eligible", "SELECT lead_id FROM campaign_leads WHERE email IS NOT NULL AND email <> '' AND coalesce(email_status, 'valid') IN ('valid', 'unverified') AND email_campaign_id IS NULL", ("campaign_leads",))
def _(v):
    return FL.email_eligible(v.campaign_leads).select("lead_id")


@query("expire_leads", """SELECT lead_id, CASE WHEN lifecycle_status = 'Connect_Sent' AND epoch_us(TIMESTAMP '1998-06-01') - epoch_us(connect_sent_at) >= 30 * 86400000000 THEN 'Expired'
    WHEN lifecycle_status = 'DM2_Sent' AND epoch_us(TIMESTAMP '1998-06-01') - epoch_us(dm2_sent_at) >= 14 * 86400000000 THEN 'No_Reply' ELSE lifecycle_status END AS lifecycle_status FROM campaign_leads""", ("campaign_leads",))
def _(v):
    return FL.expire_leads(v.campaign_leads, F.lit("1998-06-01 00:00:00").cast("timestamp")).select("lead_id", "lifecycle_status")


COMPETITORS = ["Scaled Agile", "Agile Alliance", "Scrum.org", "Agile Centre"]
COMPETITOR_DOMAINS = ["agilecoach", "scrummaster", "agile-consulting", "agilecentre"]


@query("gate_rules", rf"""WITH t AS (SELECT contact_id, coalesce(headline, '') AS h, lower(coalesce(company, '')) AS c, {S.email_domain('trim(email)')} AS d, contact_id * 37 % 12000 AS size, contact_id % 5 = 0 AS funded FROM contacts)
    SELECT contact_id, CASE WHEN NOT regexp_matches(h, '(?i)\b(cto|chief technology officer|vp( of)? engineering|head of engineering|director of engineering|cpo|chief product officer|vp product|head of product|coo|chief operating officer|chief digital officer|cdo|head of digital transformation|head of delivery|vp delivery|technical programme manager|ceo)\b') THEN 'title'
      WHEN regexp_matches(h, '(?i)\b(intern|junior|associate|coordinator|sales|marketing|finance|legal|hr|recruiter|consultant|student|graduate)\b') THEN 'auto_fail_title'
      WHEN (size < 100 AND NOT funded) OR size > 10000 THEN 'company_size' WHEN regexp_matches(c, 'scaled agile|agile alliance|scrum.org|agile centre|stark') THEN 'competitor'
      WHEN d = 'd7.com' THEN 'blocked_domain' WHEN d IN ('gmail.com') THEN 'personal_email' END AS failed FROM t""", ("contacts",))
def _(v):
    leads = v.contacts.withColumn("employees", F.col("contact_id") * 37 % 12000).withColumn("has_funding_signal", F.col("contact_id") % 5 == 0)
    return FL.gate_rules(leads, FL.GateRules(extra_titles=["ceo"], competitors=[*COMPETITORS, "Stark"], competitor_domains=COMPETITOR_DOMAINS, blocked_domains=["d7.com"])).select("contact_id", F.col("failed_rule").alias("failed"))


@query("gate_rules_table", rf"""WITH x AS (SELECT DISTINCT lower(company) AS term FROM suppression WHERE company IS NOT NULL), b AS (SELECT DISTINCT {S.email_domain('trim(email)')} AS d FROM suppression WHERE email IS NOT NULL),
    t AS (SELECT contact_id, coalesce(headline, '') AS h, lower(coalesce(company, '')) AS c, {S.email_domain('trim(email)')} AS d, contact_id * 37 % 12000 AS size, contact_id % 5 = 0 AS funded FROM contacts)
    SELECT contact_id, CASE WHEN NOT regexp_matches(h, '(?i)\b(product manager|vp engineering)\b') THEN 'title' WHEN regexp_matches(h, '(?i)\b(intern|junior|associate|coordinator|sales|marketing|finance|legal|hr|recruiter|consultant|student|graduate)\b') THEN 'auto_fail_title'
      WHEN (size < 100 AND NOT funded) OR size > 10000 THEN 'company_size' WHEN EXISTS (SELECT 1 FROM x WHERE contains(t.c, x.term)) THEN 'competitor' WHEN d IN (SELECT d FROM b) THEN 'blocked_domain' WHEN d IN ('gmail.com') THEN 'personal_email' END AS failed FROM t""", ("contacts", "suppression"))
def _(v):
    from leadspan.functions.normalize import email_domain

    leads = v.contacts.withColumn("employees", F.col("contact_id") * 37 % 12000).withColumn("has_funding_signal", F.col("contact_id") % 5 == 0)
    domains = v.suppression.filter("email IS NOT NULL").select(email_domain(F.trim(F.col("email"))).alias("term"))
    rules = FL.GateRules(pass_titles=["Product Manager", "VP Engineering"], competitors=v.suppression.select(F.col("company").alias("term")), blocked_domains=domains)
    return FL.gate_rules(leads, rules).select("contact_id", F.col("failed_rule").alias("failed"))


@query("gate_cooldown", """WITH hist AS (SELECT provider_id, lifecycle_status, connect_sent_at AS touched, CASE WHEN lead_id % 3 = 0 THEN replied_at END AS negative_at, CASE WHEN lead_id % 50 = 0 THEN TIMESTAMP '1998-01-01' END AS snoozed_until FROM campaign_leads),
    k AS (SELECT provider_id, max(CASE WHEN lifecycle_status <> 'Expired' THEN touched END) AS t, max(negative_at) AS n, max(snoozed_until) AS s FROM hist GROUP BY 1)
    SELECT c.contact_id FROM contacts c LEFT JOIN k ON k.provider_id = c.provider_id
    WHERE NOT coalesce(k.s >= TIMESTAMP '1999-01-01', false) AND NOT coalesce(k.t > TIMESTAMP '1999-01-01' - INTERVAL 90 DAY, false) AND NOT coalesce(k.n > TIMESTAMP '1999-01-01' - INTERVAL 180 DAY, false)""", ("contacts", "campaign_leads"))
def _(v):
    history = v.campaign_leads.select(
        "provider_id", (F.col("lifecycle_status") == "Expired").alias("dropped"), F.col("connect_sent_at").alias("contacted_at"),
        F.when(F.col("lead_id") % 3 == 0, F.col("replied_at")).alias("negative_reply_at"), F.when(F.col("lead_id") % 50 == 0, F.lit("1998-01-01").cast("timestamp")).alias("snoozed_until"),
    )
    return FL.gate_cooldown(v.contacts, history, "provider_id", F.lit("1999-01-01").cast("timestamp")).select("contact_id")


@query("signal_score", """WITH f AS (SELECT page_id, regexp_matches(lower(html), 'scrum master|safe|kanban') AS a, regexp_matches(lower(html), 'sprint|waterfall') AS b,
      contains(lower(html), 'merger') OR contains(lower(html), 'reorg') AS c FROM pages)
    SELECT page_id, a AS hiring, b AS activity, c AS events FROM f""")
def _(v):
    flags = G.signal_flags(F.col("html"), {"a": (4, ["Scrum Master", "SAFe", "Kanban"]), "b": (5, ["sprint", "waterfall"]), "c": (4, ["merger", "reorg"])})
    return v.pages.select("page_id", flags["a"].alias("hiring"), flags["b"].alias("activity"), flags["c"].alias("events"))


def _signal_sql() -> str:
    flag = {n: " OR ".join(f"contains(low, {S.quoted(t.lower())})" for t in terms) for n, (_, terms) in G.SIGNAL_CATEGORIES.items()}
    score = " + ".join(f"CASE WHEN {f} THEN {G.SIGNAL_CATEGORIES[n][0]} ELSE 0 END" for n, f in flag.items())
    need = " OR ".join(flag[n] for n in G.REQUIRED_SIGNALS)
    return f"""WITH base AS (SELECT doc_id, lower(text || ' ' || ['we hire an Agile Coach', 'sprint planning and Jira', 'Series B and new CTO, Confluence', 'IPO preparation', ''][doc_id % 5 + 1] || ['', ' missed deadline'][doc_id % 2 + 1]) AS low FROM documents)
      SELECT doc_id, {score} AS signal_score, ({score}) >= 6 AND ({need}) AS qualifies, ({score}) >= 12 AND ({need}) AS strong_fit FROM base"""


@query("signal_scoring", _signal_sql())
def _(v):
    posts = F.array(*[F.lit(x) for x in ("we hire an Agile Coach", "sprint planning and Jira", "Series B and new CTO, Confluence", "IPO preparation", "")])
    body = F.concat("text", F.lit(" "), F.element_at(posts, (F.col("doc_id") % 5 + 1).cast("int")), F.when(F.col("doc_id") % 2 == 1, " missed deadline").otherwise(""))
    return v.documents.select("doc_id", *[c.alias(n) for n, c in G.signal_score(G.signal_flags(body)).items()])
