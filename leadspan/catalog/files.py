"""Queries for sources and exports that work on tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspan.catalog.registry import query
from leadspan.functions.normalize import text
from leadspan.session import ensure_checkpoint_dir
from leadspan.sinks import exports as X
from leadspan.sources import feeds as FD
from leadspan.sources import files as SF
from leadspan.sources import people as PP

MAPPING = {"c_custkey": "contact_id", "c_name": "name", "c_mktsegment": "industry", "missing": "title"}


@query("import_contacts", "SELECT c_custkey AS contact_id, c_name AS name, c_mktsegment AS industry, 'crm:hub' AS source FROM customer")
def _(v):
    return SF.import_contacts(v.customer, MAPPING, "hub")


@query("crm_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 100 AND c_acctbal < 9000 AND c_name LIKE '%1%' AND c_nationkey <> 3 AND c_nationkey NOT IN (4, 5)")
def _(v):
    names = {"industry": "c_mktsegment", "balance": "c_acctbal", "name": "c_name", "country": "c_nationkey"}
    filters = [("industry", "in", ["BUILDING", "MACHINERY"]), ("balance", "gte", 100), ("balance", "lt", 9000), ("name", "contains", "1"), ("country", "neq", 3), ("country", "not_in", [4, 5])]
    return SF.crm_filter(v.customer, filters, names).select("c_custkey")


def _properties(v):
    k = F.col("c_custkey")
    word = lambda c: F.concat(F.lit('[{"plain_text":"'), c, F.lit('"},{"plain_text":"!"}]'))
    body = F.concat(
        F.lit('{"Name":{"type":"title","title":'), word(F.col("c_name")), F.lit('},"Segment":{"type":"select","select":{"name":"'), "c_mktsegment", F.lit('"}},"Score":{"type":"number","number":'), (k % 100).cast("string"),
        F.lit('},"Tags":{"type":"multi_select","multi_select":[{"name":"a"},{"name":"b'), (k % 3).cast("string"), F.lit('"}]},"Open":{"type":"checkbox","checkbox":true},"Due":{"type":"date","date":'),
        F.when(k % 2 == 0, "null").otherwise('{"start":"2024-01-02"}'), F.lit('},"Odd":{"type":"formula"}}'),
    )
    return v.customer.select(k.alias("page_id"), body.alias("properties"))


@query("flatten_properties", """SELECT c_custkey AS page_id, 'Name' AS name, c_name || '!' AS value, NULL AS vals FROM customer UNION ALL SELECT c_custkey, 'Segment', c_mktsegment, NULL FROM customer UNION ALL SELECT c_custkey, 'Score', CAST(CAST(c_custkey % 100 AS DOUBLE) AS VARCHAR), NULL FROM customer
    UNION ALL SELECT c_custkey, 'Tags', NULL, 'a|b' || (c_custkey % 3) FROM customer UNION ALL SELECT c_custkey, 'Open', 'true', NULL FROM customer UNION ALL SELECT c_custkey, 'Due', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '2024-01-02' END, NULL FROM customer UNION ALL SELECT c_custkey, 'Odd', '', NULL FROM customer""")
def _(v):
    return SF.flatten_properties(_properties(v), "page_id").select("page_id", "name", "value", F.array_join("values", "|").alias("vals"))


@query("explode_payload", """WITH c AS (SELECT c_custkey AS k, c_name AS n FROM customer) SELECT k AS tool_id, 0 AS position, '{"id":' || k || '}' AS item FROM c WHERE k % 4 = 0 UNION ALL SELECT k, 1, '{"id":"' || n || '"}' FROM c WHERE k % 4 = 0
    UNION ALL SELECT k, 0, '{"z":' || k || '}' FROM c WHERE k % 4 = 1 UNION ALL SELECT k, 0, '{"total":' || k || '}' FROM c WHERE k % 4 = 2 UNION ALL SELECT k, 0, 'plain ' || n FROM c WHERE k % 4 = 3""")
def _(v):
    k, n = F.col("c_custkey"), F.col("c_name")
    payload = (
        F.when(k % 4 == 0, F.concat(F.lit('[{"id":'), k, F.lit('},{"id":"'), n, F.lit('"}]'))).when(k % 4 == 1, F.concat(F.lit('{"note":"[x]","rows":[{"z":'), k, F.lit('}],"extra":[1]}')))
        .when(k % 4 == 2, F.concat(F.lit('{"total":'), k, F.lit("}"))).otherwise(F.concat(F.lit("plain "), n))
    )
    out = SF.explode_payload(v.customer.select(k.alias("tool_id"), payload.alias("payload")), "tool_id", "payload")
    return out.select("tool_id", "position", F.coalesce("text", F.to_json("row")).alias("item"))


@query("review_items", """SELECT CASE WHEN name IS NULL THEN 'Untitled' ELSE name END AS title, concat_ws(' — ', nullif(headline, ''), nullif(company, '')) AS description, CASE WHEN s >= 95 THEN 'high' WHEN s >= 80 THEN 'normal' ELSE 'low' END AS priority, CAST(contact_id AS VARCHAR) AS source_id
    FROM (SELECT contact_id, CASE WHEN contact_id % 10 = 0 THEN NULL ELSE first_name END AS name, headline, company, CASE WHEN contact_id % 7 = 0 THEN 50 ELSE contact_id % 101 END AS s FROM contacts) x""", ("contacts",))
def _(v):
    k = F.col("contact_id")
    rows = v.contacts.select(k.alias("id"), F.when(k % 10 != 0, F.col("first_name")).alias("name"), "headline", "company", F.when(k % 7 != 0, k % 101).alias("score"))
    return SF.review_items(rows).select("title", "description", "priority", "source_id")


@query("normalize_engagers", """SELECT event_id AS event_no, 'U' || user_id AS first_name, 'van Dam' AS last_name, 'slug' || user_id AS linkedin_slug, 'p' || user_id AS provider_id, CASE WHEN event_type = 'click' THEN 'Commented' ELSE 'Reacted' END AS engagement_type, CASE WHEN event_type = 'click' THEN NULL WHEN event_id % 2 = 0 THEN 'LIKE' ELSE 'PRAISE' END AS reaction_type FROM events""")
def _(v):
    u = F.col("user_id")
    person = F.struct(
        F.concat(F.lit("p"), u).alias("id"), F.concat(F.lit("U"), u, F.lit("  van \U0001f680Dam ")).alias("name"), F.lit("Boss").alias("headline"),
        F.concat(F.lit("https://www.linkedin.com/in/slug"), u, F.lit("/")).alias("profile_url"), F.lit("DISTANCE_2").alias("network_distance"),
    )
    e = v.events.withColumnRenamed("event_id", "event_no")
    reactions = e.filter("event_type <> 'click'").select("event_no", F.when(F.col("event_no") % 2 != 0, "PRAISE").alias("value"), person.alias("author"))
    comments = e.filter("event_type = 'click'").select("event_no", F.lit("nice").alias("text"), person["name"].alias("author"), person.alias("author_details"))
    return PP.normalize_engagers(reactions, comments).select("event_no", "first_name", "last_name", "linkedin_slug", "provider_id", "engagement_type", "reaction_type")


@query("normalize_contacts", """SELECT c_custkey AS rr_id, CASE c_custkey % 4 WHEN 0 THEN 'w@x.com' WHEN 1 THEN 'v@x.com' WHEN 2 THEN 'f@x.com' END AS email, CASE c_custkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'valid' WHEN 2 THEN 'invalid' END AS email_status, CASE WHEN c_custkey % 3 = 0 THEN '+2' WHEN c_custkey % 3 = 1 THEN '1' END AS phone FROM customer""")
def _(v):
    k = F.col("c_custkey")
    mail = lambda a, s, t: F.struct(F.lit(a).alias("email"), F.lit(s).alias("smtp_valid"), F.lit(t).alias("type"))
    first, valid, work = mail("f@x.com", "invalid", "personal"), mail("v@x.com", "valid", "personal"), mail("w@x.com", "valid", "professional")
    emails = F.when(k % 4 == 0, F.array(first, valid, work)).when(k % 4 == 1, F.array(first, valid)).when(k % 4 == 2, F.array(first)).otherwise(F.slice(F.array(first), 1, 0))
    none = F.lit(None).cast("string")
    phone = lambda e, n, r: F.struct(e.alias("e164"), n.alias("number"), F.lit(r).alias("recommended"))
    one, two = phone(none, F.lit("1"), False), phone(F.lit("+2"), none, True)
    phones = F.when(k % 3 == 0, F.array(one, two)).when(k % 3 == 1, F.array(one)).otherwise(F.slice(F.array(one), 1, 0))
    rows = v.customer.select(k.alias("rr_id"), F.col("c_name").alias("name"), F.lit("").alias("linkedin_url"), emails.alias("emails"), phones.alias("phones"))
    return PP.normalize_contacts(rows).select("rr_id", "email", "email_status", "phone")


@query("parse_feeds", """SELECT source_key, CASE WHEN item_no % 3 = 2 THEN 'Atom ' ELSE '' END || title AS title, 'https://s.com/' || item_no AS link, CASE item_no % 3 WHEN 0 THEN 'g' || item_no ELSE 'https://s.com/' || item_no END AS guid,
    CASE WHEN item_no % 7 <> 0 THEN strftime(date_trunc('second', published_at), '%Y-%m-%d %H:%M:%S') END AS published FROM feed_items WHERE item_no % 10 <> 9""", ("feed_items",))
def _(v):
    k = F.col("item_no")
    link = F.concat(F.lit("https://s.com/"), k)
    when = F.when(k % 7 == 0, F.lit("soon")).otherwise(text(F.date_format("published_at", "d MMM yyyy HH:mm:ss")))
    rss = F.concat(
        F.lit('<?xml version="1.0"?>\n<rss version="2.0"><channel><title>T</title><item><title> '), "title", F.lit(" </title><link>"), link, F.lit("</link>"),
        F.when(k % 3 == 0, F.concat(F.lit('<guid isPermaLink="false">g'), k, F.lit("</guid>"))).otherwise(""), F.lit("<pubDate>Thu, "), when, F.lit(" GMT</pubDate><description>D</description></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title type="text">Atom '), "title", F.lit('</title><link rel="self" href="https://no"/><link href="'), link, F.lit('"/><updated>'),
        F.when(k % 7 == 0, F.lit("soon")).otherwise(text(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))), F.lit("</updated></entry></feed>"),
    )
    raw = v.feed_items.select("source_key", F.when(k % 10 == 9, F.lit("<rss><broken")).when(k % 3 == 2, atom).otherwise(rss).alias("xml"))
    return FD.parse_feeds(raw).select("source_key", "title", "link", "guid", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("sequencer_layout", "SELECT first_name, last_name, coalesce(email, '') AS email, coalesce(company, '') AS organization_name, coalesce(headline, '') AS title, coalesce(linkedin_url, '') AS linkedin_url FROM contacts", ("contacts",))
def _(v):
    return X.to_sequencer(v.contacts, "apollo")


@query("campaign_leads_export", """SELECT concat_ws(' ', l.first_name, l.last_name) AS "Name", coalesce(l.company, '') AS "Company", coalesce(l.headline, '') AS "Headline", coalesce(l.linkedin_url, '') AS "LinkedIn URL", coalesce(v.name, '') AS "Variant", l.lifecycle_status AS "Lifecycle Status", coalesce(CAST(l.qualification_score AS VARCHAR), '') AS "Score",
    coalesce(strftime(connect_sent_at, '%Y-%m-%d %H:%M:%S'), '') AS "Connect Sent", coalesce(strftime(connected_at, '%Y-%m-%d %H:%M:%S'), '') AS "Connected", coalesce(strftime(dm1_sent_at, '%Y-%m-%d %H:%M:%S'), '') AS "DM1 Sent", coalesce(strftime(dm2_sent_at, '%Y-%m-%d %H:%M:%S'), '') AS "DM2 Sent", coalesce(strftime(replied_at, '%Y-%m-%d %H:%M:%S'), '') AS "Replied"
    FROM campaign_leads l LEFT JOIN campaign_variants v ON v.variant_id = l.variant_id""", ("campaign_leads", "campaign_variants"))
def _(v):
    return X.campaign_leads_export(v.campaign_leads, v.campaign_variants)


@query("to_crm", "SELECT contact_id AS vid, email AS email_address, company AS company_name FROM contacts", ("contacts",))
def _(v):
    return X.to_crm(v.contacts, {"contact_id": "vid", "email": "email_address", "company": "company_name", "nothing": "x"})


@query("result_set_rows", """SELECT 'set1' AS result_set_id, row_number() OVER (ORDER BY p_partkey) - 1 AS row_index, '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '"}' AS data FROM part""")
def _(v):
    return X.result_rows(v.part.select("p_partkey", "p_brand"), "set1", ["p_partkey"])


RECORDS = 10_000  # of one file, a few MB: a file is read by one task, and each costs a task and a commit


def _folder(v, name: str) -> str:
    return f"{ensure_checkpoint_dir(v.contacts.sparkSession)}/{name}-{uuid.uuid4().hex}"


LEAD_FIELDS = ["contact_id", "first_name", "last_name", "email", "linkedin_url", "company", "headline", "nothing"]


@query("csv_leads", "SELECT CAST(contact_id AS VARCHAR) AS contact_id, first_name, last_name, trim(coalesce(email, '')) AS email, coalesce(linkedin_url, '') AS linkedin_url, company, coalesce(headline, '') AS headline, '' AS nothing FROM contacts", ("contacts",))
def _(v):
    """Written as a file of leads and imported again."""
    folder = _folder(v, "csv")
    X.export_csv(v.contacts, folder, LEAD_FIELDS)
    return SF.read_csv_leads(v.contacts.sparkSession, folder)


@query("csv_suppression", """SELECT trim(email) AS email, linkedin_url, trim(concat_ws(' ', first_name, last_name)) AS name, company, 'permanent' AS scope, 'Imported from crm' AS reason, coalesce(trim(email), linkedin_url) AS provider_id
    FROM contacts WHERE email IS NOT NULL OR linkedin_url IS NOT NULL""", ("contacts",))
def _(v):
    folder = _folder(v, "suppression")
    X.export_csv(v.contacts.select(F.col("email").alias("Email"), F.col("linkedin_url").alias("LinkedIn"), "first_name", "last_name", "company"), folder)
    return SF.load_suppression_csv(v.contacts.sparkSession, folder, "crm")


@query("json_leads", "SELECT contact_id, first_name, email, company, acctbal FROM contacts", ("contacts",))
def _(v):
    folder = _folder(v, "json")
    fields = ["contact_id", "first_name", "email", "company", "acctbal"]
    X.export_json(v.contacts.select(*fields), folder)
    return v.contacts.sparkSession.read.schema(v.contacts.select(*fields).schema).json(folder)


def _record_files(v, key: str, people: DataFrame) -> str:
    """Files with one object each, which holds the records of ``RECORDS`` numbers in a row under ``key``."""
    folder = _folder(v, key)
    record = F.struct(*[c for c in people.columns if c != "no"])
    arrays = people.groupBy(F.floor(F.col("no") / RECORDS).alias("_file")).agg(F.to_json(F.struct(F.collect_list(record).alias(key))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return folder


@query("visitor_files", "SELECT first_name, last_name, coalesce(headline, '') AS headline, company, coalesce(linkedin_url, '') AS linkedin_url, provider_id, 'profile_visitor' AS source FROM contacts", ("contacts",))
def _(v):
    people = v.contacts.select(F.col("contact_id").alias("no"), F.col("first_name").alias("firstName"), "last_name", F.col("headline").alias("title"), F.col("company").alias("company_name"), F.col("linkedin_url").alias("profileUrl"), F.col("provider_id").alias("providerId"))
    return SF.read_visitors(v.contacts.sparkSession, _record_files(v, "visitors", people))


@query("engager_files", "SELECT first_name, '' AS last_name, CASE WHEN contact_id % 2 = 0 THEN 'Boss' ELSE coalesce(headline, '') END AS headline, '' AS company, coalesce(linkedin_url, '') AS linkedin_url, provider_id, 'content_engager' AS source FROM contacts", ("contacts",))
def _(v):
    boss = F.when(F.col("contact_id") % 2 == 0, F.lit("Boss"))
    people = v.contacts.select(F.col("contact_id").alias("no"), "first_name", boss.alias("headline"), F.col("headline").alias("title"), F.col("linkedin_url").alias("profile_url"), "provider_id")
    return SF.read_engagers(v.contacts.sparkSession, _record_files(v, "data", people))
