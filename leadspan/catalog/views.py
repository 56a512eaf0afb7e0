"""The given tables seen as outreach tables (leads, suppression, feeds, memory, ...).

Each view is one SQL text written for Spark and for DuckDB; the few spellings that differ between the
two go through a small dialect object. Views keep every row of their tables, so they grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leadspan.session import spread

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Tables whose queries do much work per row (texts, regular expressions).
COSTLY_TABLES = ("documents", "pages", "events")

FIRST_NAMES = (
    "Ada Alan Barbara Carl Claude Dana Dennis Donald Edsger Edith Emmy Frances Grace Hedy Ivan Jean John "
    "Joan Karen Ken Kurt Leslie Linus Lynn Margaret Marie Mary Niklaus Noam Olga Peter Radia Rosa Sofia "
    "Stephen Susan Tim Ursula Vera Walter"
).split()
LAST_NAMES = (
    "Lovelace Turing Liskov Gauss Shannon Scott Ritchie Knuth Dijkstra Clarke Noether Allen Hopper Lamarr "
    "Sutherland Bartik Backus Clarkson Jones Thompson Goedel Lamport Torvalds Conway Hamilton Curie Shaw "
    "Wirth Chomsky Ladyzhenskaya Naur Perlman Luxemburg Kovalevskaya Cook Graham Berners Franklin Rubin Pitts"
).split()
COMPANIES = [
    "Acme Inc.", "Acme Corp", "Globex Holdings", "Initech LLC", "Umbrella Group", "Stark Industries",
    "Wayne Enterprises", "Hooli", "Pied Piper Inc", "Vehement Capital", "Massive Dynamic", "Soylent Corp",
    "Tyrell Company", "Cyberdyne Systems", "Wonka Ltd", "Oscorp PLC", "Nakatomi Trading Co", "Gringotts",
    "The Daily Planet", "Aperture Labs", "Black Mesa", "Blue Sun", "Zorg Ltd.",
]
TITLES = [
    "CEO & Founder", "VP Engineering", "Head of Marketing", "VP Sales", "Director of Operations",
    "Senior Software Engineer", "Product Manager", "Growth Marketer", "Account Executive",
    "HR Business Partner", None, "Data Analyst",
]
STAGES = [
    "Queued", "Connect_Sent", "Connected", "DM1_Sent", "DM2_Sent", "Replied", "Demo_Booked",
    "Deal_Created", "Closed_Won", "Expired", "No_Reply",
]
MESSAGE_PREFIXES = [
    "", "Hi there, ", "I saw your post. ", "Hello, strong signal here. ", "Hey - quick note. ",
    "Hello, full disclosure first. ", "Great to connect! ", "Hello, see Clay.com today. ",
    "Let me know your thoughts. ", "Dear team – buying signals. ", "Hello there, ",
    "Good morning, no pitch. ",
]
FIXED_NOW = "TIMESTAMP '2025-01-01 00:00:00'"


class Dialect:
    def __init__(self, name: str):
        self.spark = name == "spark"

    def hours(self, ts: str, n: str) -> str:
        return f"timestampadd(HOUR, CAST({n} AS INT), {ts})" if self.spark else f"({ts} + to_hours(CAST({n} AS BIGINT)))"

    def days(self, ts: str, n: str) -> str:
        return f"timestampadd(DAY, CAST({n} AS INT), {ts})" if self.spark else f"({ts} + to_days(CAST({n} AS INTEGER)))"

    def months(self, ts: str, n: str) -> str:
        return (
            f"CAST(add_months({ts}, CAST({n} AS INT)) AS TIMESTAMP)"
            if self.spark
            else f"({ts} + to_months(CAST({n} AS INTEGER)))"
        )

    def pick(self, items: list, idx: str) -> str:
        body = ", ".join("NULL" if i is None else f"'{i}'" for i in items)
        if self.spark:
            return f"element_at(array({body}), CAST({idx} AS INT) + 1)"
        return f"list_extract([{body}], CAST({idx} AS INTEGER) + 1)"

    def array(self, *exprs: str) -> str:
        return f"array({', '.join(exprs)})" if self.spark else f"[{', '.join(exprs)}]"

    def numbers(self, table: str, n: int, col: str) -> str:
        """FROM item: every row of ``table`` once per number 0..n-1."""
        if self.spark:
            return f"{table} LATERAL VIEW explode(sequence(0, {n - 1})) AS {col}"
        return f"{table}, unnest(range(0, {n})) AS nums({col})"

    def shifted(self, col: str) -> str:
        """A vector with its first element moved by 0.01."""
        if self.spark:
            return f"transform({col}, (x, i) -> IF(i = 0, CAST(x + 0.01D AS FLOAT), x))"
        return f"list_concat([CAST({col}[1] + 0.01::DOUBLE AS FLOAT)], {col}[2:])"


def view_defs(d: Dialect) -> dict[str, tuple[tuple[str, ...], str]]:
    """name -> (views and tables it reads, SELECT text)."""
    k = "((c_custkey * 31) % 1201 + 1201 * CAST(floor(c_custkey / 1500) AS BIGINT))"
    person = "(user_id * 8 + event_id % 8)"
    v: dict[str, tuple[tuple[str, ...], str]] = {}

    v["contacts"] = (("customer",), f"""
        SELECT contact_id, nation_key, k, concat('t', nation_key % 3) AS tenant_id,
          CASE WHEN contact_id % 13 = 0 THEN NULL
               WHEN contact_id % 2 = 0 THEN concat(' U', k, '@D', k % 97, '.com')
               ELSE concat('u', k, '@d', k % 97, '.com') END AS email,
          CASE contact_id % 5 WHEN 0 THEN concat('https://www.linkedin.com/in/User-', k, '/')
               WHEN 1 THEN concat('http://linkedin.com/pub/user-', k, '?trk=x')
               WHEN 2 THEN concat('linkedin.com/in/user-', k, '/details')
               WHEN 3 THEN NULL
               ELSE concat('https://www.linkedin.com/in/user-', k, '#about') END AS linkedin_url,
          {d.pick(FIRST_NAMES, 'k % 40')} AS first_name,
          {d.pick(LAST_NAMES, 'floor(k / 40) % 40')} AS last_name,
          CASE WHEN k < 1201 THEN {d.pick(COMPANIES, 'k % 23')}
               ELSE concat({d.pick(COMPANIES, 'k % 23')}, ' ', CAST(floor(k / 1201) AS BIGINT)) END AS company,
          {d.pick(TITLES, 'contact_id % 12')} AS headline,
          concat('p', k) AS provider_id, segment AS industry, segment, acctbal
        FROM (SELECT c_custkey AS contact_id, c_nationkey AS nation_key, c_mktsegment AS segment,
                     c_acctbal AS acctbal, {k} AS k FROM customer) c""")

    v["suppression"] = (("supplier", "contacts"), f"""
        SELECT s_suppkey AS ord, concat('s', s_suppkey) AS entry_id, concat('t', s_nationkey % 3) AS tenant_id,
          CASE WHEN s_suppkey % 2 = 0 THEN concat('u', (s_suppkey * 31) % 1201, '@d', ((s_suppkey * 31) % 1201) % 97, '.com')
               ELSE concat('new', s_suppkey, '@d', s_suppkey % 97, '.com') END AS email,
          CASE WHEN s_suppkey % 3 = 0 THEN concat('https://www.linkedin.com/in/user-', (s_suppkey * 31) % 1201) END AS linkedin_url,
          {d.pick(FIRST_NAMES, 's_suppkey % 40')} AS first_name,
          {d.pick(LAST_NAMES, '(s_suppkey * 7) % 40')} AS last_name,
          {d.pick(TITLES, 's_suppkey % 12')} AS headline,
          {d.pick(COMPANIES, 's_suppkey % 23')} AS company,
          {d.pick(['campaign_active', 'campaign_replied', 'blocklist', 'crm'], 's_suppkey % 4')} AS source
        FROM supplier
        UNION ALL
        SELECT 1000000000000 + contact_id, concat('c', contact_id), tenant_id,
          CASE WHEN contact_id % 3 = 0 THEN concat('z', k, '@d', k % 97, '.com') END,
          CAST(NULL AS STRING),
          CASE contact_id % 4 WHEN 0 THEN first_name WHEN 1 THEN substr(first_name, 2) ELSE {d.pick(LAST_NAMES, 'contact_id % 40')} END,
          CASE contact_id % 4 WHEN 0 THEN concat(last_name, 's') WHEN 1 THEN last_name ELSE {d.pick(FIRST_NAMES, '(contact_id * 3) % 40')} END,
          headline, CASE contact_id % 4 WHEN 3 THEN concat(industry, ' Works') ELSE company END, 'campaign_active'
        FROM contacts""")

    v["campaigns"] = (("nation",), f"""
        SELECT n_nationkey AS campaign_id, concat('t', n_nationkey % 3) AS tenant_id, n_name AS title,
          {d.pick(['draft', 'scheduled', 'active', 'paused', 'completed'], 'n_nationkey % 5')} AS status,
          {d.months("TIMESTAMP '1995-01-01 00:00:00'", 'n_nationkey')} AS created_at,
          {d.months("TIMESTAMP '1995-01-01 00:00:00'", 'n_nationkey + 30')} AS updated_at,
          20 + (n_nationkey % 3) * 10 AS daily_limit,
          {d.pick(['Europe/Paris', 'America/New_York', 'Asia/Tokyo', 'UTC'], 'n_nationkey % 4')} AS timezone,
          {d.pick(['1996-08-01', '1997-01-15', None], 'n_nationkey % 3')} AS start_at,
          {d.pick(['09:00', '08:30', '10:00'], 'n_nationkey % 3')} AS window_start,
          {d.pick(['18:00', '17:15'], 'n_nationkey % 2')} AS window_end,
          CASE n_nationkey % 4 WHEN 0 THEN {d.array('1', '2', '3', '4', '5')}
               WHEN 1 THEN {d.array('1', '3', '5')} WHEN 2 THEN {d.array('6', '7')}
               ELSE {d.array('1', '2', '3', '4', '5', '6', '7')} END AS active_days,
          CASE WHEN n_nationkey % 3 = 0 THEN 'calendar' ELSE 'business' END AS delay_mode
        FROM nation""")

    v["campaign_variants"] = (("nation",), f"""
        SELECT CAST(n_nationkey * 10 + v AS BIGINT) AS variant_id, n_nationkey AS campaign_id,
          concat('t', n_nationkey % 3) AS tenant_id, {d.pick(['A', 'B', 'C'], 'v')} AS name, CAST(v AS INT) AS position,
          'active' AS status
        FROM {d.numbers('nation', 3, 'v')}""")

    v["campaign_leads"] = (("orders", "contacts"), f"""
        SELECT lead_id, campaign_id, tenant_id, contact_id, v, CAST(campaign_id * 10 + v AS BIGINT) AS variant_id,
          {d.pick(STAGES, 'stage')} AS lifecycle_status, sent AS connect_sent_at, conn AS connected_at,
          dm1 AS dm1_sent_at,
          CASE WHEN stage >= 4 AND stage <> 9 THEN {d.hours('dm1', '72')} END AS dm2_sent_at,
          CASE WHEN stage BETWEEN 5 AND 8 THEN {d.hours('dm1', '1 + contact_id % 96')} END AS replied_at,
          CASE WHEN stage BETWEEN 5 AND 8 AND lead_id % 5 = 0 THEN {d.hours('dm1', '1 + contact_id % 96')} END AS email_replied_at,
          CASE WHEN lead_id % 4 = 0 THEN sent END AS email_sent_at,
          CASE WHEN lead_id % 8 = 0 THEN conn END AS email_opened_at,
          CASE WHEN lead_id % 23 = 0 THEN sent END AS email_bounced_at,
          CASE WHEN lead_id % 17 = 0 THEN NULL ELSE CAST(floor(price) AS BIGINT) % 101 END AS qualification_score,
          {d.array('priority', 'segment')} AS tags,
          CASE WHEN lead_id % 19 = 0 THEN NULL ELSE segment END AS source,
          headline, first_name, last_name, company, email, linkedin_url, provider_id,
          {d.pick([None, 'valid', 'unverified', 'bounced', 'sent'], 'lead_id % 5')} AS email_status,
          CASE WHEN lead_id % 6 = 0 THEN concat('ec', campaign_id) END AS email_campaign_id,
          order_date AS created_at, {d.hours('order_date', 'lead_id % 1000')} AS updated_at
        FROM (SELECT b.*,
            CASE WHEN stage BETWEEN 3 AND 8 OR stage = 10 THEN {d.hours('conn', '48')} END AS dm1
          FROM (SELECT a.*, CASE WHEN stage >= 1 THEN order_date END AS sent,
              CASE WHEN stage BETWEEN 2 AND 8 OR stage = 10 THEN {d.hours('order_date', '1 + lead_id % 72')} END AS conn
            FROM (SELECT o_orderkey AS lead_id, c.*, c.nation_key AS campaign_id, o_orderkey % 3 AS v,
                CAST(o_orderdate AS TIMESTAMP) AS order_date, o_totalprice AS price, o_orderpriority AS priority,
                CASE WHEN o_orderkey % 3 = 1 AND (o_orderkey * 7 + o_custkey) % 11 IN (3, 4) THEN 5
                     ELSE (o_orderkey * 7 + o_custkey) % 11 END AS stage
              FROM orders JOIN contacts c ON o_custkey = c.contact_id) a) b) d""")

    v["campaign_content"] = (("lineitem",), f"""
        SELECT l_orderkey AS content_id, l_linenumber AS step_no, CAST(l_suppkey % 25 AS BIGINT) AS campaign_id,
          CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS variant,
          CASE WHEN l_partkey % 13 = 0 THEN 'failed' ELSE 'ready' END AS status,
          CAST(l_shipdate AS TIMESTAMP) AS sent_at,
          CASE WHEN l_partkey % 2 = 0 THEN {d.hours('CAST(l_shipdate AS TIMESTAMP)', '5')} END AS opened_at,
          CASE WHEN l_partkey % 5 = 0 THEN {d.hours('CAST(l_shipdate AS TIMESTAMP)', '9')} END AS replied_at,
          CASE WHEN l_partkey % 17 = 0 THEN {d.hours('CAST(l_shipdate AS TIMESTAMP)', '30')} END AS converted_at,
          CASE WHEN l_partkey % 19 = 0 THEN {d.hours('CAST(l_shipdate AS TIMESTAMP)', '1')} END AS bounced_at
        FROM lineitem""")

    v["campaign_steps"] = (("nation",), f"""
        SELECT CAST(n_nationkey AS BIGINT) AS campaign_id, CAST(s + 1 AS INT) AS step_no, CAST(s AS INT) AS step_index,
          {d.pick(['linkedin', 'email', 'linkedin', 'email', 'twitter'], 's')} AS channel
        FROM {d.numbers('nation', 5, 's')}""")

    v["blocklist"] = (("supplier",), """
        SELECT s_suppkey AS block_id, concat('t', s_nationkey % 3) AS tenant_id,
          CASE WHEN s_suppkey % 2 = 0 THEN concat('p', (s_suppkey * 31) % 1201) END AS provider_id,
          CASE WHEN s_suppkey % 3 = 0 THEN concat('https://www.linkedin.com/in/user-', (s_suppkey * 17) % 1201) END AS linkedin_url,
          CASE WHEN s_suppkey % 2 = 0 THEN 'permanent' ELSE 'campaign' END AS scope,
          s_nationkey AS campaign_id, s_name AS name, 'Chief Buyer' AS headline, 'Blocked Co' AS company
        FROM supplier""")

    v["profiles"] = (("events",), f"""
        SELECT ordinal, CAST(ts AS TIMESTAMP) AS found_at, CASE WHEN ordinal % 7 = 0 THEN NULL ELSE person END AS rr_id,
          CASE WHEN ordinal % 3 = 0 THEN NULL ELSE concat('https://linkedin.com/in/Q', person % 900, '/') END AS linkedin_url,
          CASE WHEN ordinal % 5 = 0 THEN '' ELSE concat({d.pick(FIRST_NAMES, 'person % 40')}, ' ', {d.pick(LAST_NAMES, 'floor(person / 40) % 40')}) END AS name,
          {d.pick(COMPANIES, 'person % 23')} AS company_name,
          concat('https://www.d', person % 211, '.com/about') AS company_domain,
          {d.pick(TITLES, 'person % 12')} AS title, concat('q', ordinal % 9) AS query_hash
        FROM (SELECT event_id AS ordinal, ts, {person} AS person FROM events) e""")

    v["mined_people"] = (("profiles",), """
        SELECT ordinal AS mined_id, rr_id, linkedin_url, name, company_name, company_domain, title, found_at AS first_seen_at,
          CASE ordinal % 4 WHEN 0 THEN 'seen' WHEN 1 THEN 'enriched' WHEN 2 THEN 'delivered' ELSE 'seen' END AS status
        FROM profiles WHERE found_at < TIMESTAMP '2024-01-05 00:00:00'""")

    v["new_profiles"] = (("profiles",), """
        SELECT * FROM profiles WHERE found_at >= TIMESTAMP '2024-01-05 00:00:00'""")

    v["feed_items"] = (("events",), f"""
        SELECT event_id AS item_no, event_type AS source_key,
          concat('https://www.Site', user_id % 10, '.com/P/', user_id * 50 + event_id % 50, '/?utm=', event_id) AS link,
          concat('Story ', event_id) AS title,
          CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS published_at
        FROM events""")

    v["watermarks"] = (("events",), """
        SELECT event_type AS source_key, max(CASE WHEN ts < TIMESTAMP '2024-01-20 00:00:00' THEN CAST(ts AS TIMESTAMP) END) AS last_published_at
        FROM events WHERE event_type <> 'error' GROUP BY event_type""")

    v["stored_urls"] = (("events",), """
        SELECT concat('http://site', user_id % 10, '.com/p/', user_id * 50 + event_id % 50) AS url,
          CAST(count(*) AS BIGINT) AS times_seen, max(CAST(ts AS TIMESTAMP)) AS last_seen_at
        FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1""")

    v["observations"] = (("events",), f"""
        SELECT event_id AS obs_id, user_id AS entity_id, CAST(ts AS TIMESTAMP) AS observed_at,
          {d.pick(['funding', 'hiring-surge', 'job-change', 'news'], 'event_id % 4')} AS signal_type,
          CAST(floor(value) AS BIGINT) AS amount,
          {d.pick(['Seed', 'Series A', 'Series B'], 'floor(value / 20) % 3')} AS round_name,
          {d.pick([t for t in TITLES if t], 'floor(value / 12) % 11')} AS title,
          {d.pick(COMPANIES, 'floor(value / 15) % 23')} AS company
        FROM events""")

    v["evidence"] = (("lineitem",), f"""
        SELECT l_partkey AS insight_id, l_suppkey AS source_id, l_orderkey AS evidence_key, l_linenumber AS line_no,
          'campaign_outcome' AS evidence_type, 'reply' AS metric, l_discount AS value,
          CAST(l_quantity AS BIGINT) AS sample_size, CAST(l_shipdate AS TIMESTAMP) AS observed_at
        FROM lineitem""")

    v["insights"] = (("part",), f"""
        SELECT p_partkey AS insight_id, concat('t', p_partkey % 3) AS tenant_id, p_type AS category, p_name AS insight,
          CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS segment,
          {d.pick(['linkedin', 'email', None], 'p_partkey % 3')} AS channel,
          {d.pick(['hypothesis', 'validated', 'proven'], 'p_partkey % 3')} AS confidence,
          CAST(p_size AS BIGINT) AS confidence_score,
          {d.pick(['campaign_outcome', 'rlhf', 'manual'], 'p_size % 3')} AS source,
          CASE WHEN p_partkey % 5 = 0 THEN {d.days("TIMESTAMP '2024-06-01 00:00:00'", 'p_size * 9')} END AS expires_at,
          {d.days("TIMESTAMP '2023-01-01 00:00:00'", 'p_partkey % 500')} AS created_at
        FROM part""")

    v["provider_stats"] = (("lineitem",), f"""
        SELECT l_suppkey AS provider_id, l_returnflag AS segment, metric,
          CASE metric WHEN 'accuracy' THEN l_discount * 1000 WHEN 'latency_ms' THEN l_extendedprice / 10
               WHEN 'cost_per_call' THEN l_discount ELSE l_quantity END AS value,
          CAST(CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity END AS BIGINT) AS sample_size,
          CAST(l_shipdate AS TIMESTAMP) AS measured_at
        FROM (SELECT l.*, {d.pick(['accuracy', 'latency_ms', 'cost_per_call', 'coverage'], 'l_linenumber % 4')} AS metric FROM lineitem l) x""")

    v["provider_preferences"] = (("supplier",), f"""
        SELECT s_suppkey AS pref_id, concat('skill', s_suppkey % 7) AS skill_id, concat('seg', s_suppkey % 3) AS segment,
          s_suppkey AS preferred_provider, CASE WHEN s_suppkey % 2 = 0 THEN 'user' ELSE 'auto' END AS source,
          {d.hours("TIMESTAMP '2024-01-01 00:00:00'", '(s_suppkey * 37) % 5000')} AS created_at
        FROM supplier""")

    v["result_rows"] = (("customer", "part"), f"""
        SELECT 'customers' AS result_set_id, c_custkey AS row_index, c_custkey % 29 = 0 AS is_null_row,
          CASE WHEN c_custkey % 6 = 0 THEN '' ELSE {d.pick(COMPANIES, 'c_custkey % 23')} END AS company_name,
          CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('www.d', c_custkey % 50, '.com')
               ELSE concat('https://d', c_custkey % 50, '.com/home') END AS website,
          CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('u', c_custkey, '@d.com') END AS email,
          CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '555' END AS phone,
          {d.pick(TITLES, 'c_custkey % 12')} AS title,
          CASE WHEN c_custkey % 7 < 3 THEN NULL ELSE c_mktsegment END AS city
        FROM customer
        UNION ALL
        SELECT CASE WHEN p_partkey % 2 = 0 THEN 'parts_a' ELSE 'parts_b' END, p_partkey, p_partkey % 31 = 0,
          CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE {d.pick(COMPANIES, 'p_partkey % 23')} END,
          CASE p_partkey % 3 WHEN 0 THEN concat('http://www.d', p_partkey % 60, '.com') ELSE NULL END,
          NULL, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE '777' END, p_name, p_brand
        FROM part""")

    v["memory_nodes"] = (("documents",), f"""
        SELECT doc_id AS node_id, concat('t', doc_id % 3) AS tenant_id, text AS content, source AS source_type,
          {d.pick(['hypothesis', 'validated', 'proven'], 'doc_id % 3')} AS confidence,
          CAST((doc_id * 13) % 100 AS BIGINT) AS confidence_score, CAST(doc_id % 15 AS BIGINT) AS access_count,
          {d.hours("TIMESTAMP '2023-01-01 00:00:00'", 'doc_id % 17000')} AS created_at,
          CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {d.days(FIXED_NOW, '0 - n_chars % 800')} END AS last_accessed_at,
          n_chars
        FROM documents""")

    v["entities"] = (("supplier",), f"""
        SELECT s_suppkey AS entity_id, concat('t', s_nationkey % 3) AS tenant_id, {d.pick(['Company', 'Person', 'Segment'], 's_suppkey % 3')} AS type,
          concat('name ', s_suppkey % 701) AS name,
          CASE WHEN s_suppkey % 6 <> 0 THEN {d.array("concat('alias ', s_suppkey % 353)", "concat('short ', s_suppkey * 7 % 997)")} END AS aliases, concat('stored ', s_suppkey) AS properties
        FROM supplier""")
    v["mentions"] = (("customer",), f"""
        SELECT c_custkey AS seq, 10000000 + c_custkey AS entity_id, concat('t', c_nationkey % 3) AS tenant_id, {d.pick(['Company', 'Person', 'Segment'], 'c_custkey % 3')} AS type,
          CASE WHEN c_custkey % 4 = 0 THEN concat('short ', c_custkey % 2003) WHEN c_custkey % 4 = 1 THEN concat('alias ', c_custkey % 1409) ELSE concat('name ', c_custkey % 1201) END AS name,
          CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN {d.array("concat('alias ', c_custkey * 13 % 1409)", "concat('short ', c_custkey * 11 % 2003)", "concat('alias ', (c_custkey * 13 + 3) % 1409)")}
               ELSE {d.array("concat('short ', c_custkey * 17 % 2003)")} END AS aliases, concat('mention ', c_custkey) AS properties
        FROM customer""")
    v["memory_embeddings"] = (("embeddings",), f"""
        SELECT vec_id AS node_id, embedding AS vector, label FROM embeddings
        UNION ALL
        SELECT vec_id + 1000000000, {d.shifted('embedding')}, label FROM embeddings WHERE vec_id % 5 = 0""")

    v["memory_edges"] = (("embeddings",), f"""
        SELECT vec_id * 10 AS edge_id, 'node' AS from_type, vec_id AS from_id, 'entity' AS to_type, CAST(label AS BIGINT) AS to_id,
          'about' AS relation, {d.hours("TIMESTAMP '2024-01-01 00:00:00'", 'vec_id % 999')} AS created_at FROM embeddings
        UNION ALL
        SELECT vec_id * 10 + 1, 'node', vec_id, 'node', vec_id + 1, 'contradicts', TIMESTAMP '2024-02-01 00:00:00'
        FROM embeddings WHERE vec_id % 50 = 7
        UNION ALL
        SELECT vec_id * 10 + 2, 'node', vec_id + 1, 'node', vec_id, 'supersedes', {d.hours("TIMESTAMP '2024-03-01 00:00:00'", 'vec_id % 999')}
        FROM embeddings WHERE vec_id % 40 IN (0, 1, 2)
        UNION ALL
        SELECT vec_id * 10 + 3, 'node', vec_id + 7, 'node', vec_id, 'supersedes', TIMESTAMP '2024-01-15 00:00:00'
        FROM embeddings WHERE vec_id % 40 = 1
        UNION ALL
        SELECT vec_id * 10 + 4, 'node', vec_id - 1, 'node', vec_id, 'supersedes', TIMESTAMP '2024-05-01 00:00:00'
        FROM embeddings WHERE vec_id % 100 = 61
        UNION ALL
        SELECT vec_id * 10 + 5, 'node', vec_id, 'node', vec_id - 1, 'supersedes', TIMESTAMP '2024-05-01 00:00:00'
        FROM embeddings WHERE vec_id % 100 = 61""")

    v["messages"] = (("conversations",), f"""
        SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role,
          concat({d.pick(MESSAGE_PREFIXES, '(conv_id + turn) % 12')}, text) AS text
        FROM conversations""")

    v["reviews"] = (("orders",), f"""
        SELECT o_orderkey AS review_id, concat('t', o_custkey % 3) AS tenant_id,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'normal' ELSE 'low' END AS priority,
          CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'approved' ELSE 'rejected' END AS status,
          CAST(o_orderdate AS TIMESTAMP) AS created_at,
          CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE {d.days('CAST(o_orderdate AS TIMESTAMP)', '30')} END AS expires_at
        FROM orders""")

    v["swipes"] = (("events",), """
        SELECT event_id AS sample_id, CASE WHEN value > 60 THEN 'like' ELSE 'dislike' END AS verdict, event_type AS dim_type,
          concat('h', CAST(floor(extract(HOUR FROM CAST(ts AS TIMESTAMP)) / 6) AS BIGINT)) AS dim_hour,
          CASE WHEN value > 80 THEN 'high' WHEN value > 20 THEN 'mid' ELSE NULL END AS dim_tone
        FROM events""")

    v["relations"] = (("events",), """
        SELECT concat('p', user_id * 7) AS provider_id, CAST(ts AS TIMESTAMP) AS connected_at FROM events WHERE event_type = 'click'""")

    v["chat_messages"] = (("events",), """
        SELECT CAST(floor(event_id / 3) AS BIGINT) AS chat_id, event_id AS message_no,
          CASE WHEN event_id % 3 = 0 THEN 'me' ELSE concat('p', user_id * 5) END AS sender_id,
          concat('p', user_id * 5) AS attendee_id
        FROM events""")

    v["email_status"] = (("events",), f"""
        SELECT event_id AS status_no, concat('u', (user_id * 8 + event_id % 8), '@d', (user_id * 8 + event_id % 8) % 97, '.COM') AS email,
          {d.pick(['active', 'bounced', 'active', 'completed'], 'event_id % 4')} AS status,
          CASE WHEN event_id % 4 = 1 THEN CAST(ts AS TIMESTAMP) END AS bounced_at,
          CASE WHEN event_id % 6 = 2 THEN CAST(ts AS TIMESTAMP) END AS replied_at,
          CASE WHEN event_id % 5 = 3 THEN CAST(ts AS TIMESTAMP) END AS opened_at
        FROM events""")

    v["send_requests"] = (("events",), f"""
        SELECT event_id AS request_id, concat('t', user_id % 3) AS tenant_id,
          CASE event_type WHEN 'click' THEN 'linkedin.connect' WHEN 'view' THEN 'linkedin.dm'
               WHEN 'purchase' THEN 'email.send' WHEN 'error' THEN 'linkedin.search' ELSE 'other.api' END AS provider,
          user_id % 5 AS account_id, CAST(ts AS TIMESTAMP) AS requested_at, 1 + event_id % 4 AS tokens
        FROM events""")
    return v


_SPARK = view_defs(Dialect("spark"))
_DUCK = view_defs(Dialect("duckdb"))


class Views:
    """Lazy access to the base tables and the derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES or name in _SPARK:
            return self[name]
        raise AttributeError(name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE_TABLES:
                table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._made[name] = spread(table) if name in COSTLY_TABLES else table
            else:
                needs, text = _SPARK[name]
                self._made[name] = self.spark.sql(_brace(text, needs), **{n: self[n] for n in needs})
        return self._made[name]


def _brace(text: str, needs: tuple[str, ...]) -> str:
    """Refer to the DataFrames passed to spark.sql: FROM orders -> FROM {orders}."""
    for n in needs:
        text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b(\s+[cl]\b)?", lambda m, n=n: f"{m[1]} {{{n}}}{m[2] or ' AS ' + n}", text)
    return text


def oracle_with(needs: tuple[str, ...], sql: str) -> str:
    """DuckDB text: the needed views, in dependency order, in front of ``sql``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in order:
            return
        for n in _DUCK[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({_DUCK[n][1]})" for n in order)
    head, body = "WITH ", sql.lstrip()
    if body[:15].upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"{head}{ctes},\n{body[5:]}"
    return f"{head}{ctes}\n{body}"
