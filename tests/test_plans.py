"""Tracking, discovery runs and hybrid retrieval on small fixtures."""

import datetime

from pyspark.sql import functions as F

from leadspan.functions.normalize import content_hash
from leadspan.operators import memory as M
from leadspan.operators.ledger import add_blocklist
from leadspan.plans import mining, tracking

NOW = datetime.datetime(2026, 4, 1, 10, 0)  # a Wednesday
DAY = datetime.timedelta(days=1)
LEAD = (
    "lead_id long, campaign_id int, tenant_id string, variant_id long, lifecycle_status string, connect_sent_at timestamp, connected_at timestamp, dm1_sent_at timestamp, "
    "dm2_sent_at timestamp, replied_at timestamp, provider_id string, linkedin_url string, email string, first_name string, last_name string, company string, headline string, updated_at timestamp"
)


def lead(n, status, campaign=1, sent=None, conn=None, dm1=None, dm2=None, replied=None, provider=None):
    return (n, campaign, "t", 10, status, sent, conn, dm1, dm2, replied, provider or f"p{n}", None, None, "Ann", "Lee", "Acme", "CEO", NOW - 50 * DAY)


def test_tracking_phases(spark):
    leads = [
        lead(1, "Connect_Sent", sent=NOW - DAY), lead(2, "Connect_Sent", sent=NOW - 31 * DAY), lead(3, "Connected", conn=NOW - 2 * DAY), lead(4, "Connected", conn=NOW - DAY),
        lead(5, "DM1_Sent", dm1=NOW - 5 * DAY), lead(6, "DM1_Sent", dm1=NOW - 5 * DAY), lead(7, "DM2_Sent", dm2=NOW - 14 * DAY), lead(8, "Queued"), lead(9, "Queued"), lead(10, "Queued"),
        lead(11, "Replied", replied=NOW - 9 * DAY, provider="p9"), lead(12, "Connected", campaign=2, conn=NOW - 9 * DAY), lead(13, "DM2_Sent", dm2=NOW - 20 * DAY), lead(14, "Queued", sent=NOW),
    ]
    df = spark.createDataFrame(leads, LEAD)
    every = [1, 2, 3, 4, 5]
    campaigns = spark.createDataFrame(
        [(1, "t", "scheduled", "UTC", "2026-04-01", "09:00", "18:00", every, "business", 4), (2, "t", "active", "Asia/Tokyo", None, "09:00", "18:00", every, "business", 4)],
        "campaign_id int, tenant_id string, status string, timezone string, start_at string, window_start string, window_end string, active_days array<int>, delay_mode string, daily_limit int",
    )
    variants = spark.createDataFrame([("t", 10, "Hello {{first_name}}", "Hello {{first_name}} at {{company}}", "Hello again")], "tenant_id string, variant_id long, connect_note string, dm1_template string, dm2_template string")
    relations = spark.createDataFrame([("p1",), ("p2",)], "provider_id string")
    chats = spark.createDataFrame([(1, "me", "p6"), (1, "p6", "p6"), (2, "me", "p5"), (3, "p13", "p13")], "chat_id long, sender_id string, attendee_id string")
    blocklist = spark.createDataFrame([], "tenant_id string, provider_id string, linkedin_url string, scope string, campaign_id int")
    t = tracking.track(df, campaigns, variants, relations, chats, blocklist, F.lit(NOW))
    got = {r.lead_id: (r.action, r.next_status) for r in t.collect()}
    assert got[1] == ("accepted", "Connected")
    assert got[2] == ("accepted", "Expired")  # staleness comes last and wins
    assert got[3] == ("dm1", "DM1_Sent") and got[4] == (None, "Connected")
    assert got[5] == ("dm2", "DM2_Sent")
    assert got[6] == ("skipped_blocked", "Replied")  # the reply of this run stops the message of this run
    assert got[7] == ("expired", "No_Reply") and got[13] == ("replied", "No_Reply")
    # limit 4, one sent today: three slots, the blocked lead uses up one of them
    assert got[8] == ("connect", "Connect_Sent") and got[9] == ("skipped_blocked", "Queued") and got[10] == ("connect", "Connect_Sent")
    assert 12 not in got and got[14] == (None, "Queued")
    after = {r.lead_id: r for r in tracking.next_snapshot(df, t, F.lit(NOW)).collect()}
    assert len(after) == len(leads) and after[3].dm1_sent_at == NOW and after[12].lifecycle_status == "Connected" and after[4].updated_at == NOW - 50 * DAY


def test_discovery_run_is_the_sequential_run(spark):
    rows = []
    for q in range(3):
        for pos in range(23):
            rows.append((q, f"h{q}", pos, q * 100 + pos, (q * 7 + pos) % 31, None, f"Name {(q * 5 + pos) % 40}", "Acme", f"d{pos % 4}.com", "T"))
    cols = "query_no int, query_hash string, position long, ordinal long, rr_id long, linkedin_url string, name string, company_name string, company_domain string, title string"
    ledger_cols = "mined_id long, rr_id long, linkedin_url string, name string, company_name string, company_domain string, title string, first_seen_at timestamp, status string"
    ledger = [(1000, 3, None, "Name 3", "Acme", "d1.com", "T", NOW - DAY, "seen"), (1001, 4, None, "Name 4", "Acme", "d1.com", "T", NOW - 2 * DAY, "delivered")]
    target, page = 20, 10
    seen, waiting, kept, cursors = {"rr3", "rr4", "Name 3", "Name 4"}, 1, [], {}
    for q in range(3):
        mine = [r for r in rows if r[0] == q]
        fetched = fresh = 0
        end = False
        while waiting + len(kept) < target and fetched < 500:
            got = mine[fetched:fetched + page]
            if not got:
                end = True
                break
            for r in got:
                keys = {f"rr{r[4]}", r[6]}
                if not keys & seen:
                    seen |= keys
                    kept.append(r[3])
                    fresh += 1
            fetched += len(got)
            if len(got) < page:
                end = True
                break
        cursors[f"h{q}"] = (1 + fetched, end)
    out = mining.mine(
        spark.createDataFrame(rows, cols), spark.createDataFrame(ledger, ledger_cols), spark.createDataFrame([(1, 3, None, "n3@x.com", None)], "contact_no long, rr_id long, linkedin_url string, email string, phone string"),
        spark.createDataFrame([("d1.com", "One", 2, NOW)], "domain string, name string, people_count long, last_mined_at timestamp"),
        spark.createDataFrame([(f"h{q}", 1, 0, "active", None) for q in range(3)], "query_hash string, next_start long, low_yield_streak long, status string, total_matches long"),
        F.lit(NOW), target=target, page_size=page,
    )
    assert sorted(r.mined_id for r in out["ledger"].collect() if r.mined_id < 1000) == sorted(kept)
    delivered = out["delivered"].collect()
    assert len(delivered) == min(target, 1 + len(kept)) and {r.mined_id: r.email for r in delivered}[1000] == "n3@x.com"
    assert {r.query_hash: r.next_start for r in out["cursors"].collect()} == {h: n for h, (n, _) in cursors.items()}
    assert {r.domain: r.people_count for r in out["companies"].collect()}["d1.com"] == 2


def test_blocklist_repeats_inside_the_batch(spark):
    stored = spark.createDataFrame([("p1", "s1")], "provider_id string, linkedin_slug string")
    incoming = spark.createDataFrame([(1, "p1", "n1"), (2, "p2", "s2"), (3, "p3", "s2"), (4, "p3", None), (5, None, None)], "row_no int, provider_id string, linkedin_slug string")
    assert sorted((r.provider_id, r.linkedin_slug) for r in add_blocklist(incoming, stored).collect() if r.provider_id != "p1") == [("p2", "s2"), ("p3", None)]


NODE = "node_id long, tenant_id string, content string, source_type string, confidence string, confidence_score long, access_count long, created_at timestamp, last_accessed_at timestamp, archived_at timestamp"


def node(n, text, confidence="hypothesis", tenant="t", archived=None):
    return (n, tenant, text, "doc", confidence, 0, 0, NOW - n * DAY, None, archived)


def test_hybrid_retrieval(spark):
    nodes = spark.createDataFrame([
        node(1, "linkedin voice guide for founders"), node(2, "a recipe with tomato soup"), node(3, "founders write short posts"), node(4, "linkedin voice for founders", archived=NOW),
        node(5, "linkedin voice for founders", tenant="other"), node(6, "proven words on founders", "proven"),
    ], NODE)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.8, 0.6]), (5, [1.0, 0.0])], "node_id long, vector array<float>")
    q = spark.createDataFrame([(7, "t", "linkedin voice for founders", [1.0, 0.0])], "query_id long, tenant_id string, text string, vector array<float>")
    got = M.retrieve(q, nodes, F.lit(NOW), vectors).orderBy("position").collect()
    assert [r.node_id for r in got] == [6, 1, 3, 2]
    assert [(r.keyword_rank, r.dense_rank) for r in got] == [(2, None), (1, 1), (3, 2), (None, 3)]
    assert abs(got[1].rrf - 2 / 61) < 1e-12
    keyword_only = [r.node_id for r in M.retrieve(q, nodes, F.lit(NOW)).collect()]
    assert 2 not in keyword_only and 5 not in keyword_only
    edges = spark.createDataFrame([(1, "node", 3, "entity", 9, "about", NOW), (2, "node", 5, "entity", 9, "about", NOW)], "edge_id long, from_type string, from_id long, to_type string, to_id long, relation string, created_at timestamp")
    anchors = spark.createDataFrame([(7, "entity", 9)], "query_id long, type string, id long")
    assert [r.node_id for r in M.retrieve(q, nodes, F.lit(NOW), vectors, edges, anchors).collect()] == [3]
    tight = M.retrieve(q, nodes, F.lit(NOW), vectors, token_budget=1).collect()
    assert [r.position for r in tight] == [1]


def test_maintenance_twice_changes_nothing_more(spark):
    nodes = spark.createDataFrame([node(1, "a", "validated"), node(2, "b"), node(3, "c", "proven")], NODE).withColumn("confidence_score", F.lit(9).cast("long"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.05]), (3, [0.0, 1.0])], "node_id long, vector array<float>")
    edges = spark.createDataFrame([(1, "node", 3, "node", 1, "contradicts", NOW)], "edge_id long, from_type string, from_id long, to_type string, to_id long, relation string, created_at timestamp")
    once, e1 = M.maintain_memory(nodes, vectors, edges, F.lit(NOW))
    state = {r.node_id: (r.confidence, r.confidence_score, r.archived_at is not None) for r in once.collect()}
    assert state == {1: ("hypothesis", 4, False), 2: ("hypothesis", 9, True), 3: ("hypothesis", 4, False)}
    _, e2 = M.maintain_memory(once, vectors, e1, F.lit(NOW))
    assert e1.count() == 2 and e2.count() == 2


def test_upsert_is_a_no_op_the_second_time(spark):
    stored = spark.createDataFrame([], "node_id long, tenant_id string, content string, source_hash string, archived_at timestamp")
    incoming = spark.createDataFrame([(1, "t", "same  text"), (2, "t", "same text "), (3, "u", "same text")], "node_id long, tenant_id string, content string")
    one = M.upsert_nodes(stored, incoming, "node_id")
    assert sorted(r.node_id for r in one.collect()) == [1, 3]
    assert M.upsert_nodes(one, incoming, "node_id").count() == 2
    assert incoming.select(content_hash(F.col("content"))).distinct().count() == 1


def test_daily_caps_hold_for_providers_without_a_limit(spark):
    from leadspan.catalog.discovery import PLAN_STEPS
    from leadspan.catalog.views import Views
    from leadspan.operators.admission import DEFAULT_LIMIT
    from leadspan.operators.sequences import plan_sequence
    from tests.conftest import SF

    few = Views(spark, SF).campaign_leads.limit(200)
    many = few.crossJoin(spark.range(4)).withColumn("lead_id", F.col("lead_id") * 4 + F.col("id")).withColumn("tenant_id", F.lit("t")).withColumn("email", F.lit("a@b.example")).withColumn("started_at", F.col("created_at")).drop("id")

    def granted(limits):
        rows = plan_sequence(many, PLAN_STEPS, F.lit("2001-01-01").cast("timestamp"), limits=limits).groupBy("channel", "status").count().collect()
        return {(r.channel, r.status): r["count"] for r in rows}
    free, capped = granted({"linkedin.connect": 10**6, "linkedin.dm": 10**6, "email.send": 10**6}), granted({"linkedin.connect": 30})
    asked = free.get(("email", "queued_email"), 0)
    assert capped.get(("email", "queued_email"), 0) == min(asked, DEFAULT_LIMIT)
