"""Stream forms give what the batch forms give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadspan.catalog.views import Views
from leadspan.functions.normalize import hash_url
from leadspan.operators import feeds, signals
from leadspan.operators.chunks import chunk_documents
from leadspan.operators.matching import apply_email_status
from leadspan.plans.tracking import next_snapshot, track
from leadspan.session import cut_lineage
from leadspan.streaming import jobs
from leadspan.streaming.lifecycle import EVENT, lead_states, lifecycle_stream
from tests.conftest import SF

SOURCES = ["click", "error", "purchase", "signup", "view"]


def as_files(df, path, parts):
    for i, condition in enumerate(parts):
        df.filter(condition).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    jobs.with_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(stream, tmp_path, name="out"):
    """All files there are, one per micro-batch, into a file sink; what the sink holds afterwards."""
    out, spark = str(tmp_path / name), stream.sparkSession
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start(out).awaitTermination(250)
    return spark.read.schema(stream.schema).parquet(out)


def test_feed_polls(spark, tmp_path):
    v = Views(spark, SF)
    items = v.feed_items.withColumn("feed_order", feeds.feed_order(F.col("source_key"), SOURCES))
    seen = v.stored_urls.select(hash_url(F.col("url")).alias("url_hash"))
    path = str(tmp_path / "in")
    cut = [F.col("item_no") < 400, (F.col("item_no") >= 400) & (F.col("item_no") < 800), F.col("item_no") >= 800]
    known, marks, want = seen, v.watermarks, []
    for i, condition in enumerate(cut):
        # the third poll comes after a restart
        as_files(items, path, [condition])
        if i:
            got = run(jobs.fresh_items_stream(stream_of(spark, items, path), seen, v.watermarks), tmp_path)
        new = feeds.fresh_items(items.filter(condition), marks, known).cache()
        want += [r.item_no for r in new.collect()]
        known = known.union(new.select("url_hash"))
        marks = feeds.next_watermarks(items.filter(condition), marks)
    assert sorted(r.item_no for r in got.collect()) == sorted(want) and want
    # a run without new files finds nothing
    assert run(jobs.fresh_items_stream(stream_of(spark, items, path), seen, v.watermarks), tmp_path).count() == len(want)


def test_feed_repeats_late_and_undated_items(spark, tmp_path):
    schema = "item_no long, source_key string, link string, feed_order int, d string"
    polls = [
        [(1, "a", "http://x/1", 1, "2024-01-05"), (2, "b", "http://x/1", 2, "2024-01-05"), (3, "b", None, 2, None), (4, "a", "http://x/1", 1, "2024-01-04")],
        [(5, "a", "http://x/2", 1, "2024-01-05"), (6, "a", "http://x/3", 1, "2024-01-06"), (7, "c", "http://x/1", 3, None), (8, "b", None, 2, None)],
        [(9, "b", "http://x/3", 2, "2024-01-01"), (10, "b", "http://x/4", 2, "2024-01-07"), (6, "a", "http://x/3", 1, "2024-01-06"), (11, "a", "", 1, "2024-01-08")],
        [(12, "a", "http://x/5", 1, "2024-01-07"), (13, "d", "http://x/6", 4, "2020-01-01")],
    ]
    none_seen, none_marked = spark.createDataFrame([], "url_hash string"), spark.createDataFrame([], "source_key string, last_published_at timestamp")
    path, known, marks, want = str(tmp_path / "in"), none_seen, none_marked, []
    for rows in polls:
        df = spark.createDataFrame(rows, schema).selectExpr("item_no", "source_key", "link", "feed_order", "CAST(d AS timestamp) AS published_at")
        df.coalesce(1).write.mode("append").parquet(path)
        new = feeds.fresh_items(df, marks, known)
        want += [r.item_no for r in new.collect()]
        known, marks = known.union(new.select("url_hash")), feeds.next_watermarks(df, marks)
    got = run(jobs.fresh_items_stream(stream_of(spark, df, path), none_seen, none_marked), tmp_path)
    assert sorted(r.item_no for r in got.collect()) == sorted(want)


def test_signals(spark, tmp_path):
    v = Views(spark, SF)
    watches = signals.baselines(v.observations.filter("observed_at < TIMESTAMP '2024-01-15 00:00:00'"))
    later = v.observations.filter("observed_at >= TIMESTAMP '2024-01-15 00:00:00'")
    path = str(tmp_path / "in")
    cut = [F.col("observed_at") < "2024-01-22", F.col("observed_at") >= "2024-01-22"]
    as_files(later, path, cut)
    got = run(jobs.signals_stream(stream_of(spark, later, path), watches), tmp_path)
    first = signals.detect_signals(watches, later.filter(cut[0]))
    second = signals.detect_signals(signals.next_watches(watches, first), later.filter(cut[1]))
    cols = ["entity_id", "signal_type", "detail", "new_items", "detected_at"]
    want = sorted(map(tuple, first.select(*cols).union(second.select(*cols)).collect()))
    assert sorted(map(tuple, got.select(*cols).collect())) == want and want


def test_one_signal_a_day(spark, tmp_path):
    v = Views(spark, SF)
    s = v.observations.select(F.lit("t").alias("tenant_id"), "entity_id", "signal_type", "obs_id", F.col("observed_at").alias("detected_at"))
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.dedup_signals_stream(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    keys = ["entity_id", "signal_type", "signal_day"]
    assert spark.table("days").count() == s.withColumn("signal_day", F.to_date("detected_at")).select(*keys).distinct().count() == spark.table("days").select(*keys).distinct().count()


def test_late_signals_count(spark, tmp_path):
    schema = "tenant_id string, entity_id long, signal_type string, detected_at timestamp"
    days = ["2024-01-20 10:00:00", "2024-01-21 10:00:00", "2024-01-01 09:00:00", "2024-01-21 23:00:00"]
    for d in days:  # one file after the other, the oldest day comes late
        spark.createDataFrame([("t", 1, "funding", d)], "tenant_id string, entity_id long, signal_type string, d string").selectExpr(
            "tenant_id", "entity_id", "signal_type", "CAST(d AS timestamp) AS detected_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.dedup_signals_stream(stream).writeStream.format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert spark.table("late").count() == 3


def test_source_sync_only_adds(spark, tmp_path):
    schema = "path string, text string"
    path = str(tmp_path / "in")
    stored = chunk_documents(spark.createDataFrame([("old.md", "# Stored")], schema), "path", "text").select(F.lit("default").alias("tenant_id"), "source_hash")
    sync = lambda: run(jobs.sync_source_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), stored), tmp_path)
    spark.createDataFrame([("a.md", "# One\nbody"), ("b.md", "# Two"), ("c.md", "# Two"), ("d.md", "# Stored")], schema).coalesce(1).write.mode("append").parquet(path)
    assert sync().count() == 2
    spark.createDataFrame([("a.md", "# One\nbody"), ("b.md", "# Two changed")], schema).coalesce(1).write.mode("append").parquet(path)
    assert sorted(r.content for r in sync().collect()) == ["# One\nbody", "# Two", "# Two changed"]


def test_lifecycle_equals_tracking_runs(spark, tmp_path):
    """Leads, events and campaigns; the stream gives what ``track`` gives run by run, whatever the cut into batches."""
    v, gap = Views(spark, SF), timedelta(days=4)
    start = datetime(2024, 3, 1)
    at = lambda day, hour=9: F.lit(start + timedelta(days=day, hours=hour)).cast("timestamp")
    i = F.col("lead_id")
    # 120 leads of their own people in four campaigns: calendar and business days, one window that most runs miss
    leads = v.campaign_leads.filter("lead_id <= 480").withColumns({"provider_id": F.concat(F.lit("p"), i), "linkedin_url": F.lit(None).cast("string"), "email": F.concat(F.lit("E"), i, F.lit("@X.com")), "campaign_id": i % 4})
    status = F.element_at(F.lit(["Queued", "Connect_Sent", "Connected", "DM1_Sent", "DM2_Sent"]), (i % 5 + 1).cast("int"))
    days_ago = lambda n: F.timestamp_add("DAY", (-(i % n)).cast("int"), at(0))
    leads = leads.withColumns({
        "lifecycle_status": status, "connect_sent_at": F.when(status != "Queued", days_ago(29)), "connected_at": F.when(status.isin("Connected", "DM1_Sent", "DM2_Sent"), days_ago(7)),
        "dm1_sent_at": F.when(status.isin("DM1_Sent", "DM2_Sent"), days_ago(6)), "dm2_sent_at": F.when(status == "DM2_Sent", days_ago(13)), "replied_at": F.lit(None).cast("timestamp"),
        "email_campaign_id": F.when(i % 3 == 0, "ec"), **{c: F.lit(None).cast("timestamp") for c in ("email_replied_at", "email_opened_at", "email_sent_at", "email_bounced_at")},
    }).cache()
    k = F.col("id")
    campaigns = spark.range(4).select(
        k.alias("campaign_id"), F.lit("active").alias("status"), F.lit("UTC").alias("timezone"), F.lit("2024-01-01").alias("start_at"), F.when(k % 2 == 0, "calendar").otherwise("business").alias("delay_mode"),
        F.when(k == 3, F.lit([1, 2])).when(k == 1, F.lit([1, 2, 3, 4, 5])).otherwise(F.lit([1, 2, 3, 4, 5, 6, 7])).alias("active_days"), F.lit("00:00").alias("window_start"), F.lit("24:00").alias("window_end"), F.lit(0).alias("daily_limit"))
    variants = leads.select("tenant_id", "variant_id").distinct().selectExpr("tenant_id", "variant_id", "'Hello {{first_name}}.' AS connect_note", "'Hello {{first_name}}, how do you plan next quarter?' AS dm1_template",
        "IF(variant_id % 2 = 0, 'Hello {{first_name}}, shall we compare numbers?', '') AS dm2_template")
    rng, rows = random.Random(2), []
    ids = [r.lead_id for r in leads.select("lead_id").collect()]
    for n in range(160):
        lead, kind, day = rng.choice(ids), rng.choice(["accepted", "replied", "email"]), rng.uniform(0.1, 23.5)
        status_of = rng.choice([("bounced", 0, 0), ("active", 0, 0), ("active", 0, 1), ("active", 1, 1)])
        when = start + timedelta(days=day)
        rows.append((lead, kind, when, n, status_of[0], None, when if status_of[1] else None, when if status_of[2] else None))
    events = spark.createDataFrame(rows, EVENT).cache()
    # batch form: every fourth day, all relations and chats so far, the email statuses since the run before
    now, current = start, leads
    blocklist = v.blocklist.limit(0)
    for n in range(1, 7):
        before, now = now, start + gap * n
        past = events.filter(F.col("at") <= F.lit(now))
        relations = past.filter("kind = 'accepted'").select(F.concat(F.lit("p"), "lead_id").alias("provider_id"))
        wrote = past.filter("kind = 'replied'").select(F.col("event_no").alias("chat_id"), F.concat(F.lit("p"), "lead_id").alias("attendee_id"))
        chats = wrote.withColumn("sender_id", F.col("attendee_id"))
        mails = past.filter((F.col("kind") == "email") & (F.col("at") > F.lit(before))).select(F.col("event_no").alias("status_no"), F.concat(F.lit("e"), "lead_id", F.lit("@x.com")).alias("email"), "status", "bounced_at", "replied_at", "opened_at")
        snapshot, no_caps = current.select(*leads.columns), {"linkedin.dm": 10**6, "linkedin.connect": 10**6}
        moved = next_snapshot(snapshot, track(snapshot, campaigns, variants, relations, chats, blocklist, F.lit(now), limits=no_caps), F.lit(now))
        current = cut_lineage(apply_email_status(moved, mails, F.lit(now)))
    want = {r.lead_id: (r.lifecycle_status, r.email_status) for r in current.collect()}
    # stream form: the same events in three files, out of order inside, and one event behind all runs to move the watermark
    fit = leads.join(campaigns.drop("status", "start_at", "daily_limit"), "campaign_id").withColumns({
        "blocked": F.lit(False), "dm1_fit": F.lit(True), "dm2_fit": F.col("variant_id") % 2 == 0, "has_email": F.col("email_campaign_id").isNotNull()})
    states = lead_states(fit, F.lit(start))
    path = str(tmp_path / "in")
    for low, high in ((0, 7), (7, 15), (15, 25)):
        part = events.filter(F.col("at").between(F.lit(start + timedelta(days=low)), F.lit(start + timedelta(days=high))))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(-1, "end", start + timedelta(days=24, seconds=1), 10**6, None, None, None, None)], EVENT).coalesce(1).write.mode("append").parquet(path)
    stream = stream_of(spark, events, path).withWatermark("at", "0 seconds")
    changes = run(lifecycle_stream(stream, states, start, gap), tmp_path).collect()
    got = {r.lead_id: (r.lifecycle_status, r.email_status) for r in leads.collect()}
    for r in sorted(changes, key=lambda r: r.run_at):
        got[r.lead_id] = (r.lifecycle_status, r.email_status)
    assert got == want
    assert {"accepted", "replied", "dm1", "dm2", "expired"} <= {r.action for r in changes} and any(r.email_changed for r in changes)
