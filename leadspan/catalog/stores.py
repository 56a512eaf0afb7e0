"""Queries for insights, data quality, providers, preferences and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadspan.catalog import snippets as S
from leadspan.catalog.registry import now, query
from leadspan.operators import insights as I
from leadspan.operators import preferences as P
from leadspan.operators import providers as V
from leadspan.operators import quality as Q
from leadspan.operators import reviews as W
from leadspan.operators.ranking import latest_by


BIAS_SQL = """bias AS (SELECT insight_id, count(*) AS evidence_count, CAST(sum(sample_size) AS BIGINT) AS sample_size, count(DISTINCT source_id) >= 2 AS balanced,
    CASE WHEN count(*) >= 2 THEN CAST(floor((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 8.64e10 + 0.5) AS BIGINT) ELSE 0 END AS span_days FROM evidence GROUP BY 1),
    scored AS (SELECT *, least(least(evidence_count * 10, 40) + CASE WHEN evidence_count >= 2 THEN least(span_days, 30) ELSE 0 END + CASE WHEN sample_size >= 30 AND balanced AND span_days >= 14 THEN 30 ELSE 0 END, 100) AS confidence_score FROM bias)"""


@query("bias_check", f"WITH {BIAS_SQL} SELECT insight_id, evidence_count, sample_size, balanced, span_days FROM bias", ("evidence",))
def _(v):
    return I.bias_check(v.evidence).drop("first_at", "last_at")


@query("accumulate_evidence", f"WITH {BIAS_SQL} SELECT insight_id, evidence_count, confidence_score FROM scored", ("evidence",))
def _(v):
    return I.accumulate_evidence(v.evidence).select("insight_id", "evidence_count", "confidence_score")


@query("promote_insights", f"""WITH {BIAS_SQL}, j AS (SELECT i.insight_id, i.confidence, coalesce(s.evidence_count, 0) AS n, s.insight_id IS NOT NULL AS known, s.sample_size, s.balanced, s.span_days, coalesce(s.sample_size >= 30 AND s.balanced AND s.span_days >= 14, false) AS ok FROM insights i LEFT JOIN scored s ON s.insight_id = i.insight_id)
    SELECT insight_id, CASE confidence WHEN 'hypothesis' THEN n >= 2 WHEN 'validated' THEN ok ELSE false END AS promote, CASE confidence WHEN 'hypothesis' THEN CASE WHEN n >= 2 THEN 'Has 2+ evidence entries — ready for validated' ELSE 'Only ' || n || ' evidence entry (need 2+)' END
      WHEN 'validated' THEN CASE WHEN ok THEN 'Bias check passed — ready for proven' WHEN known THEN 'Bias check incomplete: sample=' || sample_size || ', balanced=' || balanced || ', span=' || span_days || 'd' ELSE 'No bias check performed yet' END ELSE 'Already at highest confidence level' END AS reason FROM j""", ("evidence", "insights"))
def _(v):
    return I.promotion(v.insights, v.evidence).select("insight_id", "promote", "reason")


@query("intelligence_cycle", f"""WITH {BIAS_SQL}, j AS (SELECT i.insight_id, i.confidence, coalesce(s.evidence_count, 0) AS n, coalesce(s.confidence_score, 0) AS confidence_score, coalesce(s.sample_size >= 30 AND s.balanced AND s.span_days >= 14, false) AS ok FROM insights i LEFT JOIN scored s ON s.insight_id = i.insight_id)
    SELECT insight_id, confidence_score, CASE WHEN confidence = 'hypothesis' AND n >= 2 THEN 'validated' WHEN confidence = 'validated' AND ok THEN 'proven' ELSE confidence END AS confidence FROM j""", ("evidence", "insights"))
def _(v):
    return I.intelligence_cycle(v.insights, v.evidence, now()).select("insight_id", "confidence_score", "confidence")


@query("expired_insights", f"SELECT insight_id FROM insights WHERE expires_at < {S.NOW}", ("insights",))
def _(v):
    from leadspan.functions.scoring import is_expired

    return v.insights.filter(is_expired(F.col("expires_at"), now())).select("insight_id")


@query("insights_for_prompt", """WITH segs AS (SELECT DISTINCT tenant_id, segment FROM insights WHERE segment IS NOT NULL),
    r AS (SELECT s.tenant_id, s.segment, i.confidence, i.insight_id, row_number() OVER (PARTITION BY s.tenant_id, s.segment, i.confidence ORDER BY i.confidence_score DESC, i.insight_id) AS rn
      FROM segs s JOIN insights i ON i.tenant_id = s.tenant_id AND (i.segment = s.segment OR i.segment IS NULL) WHERE i.confidence IN ('proven', 'validated'))
    SELECT tenant_id, segment, confidence, insight_id, rn FROM r WHERE rn <= CASE confidence WHEN 'proven' THEN 5 ELSE 3 END""", ("insights",))
def _(v):
    return I.insights_for_prompt(v.insights).select("tenant_id", "segment", "confidence", "insight_id", "rn")


@query("supersede_insights", f"""SELECT insight_id, strftime(CASE WHEN insight_id % 10 = 0 THEN {S.NOW} ELSE expires_at END, '%Y-%m-%d') AS expires_on, NULL::BIGINT AS supersedes FROM insights
    UNION ALL SELECT insight_id + 1000000000, NULL, insight_id FROM insights WHERE insight_id % 10 = 0""", ("insights",))
def _(v):
    new = v.insights.filter("insight_id % 10 = 0").select((F.col("insight_id") + 1000000000).alias("insight_id"), F.col("insight_id").alias("supersedes"))
    return I.supersede(v.insights, new, now()).select("insight_id", F.date_format("expires_at", "yyyy-MM-dd").alias("expires_on"), "supersedes")


def result_rows(v):
    fields = ("company_name", "website", "email", "phone", "title", "city")
    data = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])
    return v.result_rows.select("result_set_id", "row_index", F.when(~F.col("is_null_row"), data).alias("data"))


@query("cross_set_dupes", f"""WITH k AS (SELECT result_set_id, {S.company_key('company_name', 'website')} AS key FROM result_rows WHERE NOT is_null_row)
    SELECT a.result_set_id, o.result_set_id AS other_set_id, count(*) AS duplicate_count, CASE WHEN count(*) > 5 THEN 'warning' ELSE 'info' END AS severity
    FROM k a JOIN (SELECT DISTINCT result_set_id, key FROM k) o ON o.key = a.key AND o.result_set_id <> a.result_set_id GROUP BY 1, 2""", ("result_rows",))
def _(v):
    return Q.cross_set_dupes(result_rows(v))


COMPLETE_SQL = """miss AS (SELECT result_set_id, row_index, is_null_row, unnest(['company_name', 'website', 'email', 'phone', 'title', 'city']) AS field, unnest([company_name, website, email, phone, title, city]) AS val FROM result_rows),
    per_row AS (SELECT result_set_id, row_index, is_null_row, count(CASE WHEN val <> '' THEN 1 END) / 6.0 AS filled FROM miss GROUP BY 1, 2, 3),
    counts AS (SELECT result_set_id, count(*) AS row_count, count(CASE WHEN is_null_row OR filled < 0.4 THEN 1 END) AS critical_rows, count(CASE WHEN NOT is_null_row AND filled >= 0.4 AND filled < 0.6 THEN 1 END) AS warning_rows FROM per_row GROUP BY 1),
    fields AS (SELECT result_set_id, field, count(*) AS n, row_number() OVER (PARTITION BY result_set_id ORDER BY count(*) DESC, field) AS rn FROM miss WHERE NOT is_null_row AND coalesce(val, '') = '' GROUP BY 1, 2),
    tops AS (SELECT result_set_id, string_agg(field || ' (' || n || ' rows)', ', ' ORDER BY rn) AS top_missing FROM fields WHERE rn <= 5 GROUP BY 1),
    complete AS (SELECT c.*, t.top_missing, CASE WHEN critical_rows > 0 THEN 'critical' WHEN warning_rows > 0 THEN 'warning' END AS severity FROM counts c LEFT JOIN tops t ON t.result_set_id = c.result_set_id)"""


@query("completeness", f"WITH {COMPLETE_SQL} SELECT * FROM complete", ("result_rows",))
def _(v):
    return Q.completeness(result_rows(v))


@query("match_rate_anomaly", """WITH r AS (SELECT campaign_id, count(CASE WHEN qualification_score >= 65 THEN 1 END) * 100.0::DOUBLE / count(*) AS match_rate FROM campaign_leads GROUP BY 1)
    SELECT campaign_id, round(match_rate, 6) AS match_rate, CASE WHEN match_rate < 15 THEN 'critical' WHEN match_rate < 30 THEN 'warning' END AS severity FROM r""", ("campaign_leads",))
def _(v):
    rates = v.campaign_leads.groupBy("campaign_id").agg((F.count(F.when(F.col("qualification_score") >= 65, 1)) * 100.0 / F.count(F.lit(1))).alias("match_rate"))
    return Q.anomaly(rates).withColumn("match_rate", F.round("match_rate", 6))


SETS_SQL = "sets AS (SELECT s_name AS result_set_id, TIMESTAMP '2024-10-15 00:00:00' + to_days(CAST(s_suppkey % 90 AS INTEGER)) AS created_at FROM supplier UNION ALL SELECT * FROM (VALUES ('customers', TIMESTAMP '2024-10-01'), ('parts_a', TIMESTAMP '2024-11-20'), ('parts_b', TIMESTAMP '2024-12-30')) x)"


def _sets(v):
    own = v.supplier.select(F.col("s_name").alias("result_set_id"), F.timestamp_add("DAY", (F.col("s_suppkey") % 90).cast("int"), F.lit("2024-10-15").cast("timestamp")).alias("created_at"))
    named = v.spark.createDataFrame([("customers", "2024-10-01"), ("parts_a", "2024-11-20"), ("parts_b", "2024-12-30")], "result_set_id string, d string")
    return own.unionByName(named.select("result_set_id", F.col("d").cast("timestamp").alias("created_at")))


@query("freshness", f"""WITH {SETS_SQL}, a AS (SELECT result_set_id, CAST(floor((epoch_us({S.NOW}) - epoch_us(created_at)) / 8.64e10) AS BIGINT) AS age_days FROM sets)
    SELECT *, CASE WHEN age_days > 60 THEN 'critical' WHEN age_days > 30 THEN 'warning' END AS severity FROM a""")
def _(v):
    return Q.freshness(_sets(v), now()).drop("created_at")


ISSUES_SQL = f"""{COMPLETE_SQL}, {SETS_SQL}, k AS (SELECT result_set_id, {S.company_key('company_name', 'website')} AS key FROM result_rows WHERE NOT is_null_row),
    dup AS (SELECT a.result_set_id, o.result_set_id AS other, count(*) AS n FROM k a JOIN (SELECT DISTINCT result_set_id, key FROM k) o ON o.key = a.key AND o.result_set_id <> a.result_set_id GROUP BY 1, 2),
    age AS (SELECT result_set_id, CAST(floor((epoch_us({S.NOW}) - epoch_us(created_at)) / 8.64e10) AS BIGINT) AS d FROM sets),
    issues AS (SELECT result_set_id, 'duplicate' AS check_type, CASE WHEN n > 5 THEN 'warning' ELSE 'info' END AS severity, 'Found ' || n || ' duplicates from "' || other || '". Merge and use most recent data?' AS nudge FROM dup
      UNION ALL SELECT result_set_id, 'completeness', severity, CASE WHEN severity = 'critical' THEN critical_rows || ' rows are missing key fields: ' || coalesce(top_missing, '') || '. Enrich with a provider?' ELSE warning_rows || ' rows have incomplete data. Consider enriching missing fields.' END FROM complete WHERE severity IS NOT NULL
      UNION ALL SELECT result_set_id, 'freshness', CASE WHEN d > 60 THEN 'critical' ELSE 'warning' END, 'Data is ' || d || CASE WHEN d > 60 THEN ' days old. Re-enrich to get current information?' ELSE ' days old. Consider re-enriching for accuracy.' END FROM age WHERE d > 30)"""


@query("data_quality", f"WITH {ISSUES_SQL} SELECT * FROM issues", ("result_rows",))
def _(v):
    return Q.data_quality(result_rows(v), _sets(v), now())


@query("quality_reviews", f"WITH {ISSUES_SQL} SELECT 'data_quality' AS type, 'Data Quality: ' || check_type || ' — ' || severity AS title, nudge AS description, result_set_id AS source_id, 'high' AS priority, 'pending' AS status FROM issues WHERE severity = 'critical'", ("result_rows",))
def _(v):
    return Q.review_rows(Q.data_quality(result_rows(v), _sets(v), now()))


CARD_SQL = """card AS (SELECT provider_id{by}, coalesce(sum(CASE WHEN metric = 'accuracy' THEN value * coalesce(sample_size, 1) END) / nullif(sum(CASE WHEN metric = 'accuracy' THEN coalesce(sample_size, 1) END), 0), 0) AS accuracy,
    coalesce(sum(CASE WHEN metric = 'latency_ms' THEN value * coalesce(sample_size, 1) END) / nullif(sum(CASE WHEN metric = 'latency_ms' THEN coalesce(sample_size, 1) END), 0), 0) AS avg_latency_ms,
    coalesce(sum(CASE WHEN metric = 'cost_per_call' THEN value * coalesce(sample_size, 1) END) / nullif(sum(CASE WHEN metric = 'cost_per_call' THEN coalesce(sample_size, 1) END), 0), 0) AS avg_cost_per_call,
    coalesce(sum(CASE WHEN metric = 'coverage' THEN value * coalesce(sample_size, 1) END) / nullif(sum(CASE WHEN metric = 'coverage' THEN coalesce(sample_size, 1) END), 0), 0) AS coverage_score, count(*) AS sample_size
    FROM provider_stats GROUP BY provider_id{by})"""


@query("provider_scorecard", f"WITH {CARD_SQL.format(by=', segment')} SELECT provider_id, segment, round(accuracy, 5) AS accuracy, round(avg_latency_ms, 4) AS avg_latency_ms, round(avg_cost_per_call, 6) AS avg_cost_per_call, round(coverage_score, 5) AS coverage_score, sample_size FROM card", ("provider_stats",))
def _(v):
    c = V.provider_scorecard(v.provider_stats, ("provider_id", "segment"))
    return c.select("provider_id", "segment", F.round("accuracy", 5).alias("accuracy"), F.round("avg_latency_ms", 4).alias("avg_latency_ms"), F.round("avg_cost_per_call", 6).alias("avg_cost_per_call"), F.round("coverage_score", 5).alias("coverage_score"), "sample_size")


@query("best_provider", f"""WITH {CARD_SQL.format(by='')}, s AS (SELECT provider_id, accuracy / 100 * 0.3 + CASE WHEN avg_cost_per_call > 0 THEN greatest(0, 1 - avg_cost_per_call) ELSE 1 END * 0.3 + greatest(0, 1 - avg_latency_ms / 10000) * 0.2 + least(1, coverage_score / 100) * 0.2 AS score FROM card),
    r AS (SELECT list(provider_id ORDER BY score DESC, provider_id) AS ids, max(score) AS top FROM s), p AS (SELECT * FROM provider_preferences QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY created_at DESC, pref_id DESC) = 1)
    SELECT skill_id, CASE WHEN source = 'user' THEN preferred_provider ELSE ids[1] END AS provider_id, CASE WHEN source = 'user' THEN 'user preference' ELSE 'Best score: ' || CAST(floor(top * 100 + 0.5) AS BIGINT) || '%' END AS reason,
      CASE WHEN source <> 'user' THEN ids[2] END AS alternative_1, CASE WHEN source <> 'user' THEN ids[3] END AS alternative_2 FROM p, r""", ("provider_stats", "provider_preferences"))
def _(v):
    return V.best_provider(v.provider_stats, v.provider_preferences)


@query("record_execution", """WITH r AS (SELECT o_custkey AS provider_id, o_orderpriority AS segment, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 100 END AS q, o_orderkey % 5000 AS lat, (o_orderkey % 70) / 100.0 AS cost, o_orderkey % 300 AS n FROM orders)
    SELECT provider_id, segment, metric, CAST(value AS DOUBLE) AS value, sample_size FROM (SELECT provider_id, segment, 'accuracy' AS metric, coalesce(q, 50) AS value, 1 AS sample_size FROM r UNION ALL SELECT provider_id, segment, 'latency_ms', lat, 1 FROM r UNION ALL SELECT provider_id, segment, 'cost_per_call', cost, 1 FROM r UNION ALL SELECT provider_id, segment, 'coverage', n, n FROM r) x""")
def _(v):
    k = F.col("o_orderkey")
    runs = v.orders.select(
        F.col("o_custkey").alias("provider_id"), F.col("o_orderpriority").alias("segment"), F.col("o_orderdate").alias("measured_at"), F.when(k % 4 != 0, k % 100).alias("quality_score"),
        (k % 5000).alias("latency_ms"), ((k % 70) / 100.0).alias("cost_estimate"), (k % 300).alias("row_count"),
    )
    return V.record_execution(runs).drop("measured_at")


CREDIT_SQL = """ops AS (SELECT event_id, ['company_identify', 'company_search_db', 'company_search_live', 'company_enrich', 'people_search_db', 'people_search_live', 'people_enrich', 'web_search'][event_id % 8 + 1] AS operation,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 700 END AS rc, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 9 END AS pc, event_id % 2 = 1 AS rt, event_id % 60 - 5 AS balance, CAST(floor(value) AS BIGINT) % 40 AS actual_cost FROM events),
    est AS (SELECT *, CAST(CASE operation WHEN 'company_identify' THEN 0 WHEN 'company_search_db' THEN 1 WHEN 'company_search_live' THEN 2 WHEN 'company_enrich' THEN CASE WHEN rt THEN 4 ELSE 1 END WHEN 'people_search_db' THEN greatest(3, ceil(coalesce(rc, 100) / 100) * 3)
      WHEN 'people_search_live' THEN 20 WHEN 'people_enrich' THEN coalesce(pc, 1) * 3 ELSE ceil(coalesce(rc, 10) / 10) END AS BIGINT) AS estimate FROM ops),
    usage AS (SELECT *, CAST(ceil(estimate * 1.5) AS BIGINT) AS needed, balance < 0 OR balance < ceil(estimate * 1.5) AS blocked, CASE WHEN estimate > 0 THEN CAST(floor(actual_cost / estimate + 0.5) AS BIGINT) ELSE 0 END AS ratio, CASE WHEN actual_cost > estimate * 3 THEN 'WARN' ELSE 'INFO' END AS level FROM est)"""


def _usage(v):
    e = F.col("event_id")
    kinds = ["company_identify", "company_search_db", "company_search_live", "company_enrich", "people_search_db", "people_search_live", "people_enrich", "web_search"]
    ops = v.events.select(
        "event_id", F.element_at(F.lit(kinds), (e % 8 + 1).cast("int")).alias("operation"), F.when(e % 3 != 0, e % 700).alias("result_count"),
        F.when(e % 5 != 0, e % 9).alias("person_count"), (e % 2 == 1).alias("realtime"), (e % 60 - 5).alias("balance"), (F.floor("value") % 40).alias("actual_cost"),
    )
    return V.credit_usage(ops)


@query("credit_usage", f"WITH {CREDIT_SQL} SELECT event_id, operation, estimate, needed, blocked, ratio, level FROM usage")
def _(v):
    return _usage(v).select("event_id", "operation", "estimate", "needed", "blocked", "ratio", "level")


@query("credit_totals", f"WITH {CREDIT_SQL} SELECT operation, count(*) AS calls, CAST(sum(estimate) AS BIGINT) AS estimated, CAST(sum(actual_cost) AS BIGINT) AS actual, CAST(sum(CASE WHEN blocked THEN 1 ELSE 0 END) AS BIGINT) AS blocked_calls, CAST(sum(CASE WHEN level = 'WARN' THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM usage GROUP BY 1")
def _(v):
    return V.credit_totals(_usage(v))


RULES_SQL = """long AS (SELECT sample_id, verdict, 'type' AS dimension, dim_type AS val FROM swipes UNION ALL SELECT sample_id, verdict, 'hour', dim_hour FROM swipes UNION ALL SELECT sample_id, verdict, 'tone', dim_tone FROM swipes),
    per AS (SELECT dimension, val, count(*) AS n, count(CASE WHEN verdict = 'like' THEN 1 END)::DOUBLE / count(*) AS rate, min(sample_id) AS first_at FROM long WHERE val <> '' GROUP BY 1, 2),
    b AS (SELECT dimension, count(*) AS vals, arg_max({'v': val, 'r': rate, 'n': n}, {'r': rate, 'f': first_at}) AS best, arg_max({'v': val, 'r': rate, 'n': n}, {'r': -rate, 'f': first_at}) AS worst FROM per GROUP BY 1),
    rules AS (SELECT *, (best.r - worst.r) * 100 AS spread FROM b WHERE vals >= 2 AND (best.r - worst.r) * 100 >= 30 AND ((best.r - worst.r) * 100 <= 60 OR (best.n >= 3 AND worst.n >= 3))),
    named AS (SELECT dimension, CASE WHEN spread > 60 THEN 'strong' ELSE 'mild' END AS strength, 'Prefer "' || best.v || '" ' || dimension || ' (' || CAST(floor(best.r * 100 + 0.5) AS BIGINT) || '% liked) over "' || worst.v || '" (' || CAST(floor(worst.r * 100 + 0.5) AS BIGINT) || '%)' AS description,
      CAST(floor(spread + 0.5) AS BIGINT) AS spread, best.v AS preferred_value, worst.v AS avoid_value FROM rules)"""
DIMENSIONS = ("type", "hour", "tone")


def _rules(v):
    return P.preference_rules(v.swipes, {d: F.col(f"dim_{d}") for d in DIMENSIONS})


@query("preference_rules", f"WITH {RULES_SQL} SELECT * FROM named", ("swipes",))
def _(v):
    return _rules(v)


@query("preference_learning", f"""WITH {RULES_SQL} SELECT 'content' AS category, '[copy] ' || description AS insight, 'validated' AS confidence, 'rlhf' AS source, 'preference' AS evidence_type, 'rl-copy' AS source_id, dimension AS metric, spread AS value, (SELECT count(*) FROM swipes) AS sample_size FROM named WHERE strength = 'strong'""", ("swipes",))
def _(v):
    total = v.swipes.agg(F.count(F.lit(1)).alias("n"))
    return P.preference_learning(_rules(v), total, "copy", now()).drop("observed_at")


@query("like_rate", "SELECT CAST(floor(count(CASE WHEN verdict = 'like' THEN 1 END)::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) AS like_rate, count(*) AS total_samples FROM swipes", ("swipes",))
def _(v):
    return P.like_rate(v.swipes)


@query("feedback_evidence", """WITH f AS (SELECT o_orderpriority AS result_set_id, CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'flagged' END END AS feedback FROM orders)
    SELECT result_set_id AS source_id, count(CASE WHEN feedback = 'approved' THEN 1 END) AS approved, count(CASE WHEN feedback = 'rejected' THEN 1 END) AS rejected, count(CASE WHEN feedback = 'flagged' THEN 1 END) AS flagged, count(feedback) AS sample_size FROM f GROUP BY 1""")
def _(v):
    fb = F.when(F.col("o_orderstatus") == "O", "approved").when(F.col("o_orderstatus") == "P", "rejected").when(F.col("o_orderkey") % 2 == 0, "flagged")
    rows = v.orders.select(F.col("o_orderpriority").alias("result_set_id"), fb.alias("feedback"))
    return I.feedback_evidence(rows, now()).select("source_id", "approved", "rejected", "flagged", "sample_size")


@query("review_order", "SELECT review_id, priority, CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END AS priority_rank FROM reviews WHERE status = 'pending'", ("reviews",))
def _(v):
    return W.review_order(v.reviews.filter("status = 'pending'")).select("review_id", "priority", F.col("priority_rank").cast("int").alias("priority_rank"))


@query("pending_counts", "SELECT tenant_id, count(*) AS total, count(CASE WHEN priority = 'urgent' THEN 1 END) AS urgent, count(CASE WHEN priority = 'high' THEN 1 END) AS high FROM reviews WHERE status = 'pending' GROUP BY 1", ("reviews",))
def _(v):
    return W.pending_counts(v.reviews)


@query("qualification_summary", "SELECT count(*) AS total_qualified, CAST(floor(avg(coalesce(qualification_score, 50)) + 0.5) AS BIGINT) AS average_score, count(CASE WHEN coalesce(qualification_score, 50) >= 70 THEN 1 END) AS high_score_count FROM campaign_leads", ("campaign_leads",))
def _(v):
    return W.qualification_summary(v.campaign_leads)


@query("latest_preference", "SELECT skill_id, segment, preferred_provider, source FROM provider_preferences QUALIFY row_number() OVER (PARTITION BY skill_id, segment ORDER BY created_at DESC, pref_id DESC) = 1", ("provider_preferences",))
def _(v):
    return latest_by(v.provider_preferences, ["skill_id", "segment"], F.struct("created_at", "pref_id")).select("skill_id", "segment", "preferred_provider", "source")
