"""Row functions against plain Python or fixed examples."""

import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from leadspan.functions import conditions as C
from leadspan.functions import messages as M
from leadspan.functions import normalize as N
from leadspan.functions import schedule as SC
from leadspan.functions import similarity as SIM
from leadspan.functions.stats import ab_test, pearson
from leadspan.operators.reports import declare_winner, previous_month


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_name_form_of_every_character(spark):
    import re

    chars = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c <= 0xDFFF and c != 0x130]
    texts = ["".join(chars[i:i + 50]) + " Müller" for i in range(0, len(chars), 50)] + ["Müller", "  Ana  María ", "", None]
    got = [r[0] for r in values(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string", N.norm_name(F.col("t")))]

    def want(t):
        flat = unicodedata.normalize("NFKD", (t or "").lower())
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9]", " ", flat)).strip()

    assert got == [want(t) for t in texts]
    assert want("Müller") == "mu ller"


def test_profile_urls(spark):
    rows = [
        ("https://www.linkedin.com/in/John-Doe/?trk=1", "https://www.linkedin.com/in/john-doe"), ("http://other.host/pub/X#a", "https://www.linkedin.com/in/x"),
        ("linkedin.com/in/Jane/about", "https://www.linkedin.com/in/jane"), ("", ""), (None, ""), ("John", "https://www.linkedin.com/in/john"), ("/x", ""),
    ]
    assert [r[0] for r in values(spark, rows, "u string, w string", N.norm_linkedin(F.col("u")))] == [w for _, w in rows]


def test_urls_domains_companies(spark):
    got = values(
        spark, [("https://www.Acme.com/A/b/?q=1#x", "The Co", "Acme Inc.")], "u string, only string, c string",
        N.norm_url(F.col("u")), N.norm_domain(F.col("u")), N.norm_company(F.col("only")), N.norm_company(F.col("c")), N.email_domain(F.lit("a@b@c")), N.company_key(F.col("c"), F.lit("www.Acme.com")),
    )
    assert got == [("acme.com/a/b", "acme.com", "the co", "acme", "", "acme|acme.com")]


def test_names(spark):
    rows = [("José García", "jose garcia", 1.0), ("Ann Lee", "Annabel Leeson", 0.9), ("Ann Mary Lee", "ann x lee", 0.85), ("Ann", "Anna", 0.0), ("A B", "C D", 0.0)]
    assert [r[0] for r in values(spark, rows, "a string, b string, s double", SIM.name_match(F.col("a"), F.col("b")))] == [r[2] for r in rows]


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 0.0]), ([1.0, 1.0], [-1.0, -1.0])]
    got = [r[0] for r in values(spark, rows, "a array<double>, b array<double>", SIM.cosine(F.col("a"), F.col("b")))]
    assert got[:3] == [0.0, 0.0, None] and abs(got[3] + 1) < 1e-12


@pytest.mark.parametrize("text, broken, fixed", [
    ("I think signals matter", ["no-signal", "no-start-with-i"], "Hello, i think indicator matter"),
    ("Hi Bob - see Clay.com", ["no-dash-punctuation", "start-with-hello", "no-company-tld"], "Hello Bob. see Clay"),
    ("Hello Bob, could we talk on Monday?", [], "Hello Bob, could we talk on Monday?"),
    ("AI-native teams. Let me know your thoughts", ["specific-cta"], "AI-native teams. Let me know your thoughts"),
    ("Full disclosure: nice to connect", ["no-disclaimers", "no-connect-filler"], "Full disclosure: nice to connect"),
    ("Hidden gem", [], "Hidden gem"),
])
def test_message_rules(spark, text, broken, fixed):
    df = spark.createDataFrame([(text,)], "t string")
    v = M.validate_messages(df, "t").first()
    assert v.violations == broken and v.valid == (not broken)
    assert M.fix_messages(df, "t").first().fixed_text == fixed


def test_significance(spark):
    rows = [(1000, 50, 1000, 10), (1000, 50, 1000, 48), (0, 0, 10, 5), (500, 25, 500, 25), (29, 20, 29, 1), (10, 0, 10, 0)]
    t = ab_test(*(F.col(c) for c in "abcd"))
    got = values(spark, rows, "a int, b int, c int, d int", t["significant"], t["winner"], t["p_value"], t["lift_percent"], t["min_sample"])
    assert got[0][:2] == (True, "A") and got[0][2] < 0.001 and abs(got[0][3] - 400) < 1e-9
    assert got[1][0] is False and got[2] == (False, None, 1.0, 0.0, 30)
    assert got[3][3] == 0.0 and got[3][4] == 100 and got[4][0] is False and got[5] == (False, None, 1.0, 0.0, 30)


def test_correlation_needs_variance_and_three(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 5, 1.0), ("b", 5, 0.0), ("b", 5, 0.5), ("c", 1, 0.0), ("c", 2, 0.5), ("c", 3, 1.0)], "g string, x int, y double")
    got = {r.g: r.p for r in df.groupBy("g").agg(pearson(F.col("x"), F.col("y")).alias("p")).collect()}
    assert got == {"a": None, "b": None, "c": 1.0}


def test_winner_rules(spark):
    rows = [(1, 1, "A", 20, 30.0), (1, 2, "B", 20, 20.0), (2, 3, "A", 20, 29.0), (2, 4, "B", 20, 20.0), (3, 5, "A", 20, 5.0), (3, 6, "B", 15, 0.0), (4, 7, "A", 20, 5.0), (4, 8, "B", 14, 0.0), (5, 9, "A", 20, 0.0), (5, 10, "B", 20, 0.0)]
    got = {r.campaign_id: (r.winner, r.margin_percent) for r in declare_winner(spark.createDataFrame(rows, "campaign_id int, variant_id int, name string, dms_sent int, reply_rate double")).collect()}
    assert got == {1: ("A", 50), 3: ("A", 100)}
    assert previous_month("2024-01") == "2023-12" and previous_month("2024-07") == "2024-06"


def test_send_window(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    days = F.array(*[F.lit(d) for d in range(1, 6)])
    look = lambda s: SC.send_window(at(s), F.lit("Europe/Paris"), days, F.lit("09:00"), F.lit("18:00"))
    cols = [c for s in ("2026-04-03 07:00:00", "2026-04-03 06:59:00", "2026-04-03 16:00:00", "2026-04-04 10:00:00") for c in look(s)]
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    assert [r[0], r[2], r[4], r[6]] == [True, False, False, False]
    assert r[3] == "current: Fri 08:59 Europe/Paris, window: 09:00-18:00" and r[7] == "Sat is not an active day (active: Mon,Tue,Wed,Thu,Fri)"


def test_business_delay(spark):
    friday = datetime.datetime(2026, 4, 3, 10)
    days = F.array(*[F.lit(d) for d in range(1, 6)])
    due = lambda d, now, active=days, mode="business": SC.delay_elapsed(F.col("t"), d, F.lit(mode), active, F.lit("UTC"), F.lit(now).cast("timestamp"))
    none = F.slice(days, 1, 0)
    got = values(
        spark, [(friday,)], "t timestamp", due(2, "2026-04-07 10:00:00"), due(2, "2026-04-07 09:59:59"), due(0, "2026-04-03 10:00:00"), due(2, "2030-01-01", none), due(2, "2026-04-05 10:00:00", mode="calendar")
    )
    assert got == [(True, False, True, False, True)]


def test_row_conditions(spark):
    df = spark.createDataFrame([(1, 60.0, "a@x.com", ["vip"], ("Paris",)), (2, None, None, None, None), (3, 40.0, "b@x.com", ["x"], ("Rome",))], "id int, score double, email string, tags array<string>, place struct<city:string>")
    ids = lambda t: sorted(r.id for r in C.where_condition(df, t).collect())
    assert ids("score >= 50 AND email exists") == [1]
    assert ids("score != 40") == [1, 2] and ids("score == 40") == [3]
    assert ids("tags contains vip OR place.city == 'Rome'") == [1, 3]
    assert ids("missing != 5") == [1, 2, 3] and ids("missing == 5") == [] and ids("email > 3") == []
    assert ids("email contains 'X.COM'") == [1, 3] and ids("place.city == \"a AND b\"") == []
    for bad in ("", "(score > 1)", "score"):
        with pytest.raises(ValueError):
            C.condition(df, bad)


def test_step_conditions(spark):
    cols = "connected_at connect_sent_at dm1_sent_at dm2_sent_at replied_at email_sent_at email_opened_at email_replied_at email_bounced_at".split()
    row = spark.createDataFrame([(1,)], "id int").select(*[F.lit("2024-01-01" if c in ("connected_at", "email_sent_at") else None).cast("timestamp").alias(c) for c in cols]).withColumn("states", C.channel_states())
    check = lambda t: row.select(C.step_condition(t).alias("x")).first().x
    assert check("") and check(None) and check("connected_linkedin AND !replied_any") and check("!replied_email AND (opened_email OR sent_email)")
    assert not check("no_such_name") and not check("! AND sent_email") and check("opened_email AND replied_email OR sent_email")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_field_names_are_cleaned_once(spark):
    from leadspan.functions.similarity import field_sim

    df = spark.createDataFrame([("First Name", "first_name"), ("Name", "Full Name"), ("Mobile", "Mobility"), (None, "x")], "a string, b string")
    out = df.select(field_sim(F.col("a"), F.col("b")).alias("s"))
    assert [round(r.s, 6) for r in out.collect()] == [1.0, 0.85, round(2 * 4 / (5 + 7), 6), 0.85]
    assert plan_of(out).count("regexp_replace(") <= 8


def test_keyword_query_reads_tokens_once(spark):
    from leadspan.catalog import load_all

    assert plan_of(load_all()[0]["keyword_score"](spark, "/root/testdata/sf0.001")).count("split(") <= 2
