import pytest

from leadspan.checking import compare, connect
from leadspan.llm import urls
from leadspan.llm.catalog import ORACLES, QUERIES
from tests.conftest import SF

URLS = [
    (1, "http://www.EXAMPLE.com/en/x?a=/en/", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "https://example.com/de/#x", "example.com", "/de/", "com/", "allow"),
    (4, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    (5, "http://x.net", "x.net", "", None, None),
    (6, "notexample.com/en/", "", "", None, None),
    (7, None, "", "", None, None),
    (8, "ftp://com", "com", "", None, None),
    (9, "a://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (10, "http://ÄB.org/é", "Äb.org", "/é", None, None),
    (11, "http://b.org/?u=c://d.net/es/", "b.org", "/", None, None),
    (11, "http://b.org/?u=c://d.net/es/", "b.org", "/", None, None),
]


def test_query_against_sql(spark):
    df = QUERIES["op7_url_filter"](spark, SF)
    assert compare(df, connect(SF), ORACLES["op7_url_filter"]) == []
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_rules_and_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u, *_ in URLS], "page_id bigint, url string, host string, listed int")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()), key=repr)
    listed = {"x.net"}  # one of its two pages is blocked by a rule
    want = [(i, h, p, rule, verdict or ("block" if h in listed else "allow")) for i, _, h, p, rule, verdict in URLS]
    assert got == sorted(want, key=repr)
    assert urls.judge(pages.limit(0)).collect() == []


@pytest.mark.parametrize("shard_keys, literal_bytes", [(1 << 16, 1 << 24), (60, 1 << 24), (60, 0)])
def test_cascade_is_exact_over_its_universe(spark, shard_keys, literal_bytes):
    universe = spark.range(3000).selectExpr("concat('host', id, '.org') AS key", "id % 7 = 0 AS listed")
    cascade = urls.build(universe, shard_keys, literal_bytes)
    assert len(cascade.levels) > 1 and (cascade.shards > 1) == (shard_keys == 60)
    answered = urls.is_listed(universe.withColumnRenamed("listed", "truth"), "key", cascade, "listed", literal_bytes)
    assert answered.count() == 3000 and answered.filter("listed <> truth").isEmpty()


def test_cascade_without_listed_keys(spark):
    universe = spark.range(50).selectExpr("cast(id AS string) AS key", "false AS listed")
    assert urls.is_listed(universe.select("key"), "key", urls.build(universe)).filter("listed").isEmpty()
    assert urls.build(universe.limit(0)).levels
