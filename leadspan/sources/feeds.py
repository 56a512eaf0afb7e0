"""RSS 2.0 and Atom documents (one per row) to feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.normalize import wide_trim

RSS = "channel struct<item: array<struct<title: string, link: string, guid: string, pubDate: string, `dc:date`: string, description: string>>>"
ATOM = (
    "entry array<struct<title: string, link: array<struct<_rel: string, _href: string>>, id: string, published: string, updated: string, "
    "summary: string, content: string>>"
)
DATE_PATTERNS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd"]


def feed_date(c: Column) -> Column:
    """Mail-style and ISO dates; anything else is null."""
    bare = F.regexp_replace(wide_trim(c), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in DATE_PATTERNS])


def parse_feeds(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows of ``raw`` (source_key, xml) exploded to items; documents that cannot be read give none."""
    body = F.regexp_replace(xml, r"^\s*<\?xml[^>]*\?>\s*", "")
    ok = lambda c: F.when(wide_trim(c) != "", wide_trim(c))
    docs = raw.withColumn("_b", body)
    rss = docs.filter(F.col("_b").rlike(r"^<rss[\s>]")).select("source_key", F.explode(F.from_xml("_b", RSS)["channel"]["item"]).alias("i"))
    a = rss.select(
        "source_key", F.coalesce(ok(F.col("i.title")), F.lit("")).alias("title"), F.coalesce(ok(F.col("i.link")), F.lit("")).alias("link"),
        F.coalesce(ok(F.col("i.guid")), ok(F.col("i.link")), F.lit("")).alias("guid"),
        feed_date(F.coalesce(ok(F.col("i.pubDate")), ok(F.col("i.`dc:date`")))).alias("published_at"), F.coalesce(ok(F.col("i.description")), F.lit("")).alias("summary"),
    )
    atom = docs.filter(F.col("_b").rlike(r"^<feed[\s>]")).select("source_key", F.explode(F.from_xml("_b", ATOM)["entry"]).alias("i"))
    has_href = F.filter("i.link", lambda x: x["_href"].isNotNull())
    alternate = F.filter(has_href, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    href = F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(has_href, F.lit(0))["_href"], F.lit(""))
    b = atom.select(
        "source_key", F.coalesce(ok(F.col("i.title")), F.lit("")).alias("title"), href.alias("link"), F.coalesce(ok(F.col("i.id")), href).alias("guid"),
        feed_date(F.coalesce(ok(F.col("i.published")), ok(F.col("i.updated")))).alias("published_at"),
        F.coalesce(ok(F.col("i.summary")), ok(F.col("i.content")), F.lit("")).alias("summary"),
    )
    return a.unionByName(b)
