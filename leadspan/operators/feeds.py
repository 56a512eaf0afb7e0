"""Which polled items are new: per-source watermark, urls already seen, repeats across feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.normalize import hash_url, text


def fresh_items(items: DataFrame, watermarks: DataFrame, seen: DataFrame) -> DataFrame:
    """Items to process. ``seen`` has ``url_hash``; ``items`` carries ``feed_order``, the order feeds are polled in.

    An undated item passes, a dated one must be strictly newer than its source's watermark. A url new in one feed is
    dropped from later feeds; repeats inside one feed stay.
    """
    hashed = items.withColumn("url_hash", F.when(text(F.col("link")) != "", hash_url(F.col("link"))))
    unseen = hashed.join(seen.select("url_hash").distinct(), "url_hash", "left_anti")
    marks = watermarks.select("source_key", F.col("last_published_at").alias("_mark"))
    dated = F.col("published_at").isNull() | F.col("_mark").isNull() | (F.col("published_at") > F.col("_mark"))
    new = unseen.join(marks, "source_key", "left").filter(dated).drop("_mark")
    owner = new.filter("url_hash IS NOT NULL").groupBy("url_hash").agg(F.min("feed_order").alias("_owner"))
    return new.join(owner, "url_hash", "left").filter(F.col("_owner").isNull() | (F.col("_owner") == F.col("feed_order"))).drop("_owner")


def next_watermarks(items: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Newest date of everything polled per source; a source without dated items keeps its old mark."""
    newest = items.groupBy("source_key").agg(F.max("published_at").alias("_new"))
    return watermarks.join(newest, "source_key", "full_outer").select("source_key", F.coalesce("_new", "last_published_at").alias("last_published_at")).filter(
        "last_published_at IS NOT NULL"
    )


def poll_report(items: DataFrame, fresh: DataFrame) -> DataFrame:
    total = items.groupBy("source_key").agg(F.count(F.lit(1)).alias("total_fetched"), F.max("published_at").alias("newest"))
    new = fresh.groupBy("source_key").agg(F.count(F.lit(1)).alias("new_items"))
    return total.join(new, "source_key", "left").fillna(0, ["new_items"])


def feed_order(source_key: Column, sources: list[str]) -> Column:
    return F.array_position(F.lit(sources), source_key)
