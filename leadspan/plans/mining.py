"""One discovery run: take pages until enough new people wait, deliver the oldest, fill in contacts, note companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspan.functions.normalize import norm_linkedin
from leadspan.operators.ledger import advance_cursor, filter_new, record_companies, take_backlog
from leadspan.operators.ranking import earliest_by


def taken_pages(found: DataFrame, fresh: DataFrame, waiting: int, target: int) -> DataFrame:
    """(query_no, page) read before the target was met. Keeping a row never depends on later rows, so the new people of
    every page can be counted first and the cut made afterwards. Page order comes from query totals, then pages within a query."""
    pages = found.groupBy("query_no", "page").agg(F.count(F.lit(1)).alias("fetched"))
    new = fresh.groupBy("query_no", "page").agg(F.count(F.lit(1)).alias("fresh"))
    p = pages.join(new, ["query_no", "page"], "left").fillna(0, ["fresh"])
    inside = Window.partitionBy("query_no").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("query_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per query of the run
    totals = p.groupBy("query_no").agg(F.sum("fresh").alias("_total")).select("query_no", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    placed = p.withColumn("_inside", F.coalesce(F.sum("fresh").over(inside), F.lit(0))).join(totals, "query_no")
    return placed.filter(F.col("_earlier") + F.col("_inside") + waiting < target).select(*p.columns)


def mine(
    profiles: DataFrame, ledger: DataFrame, contacts: DataFrame, companies: DataFrame, cursors: DataFrame, now: Column,
    target: int = 75, page_size: int = 100, page_budget: int | None = None,
) -> dict[str, DataFrame]:
    """``profiles``: the results of each query in order (query_no, query_hash, position from 0, ordinal, ...).

    ``page_budget`` limits the results read of one query, off by default. Returns the next ledger, the delivered leads, the companies, the cursors and the pages read.
    """
    within = profiles if page_budget is None else profiles.filter(F.col("position") < page_budget)
    paged = within.withColumn("page", F.floor(F.col("position") / page_size))
    fresh = filter_new(paged, ledger)
    waiting = ledger.filter("status = 'seen'").count()  # one number
    pages = taken_pages(paged, fresh, waiting, target)
    recorded = fresh.join(pages.select("query_no", "page"), ["query_no", "page"], "left_semi")
    new_rows = recorded.select(
        F.col("ordinal").alias("mined_id"), "rr_id", "linkedin_url", "name", "company_name", "company_domain", "title", now.alias("first_seen_at"), F.lit("seen").alias("status")
    )
    merged = ledger.unionByName(new_rows)
    due = take_backlog(merged, target)
    key = lambda: F.when(F.col("rr_id").isNotNull(), F.concat(F.lit("rr:"), "rr_id")).otherwise(F.concat(F.lit("li:"), norm_linkedin(F.col("linkedin_url"))))
    known = earliest_by(contacts.withColumn("_key", key()).select("_key", "contact_no", "email", "phone"), ["_key"], F.col("contact_no")).drop("contact_no")
    delivered = due.withColumn("_key", key()).join(known, "_key", "left").drop("_key")
    done = delivered.select("mined_id", F.when(F.col("rr_id").isNotNull(), "delivered").otherwise("enriched").alias("_status"))
    next_ledger = merged.join(done, "mined_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    runs = pages.join(paged.select("query_no", "query_hash").distinct(), "query_no").groupBy("query_hash").agg(
        F.max("query_no").alias("run_no"), F.sum("fetched").alias("fetched"), F.sum("fresh").alias("fresh"), F.bool_or(F.col("fetched") < page_size).alias("hit_end")
    ).withColumn("total_matches", F.lit(None).cast("bigint"))
    return {
        "ledger": next_ledger, "delivered": delivered, "companies": record_companies(due, companies, now, "mined_id"),
        "cursors": advance_cursor(cursors, runs), "pages": pages,
    }
