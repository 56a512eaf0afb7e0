"""Ledgers of people, urls, companies and query cursors. Each step reads a snapshot and returns the next one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.normalize import hash_url, norm_domain, norm_linkedin, person_key, text
from leadspan.operators.ranking import earliest_by
from leadspan.session import cut_lineage

LOW_YIELD = 5
LOW_YIELD_RUNS = 3


def key_rows(df: DataFrame, row: str, keys: Mapping[str, Column]) -> DataFrame:
    """(row, key) for every non-empty key; the kind of key is part of the key."""
    pairs = F.array(*[F.when(text(c.cast("string")) != "", F.concat(F.lit(kind + ":"), c.cast("string"))) for kind, c in keys.items()])
    return df.select(F.col(row).alias("_row"), F.explode(F.array_compact(pairs)).alias("_key"))


def first_come(df: DataFrame, row: str, keys: Mapping[str, Column], seen: DataFrame | None = None) -> DataFrame:
    """Ids of the rows a one-by-one pass in ``row`` order would keep.

    A row is dropped when one of its keys is in ``seen`` (column ``_key``) or belongs to an earlier *kept* row; the
    other keys of a dropped row are not learned. Rounds: a row that comes first on all its keys is kept, every row
    sharing a key with it is dropped, the rest goes on. All steps are combinable aggregates and equi-joins, so a
    key shared by a third of all rows is settled in one round.
    """
    pairs = key_rows(df, row, keys)
    all_rows = df.select(F.col(row).alias("_row"))
    keyless = all_rows.join(pairs.select("_row").distinct(), "_row", "left_anti")
    if seen is not None:
        known = pairs.join(seen.select("_key").distinct(), "_key", "left_semi").select("_row").distinct()
        pairs = pairs.join(known, "_row", "left_anti")
    pairs = cut_lineage(pairs)
    kept = keyless
    while True:
        firsts = pairs.groupBy("_key").agg(F.min("_row").alias("_first"))
        winners = pairs.join(firsts, "_key").groupBy("_row").agg(F.bool_and(F.col("_row") == F.col("_first")).alias("_won"))
        fresh = cut_lineage(winners.filter("_won").select("_row"))
        if fresh.isEmpty():
            return kept.withColumnRenamed("_row", row)
        kept = kept.union(fresh)
        taken = pairs.join(fresh, "_row", "left_semi").select("_key").distinct()
        settled = pairs.join(taken, "_key", "left_semi").select("_row").distinct()
        pairs = cut_lineage(pairs.join(settled, "_row", "left_anti"))


def person_keys() -> dict[str, Column]:
    return {"rr": F.col("rr_id"), "li": norm_linkedin(F.col("linkedin_url")), "id": person_key(F.col("name"), F.col("company_name"))}


def filter_new(profiles: DataFrame, ledger: DataFrame, row: str = "ordinal") -> DataFrame:
    """Profiles not in the ledger and not repeated in the batch, first come first kept."""
    seen = key_rows(ledger.withColumn("_id", F.lit(0)), "_id", person_keys()).select("_key")
    return profiles.join(first_come(profiles, row, person_keys(), seen), row, "left_semi")


def unseen(profiles: DataFrame, ledger: DataFrame, row: str = "ordinal") -> DataFrame:
    """Only the look-up against the ledger, without in-batch repeats."""
    seen = key_rows(ledger.withColumn("_id", F.lit(0)), "_id", person_keys()).select("_key").distinct()
    known = key_rows(profiles, row, person_keys()).join(seen, "_key", "left_semi").select(F.col("_row").alias(row)).distinct()
    return profiles.join(known, row, "left_anti")


def add_blocklist(incoming: DataFrame, blocklist: DataFrame, row: str = "row_no") -> DataFrame:
    """Blocklist plus the incoming rows whose provider id and slug are both new; rows without either are left out."""
    keys = {"p": F.col("provider_id"), "s": F.col("linkedin_slug")}
    named = incoming.filter((text(F.col("provider_id")) != "") | (text(F.col("linkedin_slug")) != ""))
    seen = key_rows(blocklist.withColumn("_id", F.lit(0)), "_id", keys).select("_key")
    fresh = named.join(first_come(named, row, keys, seen), row, "left_semi")
    return blocklist.unionByName(fresh.drop(row), allowMissingColumns=True)


def record_urls(stored: DataFrame, entries: DataFrame, now: Column, order: str) -> DataFrame:
    """Next snapshot of seen urls: +1 per occurrence of a stored url, 1 for a new one however often it repeats."""
    batch = entries.filter(text(F.col("url")) != "").select(hash_url(F.col("url")).alias("url_hash"), F.col("url").alias("_url"), F.col(order).alias("_o"))
    grouped = batch.groupBy("url_hash").agg(F.count(F.lit(1)).alias("_n"), F.min_by("_url", "_o").alias("_url"))
    old = stored.select(hash_url(F.col("url")).alias("url_hash"), F.col("url").alias("_old_url"), F.col("times_seen").alias("_times"), F.col("last_seen_at").alias("_last"))
    j = old.join(grouped, "url_hash", "full_outer")
    known = F.col("_times").isNotNull()
    return j.select(
        "url_hash", F.coalesce("_old_url", "_url").alias("url"),
        F.when(known, F.col("_times") + F.coalesce("_n", F.lit(0))).otherwise(F.lit(1)).alias("times_seen"),
        F.when(F.col("_n").isNotNull(), now).otherwise(F.col("_last")).alias("last_seen_at"),
    )


def new_companies(profiles: DataFrame, companies: DataFrame, order: str) -> DataFrame:
    """First profile per company domain that is not stored yet."""
    named = profiles.select(norm_domain(F.col("company_domain")).alias("domain"), F.col("company_name").alias("name"), F.col(order).alias("_o")).filter("domain <> ''")
    return earliest_by(named, ["domain"], F.col("_o")).drop("_o").join(companies.select("domain"), "domain", "left_anti")


def record_companies(profiles: DataFrame, companies: DataFrame, now: Column, order: str) -> DataFrame:
    """Next company snapshot; a known domain only gets a new time, its people count stays."""
    touched = profiles.select(norm_domain(F.col("company_domain")).alias("domain")).filter("domain <> ''").distinct().withColumn("_hit", F.lit(True))
    kept = companies.join(touched, "domain", "left").withColumn("last_mined_at", F.when(F.col("_hit"), now).otherwise(F.col("last_mined_at"))).drop("_hit")
    fresh = new_companies(profiles, companies, order).select("domain", "name", F.lit(1).cast("bigint").alias("people_count"), now.alias("last_mined_at"))
    return kept.unionByName(fresh)


def backlog(people: DataFrame) -> DataFrame:
    return people.filter("status = 'seen'").agg(F.count(F.lit(1)).alias("backlog"))


def take_backlog(people: DataFrame, limit: int) -> DataFrame:
    """Oldest waiting people first."""
    return people.filter("status = 'seen'").orderBy("first_seen_at", "mined_id").limit(limit)


def advance_cursor(cursors: DataFrame, runs: DataFrame) -> DataFrame:
    """Cursor state after all runs of each query, in run order.

    The streak only depends on the runs after the last good one, so the fold is two aggregates, not a loop.
    Runs: query_hash, run_no, fetched, fresh, hit_end, total_matches.
    """
    last_good = runs.groupBy("query_hash").agg(
        F.max(F.when(F.col("fresh") >= LOW_YIELD, F.col("run_no"))).alias("_good"), F.sum("fetched").alias("_fetched"), F.max_by("hit_end", "run_no").alias("_end"),
        F.max_by("total_matches", F.when(F.col("total_matches").isNotNull(), F.col("run_no"))).alias("_total"), F.count(F.lit(1)).alias("_runs"),
    )
    tail = (
        runs.select("query_hash", "run_no").join(last_good.select("query_hash", "_good"), "query_hash")
        .groupBy("query_hash").agg(F.count(F.when(F.col("_good").isNull() | (F.col("run_no") > F.col("_good")), 1)).alias("_low"))
    )
    j = cursors.join(last_good, "query_hash", "left").join(tail, "query_hash", "left")
    streak = F.when(F.col("_good").isNull(), F.col("low_yield_streak") + F.col("_low")).otherwise(F.col("_low"))
    ran = F.col("_runs").isNotNull()
    exhausted = F.col("_end") | (streak >= LOW_YIELD_RUNS)
    return j.select(
        "query_hash", (F.col("next_start") + F.coalesce("_fetched", F.lit(0))).alias("next_start"),
        F.when(ran, streak).otherwise(F.col("low_yield_streak")).alias("low_yield_streak"),
        F.when(~ran, F.col("status")).when(exhausted, "exhausted").otherwise("active").alias("status"),
        F.coalesce("_total", "total_matches").alias("total_matches"),
    )


def dedup_engagers(engagers: DataFrame, order: str) -> DataFrame:
    """One row per provider id: the first comment, else the first reaction; ``also_reacted`` when both exist."""
    commented = F.col("engagement_type") == "Commented"
    rest = [c for c in engagers.columns if c != "provider_id"]
    g = engagers.filter(text(F.col("provider_id")) != "").groupBy("provider_id").agg(
        F.min_by(F.struct(*rest), F.struct(F.when(commented, 0).otherwise(1), order)).alias("r"), (F.bool_or(commented) & F.bool_or(~commented)).alias("also_reacted")
    )
    return g.select("provider_id", *[F.col("r")[c].alias(c) for c in rest], "also_reacted")


def union_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union with one row per key, rows of ``a`` first."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    return earliest_by(both, [key], F.col("_side")).drop("_side")
