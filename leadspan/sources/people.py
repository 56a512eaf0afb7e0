"""Provider payloads of people to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.normalize import text, wide_trim

EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"


def split_name(full: Column) -> tuple[Column, Column]:
    parts = F.filter(F.split(wide_trim(F.regexp_replace(text(full), EMOJI, "")), " "), lambda w: w != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " ")


def profile_slug(url: Column) -> Column:
    after = F.get(F.split(text(url), "/in/"), F.lit(1))
    return F.coalesce(F.regexp_replace(after, "/$", ""), F.lit(""))


def _engager(df: DataFrame, name: Column, person: str, kind: str, **extra: Column) -> DataFrame:
    first, last = split_name(name)
    g = lambda f: text(F.col(f"{person}.{f}"))
    return df.select(
        F.col("event_no"), first.alias("first_name"), last.alias("last_name"), g("headline").alias("headline"), F.lit("").alias("company"),
        g("profile_url").alias("linkedin_url"), profile_slug(F.col(f"{person}.profile_url")).alias("linkedin_slug"), g("id").alias("provider_id"),
        g("network_distance").alias("network_distance"), F.lit(kind).alias("engagement_type"), *[c.alias(n) for n, c in extra.items()],
        F.lit("content_engager").alias("source"),
    )


def normalize_engagers(reactions: DataFrame, comments: DataFrame) -> DataFrame:
    """Reactions (value, author struct) and comments (text, author name, author_details struct) in one table."""
    r = _engager(reactions, F.col("author.name"), "author", "Reacted", reaction_type=F.coalesce("value", F.lit("LIKE")), comment_text=F.lit(None).cast("string"))
    c = _engager(comments, F.coalesce("author", "author_details.name"), "author_details", "Commented", reaction_type=F.lit(None).cast("string"), comment_text=text(F.col("text")))
    return r.unionByName(c)


def normalize_contacts(lookups: DataFrame) -> DataFrame:
    """Best email (valid and professional, else valid, else first) and phone (recommended, else first) per person."""
    valid = F.filter("emails", lambda e: e["smtp_valid"] == "valid")
    work = F.filter(valid, lambda e: e["type"] == "professional")
    zero = F.lit(0)
    best = F.coalesce(F.get(work, zero), F.get(valid, zero), F.get("emails", zero))
    number = lambda p: F.coalesce(p["e164"], p["number"], F.lit(""))
    chosen = F.get(F.filter("phones", lambda p: F.coalesce(p["recommended"], F.lit(False))), zero)
    listed = F.filter(F.transform("phones", number), lambda n: n != "")
    phone = F.when(chosen.isNotNull(), number(chosen)).otherwise(F.get(listed, zero))
    return lookups.select(
        "rr_id", "name", "linkedin_url", best["email"].alias("email"), best["smtp_valid"].alias("email_status"), F.when(phone != "", phone).alias("phone"), listed.alias("all_phones")
    )
