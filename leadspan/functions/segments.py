"""Headline segments and score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First matching rule wins; terms are substrings of the lower-cased headline.
SEGMENT_RULES = [
    ("Founder/CEO", ["ceo", "founder", "co-founder"]),
    ("Engineering Leadership", ["cto", "vp engineering", "head of engineering"]),
    ("Marketing Leadership", ["cmo", "vp marketing", "head of marketing"]),
    ("Sales Leadership", ["cro", "vp sales", "head of sales"]),
    ("Product", ["product", "pm"]),
    ("Engineering IC", ["engineer", "developer"]),
    ("Marketing", ["marketing", "growth"]),
    ("Sales", ["sales", "account executive", "sdr", "bdr"]),
    ("People/HR", ["hr", "people", "talent"]),
]


def segment_of(headline: Column) -> Column:
    """Substring rules, so 'director' counts as 'cto': kept because results must agree."""
    low = F.lower(headline)
    out = F.when(F.coalesce(headline, F.lit("")) == "", F.lit("Unknown"))
    for label, terms in SEGMENT_RULES:
        out = out.when(low.rlike("|".join(terms)), F.lit(label))
    return out.otherwise(F.lit("Other"))


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 85, "Very Strong").when(score >= 70, "Strong").when(score >= 50, "Moderate").otherwise("Reject")
    )


def provider_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")


def temperature_band(score: Column) -> Column:
    return F.when(score >= 80, "hot").when(score >= 50, "warm").when(score >= 20, "monitor").otherwise("disqualified")
