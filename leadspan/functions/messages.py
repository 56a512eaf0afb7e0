"""Outbound message rules: validation, ordered auto-fix, copy checks and template merge."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.functions.normalize import WIDE_SPACE, text, wide_trim_start

_EDGE_BEFORE, _EDGE_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Phrases and patterns of the eight hard rules.
DISCLAIMERS = [
    "i'm not affiliated", "full disclosure", "disclaimer", "i should mention", "in the interest of transparency",
    "i have no affiliation", "not sponsored", "for transparency", "not saying this to flex",
    rf"{_EDGE_BEFORE}no pitch{_EDGE_AFTER}", "just genuine interest",
]
CONNECT_FILLERS = [
    "nice to connect", "great to connect", "pleasure to connect", "glad we connected", "happy to connect", "good to connect", "lovely to connect",
]
VAGUE_ASKS = [
    "let's chat sometime", "happy to discuss", "let me know if interested", "would love to connect", "let me know if you'd like to chat",
    "feel free to reach out", "let's connect sometime", "happy to help if needed", "open to a conversation", "let me know your thoughts",
]
GREETING = rf"(?i)^(hi|hey|dear|good morning|good afternoon|good evening){_EDGE_AFTER}"
SIGNAL_WORD = rf"(?i){_EDGE_BEFORE}signals?{_EDGE_AFTER}"
SPACED_DASH = rf"[{WIDE_SPACE}][-–—]{{1,2}}[{WIDE_SPACE}]"
SITE_NAME = rf"(?i){_EDGE_BEFORE}([A-Za-z][A-Za-z0-9-]*)\.(com|io|ai|co|app|dev|so|xyz|net|org){_EDGE_AFTER}"
# Rule ids in the order they are reported.
RULE_NAMES = ["no-signal", "no-start-with-i", "no-disclaimers", "no-dash-punctuation", "no-connect-filler", "start-with-hello", "no-company-tld", "specific-cta"]


def _any(phrases: list[str]) -> str:
    return "(?i)" + "|".join(phrases)


def rule_broken(rule: str, c: Column) -> Column:
    start = wide_trim_start(c)
    return {
        "no-signal": lambda: c.rlike(SIGNAL_WORD),
        "no-start-with-i": lambda: start.rlike(f"^I([{WIDE_SPACE}]|$)"),
        "no-disclaimers": lambda: c.rlike(_any(DISCLAIMERS)),
        "no-dash-punctuation": lambda: c.rlike(SPACED_DASH),
        "no-connect-filler": lambda: c.rlike(_any(CONNECT_FILLERS)),
        "start-with-hello": lambda: start.rlike(GREETING),
        "no-company-tld": lambda: c.rlike(SITE_NAME),
        "specific-cta": lambda: c.rlike(_any(VAGUE_ASKS)),
    }[rule]()


def rule_fix(rule: str, c: Column) -> Column | None:
    start = wide_trim_start(c)
    fixes = {
        "no-signal": lambda: F.regexp_replace(c, SIGNAL_WORD, "indicator"),
        "no-start-with-i": lambda: F.when(start.startswith("I "), F.concat(F.lit("Hello, i"), start.substr(F.lit(2), F.length(start)))).otherwise(c),
        "no-dash-punctuation": lambda: F.regexp_replace(c, SPACED_DASH, ". "),
        "start-with-hello": lambda: F.regexp_replace(start, GREETING, "Hello"),
        "no-company-tld": lambda: F.regexp_replace(c, SITE_NAME, "$1"),
    }
    return fixes[rule]() if rule in fixes else None


def broken_rules(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(rule_broken(r, c), F.lit(r)) for r in RULE_NAMES]))


def excerpt(c: Column) -> Column:
    return F.when(F.length(c) > 80, F.concat(F.substring(c, 1, 80), F.lit("..."))).otherwise(c)


def validate_messages(df: DataFrame, col: str) -> DataFrame:
    """Adds ``violations`` (rule ids in rule order), ``valid`` and the ``excerpt`` shown with a violation."""
    checked = df.withColumn("violations", broken_rules(text(F.col(col))))
    ok = F.size("violations") == 0
    return checked.withColumn("valid", ok).withColumn("excerpt", F.when(~ok, excerpt(F.col(col))))


def fix_messages(df: DataFrame, col: str) -> DataFrame:
    """Rules applied in order to the running text; adds ``fixed_text``, ``violations`` and ``fixes``."""
    out = df.withColumn("fixed_text", text(F.col(col)))
    for i, rule in enumerate(RULE_NAMES):
        out = out.withColumn(f"_bad{i}", rule_broken(rule, F.col("fixed_text")))
        fixed = rule_fix(rule, F.col("fixed_text"))
        if fixed is not None:
            out = out.withColumn("_next", F.when(F.col(f"_bad{i}"), fixed).otherwise(F.col("fixed_text")))
            out = out.withColumn(f"_did{i}", F.col("_next") != F.col("fixed_text")).withColumn("fixed_text", F.col("_next")).drop("_next")
        else:
            out = out.withColumn(f"_did{i}", F.lit(False))
    ids = list(RULE_NAMES)
    listed = lambda prefix: F.array_compact(F.array(*[F.when(F.col(f"{prefix}{i}"), F.lit(r)) for i, r in enumerate(ids)]))
    out = out.withColumn("violations", listed("_bad")).withColumn("fixes", listed("_did"))
    return out.drop(*[f"_bad{i}" for i in range(len(ids))], *[f"_did{i}" for i in range(len(ids))])


def word_count(c: Column) -> Column:
    return F.size(F.split(text(c), f"[{WIDE_SPACE}]+"))


def copy_qa(df: DataFrame, col: str) -> DataFrame:
    """Advisory checks of an email body: more than 90 words, em dash."""
    return df.select("*", word_count(F.col(col)).alias("word_count"), (word_count(F.col(col)) > 90).alias("too_long"), text(F.col(col)).contains("—").alias("has_em_dash"))


def render(template: Column, values: Mapping[str, Column]) -> Column:
    """Replaces ``{{name}}`` marks by column values, literally; missing values become empty."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), text(value.cast("string")))
    return out
