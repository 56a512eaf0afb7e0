"""ICP rule scores, signal scores, evidence confidence and other per-row scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspan.functions.normalize import text
from leadspan.functions.stats import js_round

DAY_MICROS = 86_400_000_000.0
# Points of the scoring sheet.
TITLE_POINTS = [
    (r"\b(ceo|cto|cpo|coo|cfo|cmo|cdo|chief)\b", 30), (r"\b(vp|vice president)\b", 25), (r"\bhead of\b", 20), (r"\bdirector\b", 15), (r"\bmanager\b", 5),
]
SIZE_POINTS = [(100, 250, 15), (251, 500, 25), (501, 1000, 20), (1001, 5000, 10)]
FUNDING_POINTS = {"Series A": 15, "Series B": 25, "Series C": 20, "Growth": 20, "PE-backed": 15, "Public": 10}
# Weight and terms of each signal category.
SIGNAL_CATEGORIES = {
    "hiring_signals": (4, [
        "Scrum Master", "Agile Coach", "Release Train Engineer", "SAFe", "Kanban", "Agile Transformation", "Engineering Manager",
        "Head of Delivery", "Programme Manager", "Delivery Manager", "Technical Programme Manager", "VP of Delivery", "Chief of Staff Engineering",
    ]),
    "linkedin_activity_signals": (5, [
        "agile transformation", "delivery challenges", "missed deadline", "sprint", "team velocity", "scaling engineering", "technical debt",
        "cross-functional", "product-engineering alignment", "roadmap slippage", "release cadence", "dependencies blocking", "waterfall",
        "process improvement",
    ]),
    "company_event_signals": (4, [
        "Series B", "Series C", "acquisition", "merger", "digital transformation", "new CTO", "new CPO", "reorg", "rapid growth", "100 engineers",
        "doubling team", "scaling team",
    ]),
    "tech_stack_signals": (2, ["Jira", "Confluence", "Azure DevOps", "Linear", "Shortcut"]),
    "news_signals": (3, [
        "announced digital transformation", "technology overhaul", "modernising systems", "engineering restructure", "post-merger integration",
        "IPO preparation",
    ]),
}
REQUIRED_SIGNALS = ["hiring_signals", "linkedin_activity_signals", "company_event_signals"]
CREDITS_PER_SIGNAL = {"job-change": 3, "hiring-surge": 1, "funding": 1, "news": 0}


def title_points(title: Column) -> Column:
    low = F.lower(text(title))
    out = F.when(low.rlike(TITLE_POINTS[0][0]), TITLE_POINTS[0][1])
    for pattern, points in TITLE_POINTS[1:]:
        out = out.when(low.rlike(pattern), points)
    return out.otherwise(0)


def size_points(employees: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for low, high, points in SIZE_POINTS:
        out = out.when(employees.between(low, high), points)
    return out.otherwise(0)


def funding_points(stage: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, points in FUNDING_POINTS.items():
        out = out.when(stage == name, points)
    return out.otherwise(0)


def icp_score(title: Column, employees: Column, funding: Column, signal_weight: Column, signal_cap: int | None = 25) -> Column:
    """Sum of title, size, funding and 5 points per matched signal weight (that part capped by default)."""
    signal = F.coalesce(signal_weight, F.lit(0)) * 5
    if signal_cap is not None:
        signal = F.least(signal, F.lit(signal_cap))
    return title_points(title) + size_points(employees) + funding_points(funding) + signal


def signal_flags(body: Column, categories=SIGNAL_CATEGORIES) -> dict[str, Column]:
    low = F.lower(text(body))
    flags = {}
    for name, (_, terms) in categories.items():
        flag = F.lit(False)
        for term in terms:
            flag = flag | low.contains(term.lower())
        flags[name] = flag
    return flags


def signal_score(flags: dict[str, Column], minimum: int = 6, strong: int = 12) -> dict[str, Column]:
    """Summed weights; qualifies from ``minimum`` with one required category, strong from ``strong``."""
    score = sum((F.when(flag, SIGNAL_CATEGORIES[n][0]).otherwise(0) for n, flag in flags.items()), F.lit(0))
    required = F.lit(False)
    for n in REQUIRED_SIGNALS:
        required = required | flags[n]
    return {"signal_score": score, "qualifies": (score >= minimum) & required, "strong_fit": (score >= strong) & required}


def bias_passed(sample: Column, balanced: Column, span_days: Column) -> Column:
    return F.coalesce((sample >= 30) & balanced & (span_days >= 14), F.lit(False))


def confidence_score(evidence_count: Column, first_at: Column, last_at: Column, bias_ok: Column) -> Column:
    span = js_round((F.unix_micros(last_at) - F.unix_micros(first_at)) / F.lit(DAY_MICROS))
    time_part = F.when(evidence_count >= 2, F.least(span, F.lit(30))).otherwise(0)
    return F.least(F.least(evidence_count * 10, F.lit(40)) + time_part + F.when(bias_ok, 30).otherwise(0), F.lit(100))


def should_promote(confidence: Column, evidence_count: Column, bias_known: Column, sample: Column, balanced: Column, span_days: Column) -> tuple[Column, Column]:
    """(promote, reason) for the next confidence level."""
    passed = bias_passed(sample, balanced, span_days)
    enough = evidence_count >= 2
    promote = F.when(confidence == "hypothesis", enough).when(confidence == "validated", bias_known & passed).otherwise(F.lit(False))
    incomplete = F.concat(
        F.lit("Bias check incomplete: sample="), sample.cast("string"), F.lit(", balanced="), balanced.cast("string"),
        F.lit(", span="), span_days.cast("string"), F.lit("d"),
    )
    reason = (
        F.when(
            confidence == "hypothesis",
            F.when(enough, "Has 2+ evidence entries — ready for validated").otherwise(
                F.concat(F.lit("Only "), evidence_count.cast("string"), F.lit(" evidence entry (need 2+)"))
            ),
        )
        .when(
            confidence == "validated",
            F.when(bias_known & passed, "Bias check passed — ready for proven").when(bias_known, incomplete).otherwise("No bias check performed yet"),
        )
        .otherwise("Already at highest confidence level")
    )
    return F.coalesce(promote, F.lit(False)), reason


def is_expired(expires_at: Column, now: Column) -> Column:
    return F.coalesce(expires_at < now, F.lit(False))


def capped_answer_confidence(confidence: Column, evidence_count: Column) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(confidence.cast("double"), F.lit(0.0))))
    return F.when(evidence_count == 0, F.least(clamped, F.lit(20.0))).when(evidence_count == 1, F.least(clamped, F.lit(60.0))).otherwise(clamped)


def _is(name: str):
    return lambda t: t == F.lit(name)


def watch_cost(signal_types: Column) -> Column:
    """Daily credits of one watch: the sum over its signal types."""
    price = F.lit(0)
    for name, credits in CREDITS_PER_SIGNAL.items():
        price = price + F.size(F.filter(signal_types, _is(name))) * credits
    return price
