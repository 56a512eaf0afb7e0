"""Row conditions and sequence-step conditions, turned into Columns once on the driver.

A row condition is ``field op value`` leaves joined by AND within OR. The text is only cut at its keywords
outside quotes; evaluation is plain Column algebra, so Spark pushes the result down like any filter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = r"'[^']*'|\"[^\"]*\""


def _cut(text: str, keyword: str) -> list[str]:
    """Pieces between occurrences of a spaced keyword that stand outside quotes."""
    marked = re.sub(rf"({_QUOTED})|\s{keyword}\s", lambda m: m[1] or "\0", text, flags=re.I)
    return [piece.strip() for piece in marked.split("\0")]


def _value(raw: str):
    if raw in ("true", "false"):
        return raw == "true"
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"":
        return raw[1:-1]
    try:
        return float(raw)
    except ValueError:
        return raw


def _field(df: DataFrame, path: str) -> tuple[Column, T.DataType] | None:
    """Column and type of a dotted path, or None when the table has no such field."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return F.col(path), kind


def _leaf(df: DataFrame, text: str) -> Column:
    absent = F.lit(False)
    if m := re.fullmatch(r"(\S+)\s+exists", text, flags=re.I):
        found = _field(df, m[1])
        return found[0].isNotNull() if found else absent
    if m := re.fullmatch(r"(\S+)\s+contains\s+(.+)", text, flags=re.I | re.S):
        found, value = _field(df, m[1]), _value(m[2].strip())
        if found is None:
            return absent
        column, kind = found
        if isinstance(kind, T.StringType):
            return F.coalesce(F.lower(column).contains(_as_text(value).lower()), absent)
        if isinstance(kind, T.ArrayType):
            same = isinstance(kind.elementType, T.StringType) == isinstance(value, str)
            return F.coalesce(F.array_contains(column, F.lit(value)), absent) if same else absent
        return absent
    if m := re.fullmatch(r"(\S+?)\s*(==|!=|>=|<=|>|<)\s*(.+)", text, flags=re.S):
        found, op, value = _field(df, m[1]), m[2], _value(m[3].strip())
        if op in ("==", "!="):
            equal = F.coalesce(_loosely_equal(found, value), absent) if found else absent
            return equal if op == "==" else ~equal
        numeric = found and isinstance(found[1], T.NumericType) and isinstance(value, float)
        if not numeric:
            return absent
        column = found[0]
        test = {">": column > value, "<": column < value, ">=": column >= value, "<=": column <= value}[op]
        return F.coalesce(test, absent)
    raise ValueError(f"cannot read condition: {text!r}")


def _as_text(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value:g}" if isinstance(value, float) else str(value)


def _loosely_equal(found: tuple[Column, T.DataType], value) -> Column:
    """Equality with number coercion between text, numbers and booleans."""
    column, kind = found
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return column == value
    if isinstance(value, str):
        try:
            value = float(value) if value.strip() else 0.0
        except ValueError:
            return F.lit(False)
    if isinstance(kind, T.StringType):
        column = F.when(F.trim(column) == "", F.lit(0.0)).otherwise(column.try_cast("double"))
    return column.cast("double") == F.lit(float(value))


def condition(df: DataFrame, text: str) -> Column:
    """AND binds tighter than OR; parentheses are not part of this language and are refused."""
    bare = re.sub(_QUOTED, "", text)
    if not text.strip():
        raise ValueError("empty condition")
    if "(" in bare or ")" in bare:
        raise ValueError("parentheses are not supported in row conditions")
    out = None
    for branch in _cut(text, "OR"):
        both = None
        for leaf in _cut(branch, "AND"):
            test = _leaf(df, leaf)
            both = test if both is None else both & test
        out = both if out is None else out | both
    return out


def where_condition(df: DataFrame, text: str) -> DataFrame:
    return df.filter(condition(df, text))


# Names a step condition may use, and the channel-state field each stands for.
STATE_FIELDS = {
    "replied_email": "email.replied", "replied_linkedin": "linkedin.replied",
    "connected_linkedin": "linkedin.connected", "connect_sent_linkedin": "linkedin.connect_sent", "opened_email": "email.opened",
    "bounced_email": "email.bounced", "sent_email": "email.sent", "dm_sent_linkedin": "linkedin.dm_sent",
    "profile_viewed_linkedin": "linkedin.profile_viewed", "followed_twitter": "twitter.followed", "liked_twitter": "twitter.liked",
    "called_phone": "phone.called",
}


def channel_states() -> Column:
    """Struct of booleans from the lead's timestamps; channels without data are false."""
    has = lambda c: F.col(c).isNotNull()
    no = F.lit(False)
    return F.struct(
        F.struct(
            no.alias("profile_viewed"), has("connected_at").alias("connected"), has("connect_sent_at").alias("connect_sent"),
            (has("dm1_sent_at") | has("dm2_sent_at")).alias("dm_sent"), has("replied_at").alias("replied"),
        ).alias("linkedin"),
        F.struct(
            has("email_sent_at").alias("sent"), has("email_opened_at").alias("opened"), has("email_replied_at").alias("replied"),
            has("email_bounced_at").alias("bounced"),
        ).alias("email"),
        F.struct(no.alias("followed"), no.alias("liked"), no.alias("commented"), no.alias("replied")).alias("twitter"),
        F.struct(no.alias("called"), no.alias("connected"), no.alias("voicemail")).alias("phone"),
    )


def step_condition(text: str | None, states: str = "states") -> Column:
    """NOT > AND > OR with parentheses, over the channel states; unknown names are false, empty text is true.

    The names are rewritten to fields and Spark's own expression syntax does the rest.
    """
    if not (text or "").strip():
        return F.lit(True)
    if re.search(r"!\s*(AND|OR)\b", text):
        return F.lit(False)

    def spell(m: re.Match) -> str:
        word = m[0]
        if word in ("AND", "OR"):
            return word
        if word == "replied_any":
            return "(" + " OR ".join(f"{states}.{c}.replied" for c in ("email", "linkedin", "twitter")) + ")"
        return f"{states}.{STATE_FIELDS[word]}" if word in STATE_FIELDS else "false"

    return F.expr(re.sub(r"!", " NOT ", re.sub(r"[A-Za-z_]\w*", spell, text)))
