"""Readers: lead files, suppression lists, review items, markdown folders."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspan.functions.normalize import text

# Names a canonical lead field may have in an import, best first.
LEAD_ALIASES = {
    "first_name": ["first_name", "firstName"], "last_name": ["last_name", "lastName"], "headline": ["headline", "title"],
    "company": ["company", "company_name"], "linkedin_url": ["linkedin_url", "profileUrl", "profile_url"], "provider_id": ["provider_id", "providerId"],
}


def read_csv_leads(spark: SparkSession, path: str) -> DataFrame:
    """One record per line, header row, doubled quotes, trimmed cells; a missing cell is an empty string."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=False)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_json_leads(spark: SparkSession, path: str) -> DataFrame:
    """A file with an array of records or one record; many files are read in parallel."""
    return spark.read.json(path, multiLine=True)


def first_of(df: DataFrame, names: Sequence[str], default: str | None = "") -> Column:
    """First non-null of the columns that exist."""
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default)


def unwrap(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the first column among ``keys`` that holds an array of records; the table itself without one."""
    for key in keys:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            return df.select(F.inline(key))
    return df


def canonical_leads(df: DataFrame, source: str) -> DataFrame:
    return df.select(*[first_of(df, names).alias(field) for field, names in LEAD_ALIASES.items()], F.lit(source).alias("source"))


def read_visitors(spark: SparkSession, path: str) -> DataFrame:
    return canonical_leads(unwrap(read_json_leads(spark, path), ["visitors", "data"]), "profile_visitor")


def read_engagers(spark: SparkSession, path: str) -> DataFrame:
    return canonical_leads(unwrap(read_json_leads(spark, path), ["engagers", "data"]), "content_engager")


def load_suppression_csv(spark: SparkSession, path: str, origin: str = "csv") -> DataFrame:
    """Blocklist rows of a suppression file. The email stays in its own column; rows without email and url are left out."""
    df = read_csv_leads(spark, path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    blank = lambda c: F.when(c != "", c)
    full = F.trim(F.concat_ws(" ", first_of(df, ["first_name"]), first_of(df, ["last_name"])))
    url = F.coalesce(blank(first_of(df, ["linkedin_url"])), blank(first_of(df, ["linkedin"])))
    rows = df.select(
        blank(first_of(df, ["email"])).alias("email"), url.alias("linkedin_url"), F.coalesce(blank(first_of(df, ["name"])), blank(full)).alias("name"),
        blank(first_of(df, ["company"])).alias("company"), F.lit("permanent").alias("scope"), F.lit(f"Imported from {origin}").alias("reason"),
    )
    return rows.filter("email IS NOT NULL OR linkedin_url IS NOT NULL").withColumn("provider_id", F.coalesce("email", "linkedin_url"))


def review_items(df: DataFrame) -> DataFrame:
    """Review rows of imported items: priority from the score (50 when missing), text from what is there."""
    score = F.coalesce(first_of(df, ["score"], None).try_cast("double"), F.lit(50.0))
    described = F.concat_ws(" — ", *[F.when(F.col(c) != "", F.col(c)) for c in ("headline", "company", "title") if c in df.columns])
    return df.select(
        F.lit("lead_qualification").alias("type"), first_of(df, ["name", "title"], "Untitled").alias("title"), described.alias("description"),
        first_of(df, ["profile_url", "id", "url"]).alias("source_id"), F.when(score >= 95, "high").when(score >= 80, "normal").otherwise("low").alias("priority"),
        F.to_json(F.struct(*df.columns)).alias("payload"),
    )


def read_review_items(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    return review_items(unwrap(read_json_leads(spark, path), [key] if key else ["leads", "qualified", "items", "data"]))


def _glob_pattern(glob: str) -> str:
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)


def read_markdown(spark: SparkSession, base: str, globs: Sequence[str]) -> DataFrame:
    """One row per .md file under ``base`` whose relative path matches one of the globs: path, text."""
    files = spark.read.text(base, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    root = base.rstrip("/")
    relative = F.regexp_replace("path", "^.*?" + re.escape(root) + "/", "")
    wanted = F.lit(False)
    for g in globs:
        wanted = wanted | relative.rlike("^" + _glob_pattern(g) + "$")
    return files.withColumn("path", relative).filter(wanted)


PROPERTY = (
    "map<string, struct<type:string, title:array<struct<plain_text:string>>, rich_text:array<struct<plain_text:string>>, number:double, select:struct<name:string>, "
    "multi_select:array<struct<name:string>>, url:string, email:string, phone_number:string, checkbox:boolean, date:struct<start:string>>>"
)


def flatten_properties(df: DataFrame, key: str, properties: str = "properties") -> DataFrame:
    """Typed page properties (JSON text) as rows: key, name, value and, for multiple choices, values."""
    p = df.select(key, F.explode(F.from_json(properties, PROPERTY)).alias("name", "p"))
    t = F.col("p.type")
    joined = lambda c: F.coalesce(F.array_join(F.col(c)["plain_text"], ""), F.lit(""))
    value = (
        F.when(t == "title", joined("p.title")).when(t == "rich_text", joined("p.rich_text")).when(t == "number", F.col("p.number").cast("string"))
        .when(t == "select", text(F.col("p.select.name"))).when(t == "url", text(F.col("p.url"))).when(t == "email", text(F.col("p.email")))
        .when(t == "phone_number", text(F.col("p.phone_number"))).when(t == "checkbox", F.col("p.checkbox").cast("string"))
        .when(t == "date", text(F.col("p.date.start"))).when(t == "multi_select", F.lit(None).cast("string")).otherwise(F.lit(""))
    )
    values = F.when(t == "multi_select", F.coalesce(F.col("p.multi_select.name"), F.array().cast("array<string>")))
    return p.select(key, "name", value.alias("value"), values.alias("values"))


def explode_payload(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows of a tool result: the array, the first array inside an object, else the object; other text as it is.

    Returns key, position and the row as a variant; ``text`` holds what is not JSON.
    """
    v = F.try_parse_json(payload)
    shape = F.schema_of_variant(v)
    keys = F.json_object_keys(payload)
    path = lambda k: F.concat(F.lit('$["'), k, F.lit('"]'))
    arrays = F.filter(keys, lambda k: F.schema_of_variant(F.try_variant_get(v, path(k), "variant")).startswith("ARRAY"))
    inner = F.try_variant_get(v, path(arrays[0]), "array<variant>")
    rows = (
        F.when(shape.startswith("ARRAY"), F.try_variant_get(v, F.lit("$"), "array<variant>"))
        .when(F.size(arrays) > 0, inner).when(v.isNotNull(), F.array(v))
    )
    parsed = df.select(key, F.posexplode(rows).alias("position", "row"), F.lit(None).cast("string").alias("text"))
    loose = df.filter(F.try_parse_json(payload).isNull() & F.col(payload).isNotNull()).select(key, F.lit(0).alias("position"), F.lit(None).cast("variant").alias("row"), F.col(payload).alias("text"))
    return parsed.unionByName(loose)


def import_contacts(df: DataFrame, mapping: Mapping[str, str], provider: str) -> DataFrame:
    """CRM columns renamed to lead fields; ``source`` names the CRM."""
    return df.select(*[F.col(crm).alias(field) for crm, field in mapping.items() if crm in df.columns], F.lit(f"crm:{provider}").alias("source"))


def crm_filter(df: DataFrame, filters: Sequence[tuple[str, str, object]], mapping: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """(field, operator, value) filters on the CRM columns behind the fields."""
    tests = {
        "eq": lambda c, x: c == x, "neq": lambda c, x: c != x, "contains": lambda c, x: c.contains(x), "gt": lambda c, x: c > x, "lt": lambda c, x: c < x,
        "gte": lambda c, x: c >= x, "lte": lambda c, x: c <= x, "in": lambda c, x: c.isin(list(x)), "not_in": lambda c, x: ~c.isin(list(x)),
    }
    for name, op, value in filters:
        df = df.filter(tests[op](F.col(mapping.get(name, name)), value))
    return df
