"""Keys and canonical forms for urls, emails, names, companies and content, all as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as script engines see it (wider than Java's \s).
WIDE_SPACE = r"\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Fixed values.
LEGAL_SUFFIXES = ["inc", "llc", "corp", "co", "company", "group", "ltd", "plc", "holdings", "the"]
COMPANY_KEY_SUFFIXES = ["inc", "ltd", "llc", "gmbh", "corp", "co", "sa", "ag", "plc"]
PERSONAL_DOMAINS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.fr", "hotmail.com", "hotmail.fr", "outlook.com", "live.com", "aol.com",
    "icloud.com", "me.com", "mail.com", "protonmail.com", "proton.me", "zoho.com", "gmx.com", "gmx.de", "web.de", "yandex.com",
    "qq.com", "163.com", "orange.fr", "free.fr", "sfr.fr", "laposte.net", "wanadoo.fr",
]
# Endings that are cut from a domain to guess a company's name.
GUESSABLE_TLDS = ["com", "io", "co", "net", "org", "ai", "dev", "app", "tech", "xyz", "us", "uk", "de", "fr", "es", "it", "nl", "be", "ch", "at", "ca", "au"]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def wide_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WIDE_SPACE}]+|[{WIDE_SPACE}]+$", "")


def wide_trim_start(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WIDE_SPACE}]+", "")


def is_web_url(c: Column) -> Column:
    return c.rlike(r"^(?i)https?://[^/?#\s]+")


def url_host(c: Column) -> Column:
    """Host of an http(s) url, lower-cased, port kept, user info dropped."""
    return F.lower(F.regexp_extract(c, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#\s]+)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?i)https?://[^/?#\s]+([^?#]*)", 1)


def norm_linkedin(c: Column) -> Column:
    """Canonical profile url; the host of a valid url is ignored; text that is not a url is read as a slug."""
    raw = text(c)
    trimmed = wide_trim(raw)
    path = F.regexp_replace(url_path(trimmed), "/+$", "")
    path = F.lower(F.regexp_replace(path, "^/pub/", "/in/"))
    slug = F.regexp_replace(raw, r".*linkedin\.com/(in|pub)/", "")
    slug = F.lower(F.regexp_replace(slug, r"[/?#].*$", ""))
    return (
        F.when(raw == "", F.lit(""))
        .when(is_web_url(trimmed), F.concat(F.lit("https://www.linkedin.com"), path))
        .when(slug != "", F.concat(F.lit("https://www.linkedin.com/in/"), slug))
        .otherwise(F.lit(""))
    )


def norm_email(c: Column) -> Column:
    return F.lower(wide_trim(text(c)))


def email_domain(c: Column) -> Column:
    parts = F.split(F.lower(text(c)), "@")
    return F.when(F.size(parts) == 2, parts[1]).otherwise(F.lit(""))


def norm_domain(c: Column) -> Column:
    out = F.lower(wide_trim(text(c)))
    for pattern in (r"^https?://", r"^www\.", r"/.*$"):
        out = F.regexp_replace(out, pattern, "")
    return out


@lru_cache(maxsize=1)
def _decompositions() -> dict[str, dict[str, str]]:
    """NFKD of every character that contains an ASCII letter or digit, from the Unicode tables of Python.

    ``plain``: becomes one such character alone; ``marked``: one such character, then only marks;
    ``longer``: anything else, with non-ASCII parts turned to spaces.
    """
    out: dict[str, dict[str, str]] = {"plain": {}, "marked": {}, "longer": {}}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if char.lower() != char:
            continue
        flat = unicodedata.normalize("NFKD", char)
        kept = "".join(ch if ch.isascii() and (ch.islower() or ch.isdigit()) else " " for ch in flat)
        if not kept.strip():
            continue
        if len(kept) == 1:
            out["plain"][char] = kept
        elif kept[0] != " " and not kept[1:].strip():
            out["marked"][char] = kept[0]
        else:
            out["longer"][char] = kept
    return out


def _char_class(chars) -> str:
    """Regex class of lower-case characters as few ranges: gaps that only hold upper-case letters are closed."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        gap = range(ranges[-1][1] + 1, code) if ranges else range(0)
        if ranges and all(chr(g).lower() != chr(g) for g in gap):
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus marks in U+0300..U+036F."""
    source, target = [], []
    for code in range(0xC0, min(0x2000, sys.maxunicode)):
        flat = unicodedata.normalize("NFD", chr(code))
        base = "".join(ch for ch in flat if not 0x300 <= ord(ch) <= 0x36F)
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def fold_accents(c: Column) -> Column:
    """Lower-case, accents removed, trimmed."""
    source, target = _accents()
    return wide_trim(F.regexp_replace(F.translate(F.lower(text(c)), source, target), r"[\u0300-\u036f]", ""))


def norm_name(c: Column) -> Column:
    """Lower-case letters and digits only; a mark split off a letter leaves a space ('Müller' -> 'mu ller')."""
    maps = _decompositions()
    low = F.lower(text(c))
    marked, longer = maps["marked"], maps["longer"]
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in longer.items())), F.lit("\x02"), F.lit("\x01"))
    spelled = F.transform(F.split(low, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch))
    wide = F.when(low.rlike(_char_class(longer)), F.array_join(spelled, "")).otherwise(low)
    wide = F.regexp_replace(wide, "(" + _char_class(marked) + ")", "$1 ")
    simple = {**maps["plain"], **marked}
    wide = F.translate(wide, "".join(simple), "".join(simple.values()))
    ascii_or_wide = F.when(low.rlike(r"[^\x00-\x7f]"), wide).otherwise(low)
    return F.trim(F.regexp_replace(ascii_or_wide, r"[^a-z0-9]+", " "))


def norm_company(c: Column) -> Column:
    """Name form without legal suffixes; kept whole when nothing else is left."""
    name = norm_name(c)
    kept = F.array_join(F.filter(F.split(name, " "), lambda t: ~t.isin(LEGAL_SUFFIXES) & (t != "")), " ")
    return F.when(kept != "", kept).otherwise(name)


def person_key(name: Column, company: Column) -> Column:
    n = norm_name(name)
    return F.when(n == "", F.lit("")).otherwise(F.sha1(F.concat_ws("|", n, norm_company(company)).cast("binary")))


def norm_url(c: Column) -> Column:
    trimmed = wide_trim(text(c))
    host = F.regexp_replace(url_host(trimmed), r"^www\.", "")
    valid = F.concat(host, F.lower(F.regexp_replace(url_path(trimmed), "/+$", "")))
    other = F.lower(trimmed)
    for pattern in (r"^https?://", r"^www\.", r"[?#].*$", r"/+$"):
        other = F.regexp_replace(other, pattern, "")
    return F.when(is_web_url(trimmed), valid).otherwise(other)


def hash_url(c: Column) -> Column:
    return F.sha1(norm_url(c).cast("binary"))


QUERY_LISTS = ("titles", "companyNames", "companyIndustry", "location", "keywords")


def hash_query(lists: dict[str, Column]) -> Column:
    """Order-independent hash of a search: each list lower-cased, trimmed and sorted, as JSON."""
    empty = F.array().cast("array<string>")
    cleaned = [
        F.array_sort(F.transform(F.coalesce(lists.get(n, F.lit(None).cast("array<string>")), empty), lambda s: wide_trim(F.lower(s)))).alias(n)
        for n in QUERY_LISTS
    ]
    return F.sha1(F.to_json(F.struct(*cleaned)).cast("binary"))


def content_hash(c: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text(c), f"[{WIDE_SPACE}]+", " ")).cast("binary"), 256)


def company_key(name: Column, website: Column) -> Column:
    """Duplicate key of a company: cleaned name and host name; null when both are missing."""
    words = "|".join(COMPANY_KEY_SUFFIXES)
    short = F.regexp_replace(F.lower(text(name)), rf"(?<![a-z0-9_])({words})(?![a-z0-9_])\.?", "")
    short = F.regexp_replace(short, "[^a-z0-9]", "")
    site = text(website)
    full = F.when(site.startswith("http"), site).otherwise(F.concat(F.lit("https://"), site))
    host = F.when(site == "", F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(url_host(full), ":[0-9]*$", ""), r"^www\.", ""))
    return F.when((short != "") | (host != ""), F.concat(short, F.lit("|"), host))


def is_personal_domain(domain: Column) -> Column:
    return F.lower(text(domain)).isin(PERSONAL_DOMAINS)


def company_from_domain(domain: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(domain), rf"(?i)\.({'|'.join(GUESSABLE_TLDS)})$", ""), r"\.", " ")


def activity_id(url: Column) -> Column:
    """Post id in an activity url, else the ugcPost urn, else null."""
    plain = F.regexp_extract(text(url), r"activity[/:-](\d+)", 1)
    ugc = F.regexp_extract(text(url), r"urn:li:ugcPost:(\d+)", 1)
    return F.when(plain != "", plain).when(ugc != "", F.concat(F.lit("urn:li:ugcPost:"), ugc))


def utf16_units(c: Column) -> Column:
    """Length of a text in UTF-16 units: characters above U+FFFF count twice."""
    return F.octet_length(F.encode(text(c), "UTF-16BE")) / 2


TOKENS_PER_UNIT = 0.28


def approx_tokens(c: Column) -> Column:
    return F.ceil(utf16_units(c) * F.lit(TOKENS_PER_UNIT))


def quarter_tokens(c: Column) -> Column:
    return F.ceil(utf16_units(c) / F.lit(4.0))


def tokens(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text(c)), f"[^a-z0-9_]+", " "), " ")
    return F.filter(words, lambda t: F.length(t) >= 3)
