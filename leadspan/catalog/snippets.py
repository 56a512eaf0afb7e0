"""DuckDB spellings shared by several checks."""

from leadspan.functions.messages import CONNECT_FILLERS, DISCLAIMERS, RULE_NAMES, VAGUE_ASKS
from leadspan.functions.normalize import COMPANY_KEY_SUFFIXES, LEGAL_SUFFIXES

NOW = "TIMESTAMP '2025-01-01 00:00:00'"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def linkedin(u: str) -> str:
    return rf"""(CASE WHEN coalesce({u}, '') = '' THEN ''
      WHEN regexp_matches(trim({u}), '^(?i:https?)://[^/?#\s]+') THEN 'https://www.linkedin.com' ||
        lower(regexp_replace(regexp_replace(regexp_extract(trim({u}), '^(?i:https?)://[^/?#\s]+([^?#]*)', 1), '/+$', ''), '^/pub/', '/in/'))
      WHEN regexp_replace(regexp_replace({u}, '.*linkedin\.com/(in|pub)/', ''), '[/?#].*$', '') <> '' THEN
        'https://www.linkedin.com/in/' || lower(regexp_replace(regexp_replace({u}, '.*linkedin\.com/(in|pub)/', ''), '[/?#].*$', ''))
      ELSE '' END)"""


def norm_url(u: str) -> str:
    return rf"""(CASE WHEN regexp_matches(trim({u}), '^(?i:https?)://[^/?#\s]+') THEN
        regexp_replace(lower(regexp_extract(trim({u}), '^(?i:https?)://(?:[^/?#@]*@)?([^/?#\s]+)', 1)), '^www\.', '') ||
        lower(regexp_replace(regexp_extract(trim({u}), '^(?i:https?)://[^/?#\s]+([^?#]*)', 1), '/+$', ''))
      ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({u}, ''))), '^https?://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '') END)"""


def name(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def company(c: str) -> str:
    suffixes = ", ".join(quoted(s) for s in LEGAL_SUFFIXES)
    kept = f"array_to_string(list_filter(string_split({name(c)}, ' '), lambda t: t <> '' AND t NOT IN ({suffixes})), ' ')"
    return f"(CASE WHEN {kept} <> '' THEN {kept} ELSE {name(c)} END)"


def person(n: str, c: str) -> str:
    return f"(CASE WHEN {name(n)} = '' THEN '' ELSE sha1({name(n)} || '|' || {company(c)}) END)"


def domain(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '^https?://', ''), '^www\.', ''), '/.*$', '')"


def email_domain(c: str) -> str:
    return f"(CASE WHEN len(string_split(lower(coalesce({c}, '')), '@')) = 2 THEN string_split(lower({c}), '@')[2] ELSE '' END)"


def company_key(n: str, w: str) -> str:
    words = "|".join(COMPANY_KEY_SUFFIXES)
    short = rf"regexp_replace(regexp_replace(lower(coalesce({n}, '')), '\b({words})\b\.?', '', 'g'), '[^a-z0-9]', '', 'g')"
    site = f"CASE WHEN starts_with({w}, 'http') THEN {w} ELSE 'https://' || {w} END"
    host = rf"(CASE WHEN coalesce({w}, '') = '' THEN '' ELSE regexp_replace(regexp_extract(lower({site}), '^https?://([^/?#:]+)', 1), '^www\.', '') END)"
    return f"(CASE WHEN {short} <> '' OR {host} <> '' THEN {short} || '|' || {host} END)"


def bigrams(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({c}), 1)), lambda i: substr({c}, i, 2)))"


def dice_sets(x: str, y: str) -> str:
    return f"(CASE WHEN len({x}) + len({y}) = 0 THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END)"


def tokens(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda t: len(t) >= 3)"


def rule_broken(rule: str, c: str) -> str:
    phrases = lambda items: quoted("(?i)" + "|".join(i for i in items))
    start = f"ltrim({c}, chr(32) || chr(10) || chr(9) || chr(13))"
    disclaimers = [d if "no pitch" not in d else r"\bno pitch\b" for d in DISCLAIMERS]
    return {
        "no-signal": rf"regexp_matches({c}, '(?i)\bsignals?\b')",
        "no-start-with-i": rf"regexp_matches({start}, '^I(\s|$)')",
        "no-disclaimers": f"regexp_matches({c}, {phrases(disclaimers)})",
        "no-dash-punctuation": rf"regexp_matches({c}, '\s[-–—]{{1,2}}\s')",
        "no-connect-filler": f"regexp_matches({c}, {phrases(CONNECT_FILLERS)})",
        "start-with-hello": rf"regexp_matches({start}, '(?i)^(hi|hey|dear|good morning|good afternoon|good evening)\b')",
        "no-company-tld": rf"regexp_matches({c}, '(?i)\b[A-Za-z][A-Za-z0-9-]*\.(com|io|ai|co|app|dev|so|xyz|net|org)\b')",
        "specific-cta": f"regexp_matches({c}, {phrases(VAGUE_ASKS)})",
    }[rule]


def rule_fix(rule: str, c: str) -> str | None:
    start = f"ltrim({c}, chr(32) || chr(10) || chr(9) || chr(13))"
    return {
        "no-signal": rf"regexp_replace({c}, '(?i)\bsignals?\b', 'indicator', 'g')",
        "no-start-with-i": f"CASE WHEN starts_with({start}, 'I ') THEN 'Hello, i' || substr({start}, 2) ELSE {c} END",
        "no-dash-punctuation": rf"regexp_replace({c}, '\s[-–—]{{1,2}}\s', '. ', 'g')",
        "start-with-hello": rf"regexp_replace({start}, '(?i)^(hi|hey|dear|good morning|good afternoon|good evening)\b', 'Hello')",
        "no-company-tld": rf"regexp_replace({c}, '(?i)\b([A-Za-z][A-Za-z0-9-]*)\.(com|io|ai|co|app|dev|so|xyz|net|org)\b', '\1', 'g')",
    }.get(rule)


def broken_list(c: str) -> str:
    items = ", ".join(f"CASE WHEN {rule_broken(r, c)} THEN '{r}' END" for r in RULE_NAMES)
    return f"array_to_string(list_filter([{items}], lambda r: r IS NOT NULL), ',')"
