"""Raw html to markdown-like text, with regular expressions inside Spark's own code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspan.functions.normalize import wide_trim
from leadspan.functions.similarity import once

# Patterns and what takes their place, in order.
HTML_STEPS = [
    (r"(?i)<script[\s\S]*?</script>", ""),
    (r"(?i)<style[\s\S]*?</style>", ""),
    (r"(?i)<noscript[\s\S]*?</noscript>", ""),
    (r"(?i)<h1[^>]*>([\s\S]*?)</h1>", "\n# $1\n"),
    (r"(?i)<h2[^>]*>([\s\S]*?)</h2>", "\n## $1\n"),
    (r"(?i)<h3[^>]*>([\s\S]*?)</h3>", "\n### $1\n"),
    (r"(?i)<h4[^>]*>([\s\S]*?)</h4>", "\n#### $1\n"),
    (r"(?i)</p>", "\n\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</div>", "\n"),
    (r'(?i)<a[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>', "[$2]($1)"),
    (r"(?i)<(strong|b)[^>]*>([\s\S]*?)</\1>", "**$2**"),
    (r"(?i)<(em|i)[^>]*>([\s\S]*?)</\1>", "*$2*"),
    (r"(?i)<li[^>]*>([\s\S]*?)</li>", "- $1\n"),
    (r"<[^>]+>", ""),
]
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
# Patterns of two tags whose openings begin other tags too (<body>, <img>), most of them never closed.
PAIRED = {r"(?i)<(strong|b)[^>]*>([\s\S]*?)</\1>": ("strong", "b"), r"(?i)<(em|i)[^>]*>([\s\S]*?)</\1>": ("em", "i")}
MARK = "\ue000"
TRUNCATION_NOTE = "\n\n[Content truncated at 50,000 characters]"


def _replace_paired(html: Column, pattern: str, replacement: str) -> Column:
    """``regexp_replace`` in time that grows with the text: openings behind their last closing tag cannot match and are marked, so
    that none of them is followed to the end of the text. A text that has the mark itself is left to the plain pattern."""

    def mark(whole: Column, name: str) -> Column:
        behind = lambda s: F.concat(F.substr(s["all"], F.lit(1), s["n"]), F.regexp_replace(F.substr(s["all"], s["n"] + 1), rf"(?i)<({name})", f"<{MARK}$1"))
        return once(F.struct(whole.alias("all"), F.length(F.regexp_extract(whole, rf"(?is)\A.*</{name}>", 0)).alias("n")), behind)

    def marked(whole: Column) -> Column:
        one, two = PAIRED[pattern]
        both = once(mark(whole, one), lambda t: mark(t, two))
        return F.replace(F.regexp_replace(both, pattern, replacement), F.lit("<" + MARK), F.lit("<"))

    return once(html, lambda t: F.when(t.contains(MARK), F.regexp_replace(t, pattern, replacement)).otherwise(marked(t)))


def html_to_markdown(html: Column, max_chars: int | None = None) -> Column:
    """Markdown-like text of a page. The whole text is kept unless ``max_chars`` (50,000 for parity) is given."""
    out = html
    for pattern, replacement in HTML_STEPS:
        out = _replace_paired(out, pattern, replacement) if pattern in PAIRED else F.regexp_replace(out, pattern, replacement)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = wide_trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))
    if max_chars is not None:
        out = F.when(F.length(out) > max_chars, F.concat(F.substring(out, 1, max_chars), F.lit(TRUNCATION_NOTE))).otherwise(out)
    return out
