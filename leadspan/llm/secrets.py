"""Secret scan: fixed patterns, and random strings found by how badly a subword vocabulary compresses them.

Spans are (kind, start, end) in code points, the end exclusive. The kinds in order:

* ``assign``, ``access``, ``hex``: the base patterns, leftmost and non-overlapping per kind.
* ``random``: a run of key characters with few characters per token under a byte-pair vocabulary. Words and identifiers
  are made of long tokens; random strings fall into pieces of one or two characters. Runs that touch a base span are
  left to it, and known digests and identifiers are excluded: hexadecimal digests, UUIDs, numbers, urls, mail
  addresses, file names and names joined from words.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.llm.texts import given_id, known_id

# Fixed patterns of the scan: kind, pattern, group that is measured, least number of characters.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = (*[b[0] for b in BASE], "random")
# Quick forms with the same matches: only runs that are long enough are looked at.
QUICK = {"access": re.compile(r"AKIA[A-Z0-9]{16,}"), "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_CLASSES = 2  # of lower case, upper case, digits, signs; one of them digits or mixed case
CHARS_PER_TOKEN = 2.2
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
PIECES = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]+")
# What shows that a run beside a dot or an at sign is part of an address or a file name.
ENDS = "com|org|net|edu|gov|info|io|dev|app|co|ai|eu|de|fr|es|it|uk|us|nl|ch|at|pl|ru|jp|cn|br|au|ca|in"
SUFFIXES = "html?|php|aspx?|jsp|js|ts|css|json|xml|ya?ml|csv|tsv|txt|md|pdf|docx?|xlsx?|pptx?|png|jpe?g|gif|svg|webp|ico|mp[34]|wav|avi|mov|zip|gz|tgz|bz2|xz|tar|jar|exe|dll|so|bin|py|rb|go|rs|java|c|h|cpp|sh|sql|log|parquet|pem|crt|key"
URL = re.compile(r"(?:[a-z]://|(?<!\S)www\.)[^?#\s]*$", re.IGNORECASE)  # what follows is in the host or the path
URL_END = re.compile(r"[?#\s]")
MAIL = re.compile(r"@[A-Za-z0-9-]+\.[A-Za-z]")
SUFFIX = re.compile(rf"\.(?:{ENDS}|{SUFFIXES})(?![A-Za-z0-9+/_=-])", re.IGNORECASE)
HOST_END = re.compile(rf"(?:{ENDS})/")
HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?![A-Za-z0-9+_=])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """A tiktoken encoding of the ranks in ``path``; kept for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern, group, least in BASE:
        for m in QUICK.get(kind, pattern).finditer(text):
            if len(m[group]) >= least:
                found.append((kind, m.start(), m.end()))
    return found


def wordy(run: str) -> bool:
    """Whether most letters and digits stand in words or numbers."""
    return sum(map(len, PIECES.findall(run))) >= 0.7 * sum(map(str.isalnum, run))


def address(run: str, text: str, start: int, in_url: bool) -> bool:
    """Whether the run of ``text`` at ``start`` is part of a url, host, mail address or file name."""
    end, before = start + len(run), text[max(0, start - 1) : start]
    after = text[end : end + 2]
    beside = before in ("@", ".") or after[:1] == "@" or after[:1] == "." and after[1:2].isalnum()
    if not beside and not run.startswith("//") and run.count("/") <= 3:
        return False
    if run.startswith("//") or in_url or wordy(run):
        return True
    return beside and bool(MAIL.match(text, end) or SUFFIX.match(text, end) or before == "." and HOST_END.match(run) or before == "@" and HOST.match(text, start))


def known_identifier(run: str, text: str, start: int, in_url: bool) -> bool:
    """Digests, UUIDs, numbers, parts of urls, mail addresses and file names, and names joined from words."""
    if HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run) or 4 * sum(map(str.isdigit, run)) >= 3 * sum(map(str.isalnum, run)):
        return True
    if address(run, text, start, in_url):
        return True
    return sum(map(len, PIECES.findall(run))) >= 0.8 * len(run) and len(PIECES.findall(run)) <= len(run) // 5


def random_spans(text: str, taken: list[tuple[str, int, int]], path: str, chars_per_token: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    found, at, in_url = [], 0, False
    for m in CANDIDATE.finditer(text):
        run = m[0]
        in_url = bool(URL.search(text, max(0, at - 2), m.start())) or in_url and not URL_END.search(text, at, m.start())
        at = m.start()
        classes = [bool(re.search(c, run)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[+/_=-]")]
        if sum(classes) < LEAST_CLASSES or not (classes[2] or classes[0] and classes[1]):
            continue
        if any(a < m.end() and m.start() < b for _, a, b in taken) or known_identifier(run, text, m.start(), in_url):
            continue
        if len(run) < chars_per_token * len(vocabulary(path).encode_ordinary(run)):
            found.append(("random", m.start(), m.end()))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` in order of start, then kind as listed."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary_path: str | None = None, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end), base_sha256.

    Null and empty texts have no span; repeated rows are scanned alike; other columns are not read; an empty table gives
    no rows. Long texts are scanned whole. ``base_sha256`` is over the base spans only, as ``joined`` writes them.
    """
    path = vocabulary_path or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans, digests = [], []
            for text in batch["text"]:
                base = base_spans(text) if text else []
                extra = random_spans(text, base, path, chars_per_token) if text else []
                ordered = sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in ordered])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans, "base_sha256": digests})

    rows = docs.select(known_id(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(run, f"doc_id bigint, spans {SPANS}, base_sha256 string").withColumn("doc_id", given_id("doc_id"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """``scan`` with counts of the base kinds and all spans as one string."""
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scan(docs, **options).select("doc_id", *[number(k) for k, *_ in BASE], "base_sha256", text.alias("spans"), number("random"))
