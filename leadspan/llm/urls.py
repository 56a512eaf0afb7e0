"""Url filters: rules by host and path, and a cascade of Bloom filters over the hosts of the corpus.

The cascade stores a set of listed keys exactly, relative to a universe that is known completely. Level 1 is a Bloom
filter of the listed keys; level 2 holds the other keys of the universe that level 1 lets through, level 3 the listed
keys that level 2 lets through, and so on until a level lets nothing through wrongly. A key is listed if the first level
that does not contain it is an even one. Everything is DataFrame expressions; a level is an array of 64-bit words for each shard of
the keys, so its size is known before it is made.

Where the words of all levels together stay below ``LITERAL_BYTES`` they are read by the pages as scalar values, without a
join. Beyond that the pages take the words of their shard by an equi-join on the shard number.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.session import cut_lineage

# Fixed rules: verdict, host (with its subdomains), start of the path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"

SHARD_KEYS = 1 << 16  # listed keys of a shard, on average
FIRST_BITS, FIRST_HASHES = 10, 5  # per key, level 1
LATER_BITS, LATER_HASHES = 4, 2
LITERAL_BYTES = 16 << 20


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return text, verdict


class Level(NamedTuple):
    words: DataFrame  # (shard, words)
    bits: int
    hashes: int


class Cascade(NamedTuple):
    levels: tuple[Level, ...]
    shards: int

    @property
    def size(self) -> int:
        return sum(level.bits for level in self.levels) * self.shards // 8


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)).cast("int")


def _places(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(number * 16 + j), key), F.lit(bits)) for j in range(hashes)]


def _contains(words: Column, key: Column, number: int, level: Level) -> Column:
    found = F.lit(True)
    for place in _places(key, number, level.bits, level.hashes):
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        found = found & (F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    return found


def _level(keys: DataFrame, number: int, bits: int, hashes: int, shards: int) -> Level:
    places = keys.select("shard", F.explode(F.array(*_places(F.col("key"), number, bits, hashes))).alias("place"))
    ones = places.select("shard", F.shiftright("place", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(63).cast("int")).alias("bit"))
    empty = keys.sparkSession.range(shards * (bits // 64)).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("word"), F.lit(0).cast("bigint").alias("bit"))
    filled = ones.union(empty).groupBy("shard", "word").agg(F.bit_or("bit").alias("bits"))
    # an array has bits / 64 words, however many keys were put in
    arrays = filled.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("sorted"))
    return Level(cut_lineage(arrays.select("shard", F.col("sorted.bits").alias("words"))), bits, hashes)


def _with_words(rows: DataFrame, cascade: Cascade, names: Sequence[str], literal_bytes: int) -> DataFrame:
    """Adds the words of each level for the row's shard (column ``shard``)."""
    if cascade.size <= literal_bytes:
        for name, level in zip(names, cascade.levels):
            whole = level.words.agg(F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("sorted")).select(F.col("sorted.words"))
            rows = rows.withColumn(name, F.get(whole.scalar(), F.col("shard")))
        return rows
    for name, level in zip(names, cascade.levels):
        rows = rows.join(level.words.withColumnRenamed("words", name), "shard")
    return rows


def build(universe: DataFrame, shard_keys: int = SHARD_KEYS, literal_bytes: int = LITERAL_BYTES) -> Cascade:
    """The cascade of ``universe`` (key, listed), which must have every key that will be asked for, once.

    Null keys are not allowed; an empty universe or one without listed keys gives one empty level.
    """
    n_listed = universe.filter("listed").count()
    shards = max(1, -(-n_listed // shard_keys))
    keys = cut_lineage(universe.select("key", "listed", _shard(F.col("key"), shards).alias("shard")))
    inside, outside, levels = keys.filter("listed"), keys.filter("NOT listed"), []
    while True:
        most = inside.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
        per_key, hashes = (FIRST_BITS, FIRST_HASHES) if not levels else (LATER_BITS, LATER_HASHES)
        bits = max(1, -(-most * per_key // 64)) * 64
        number = len(levels)
        level = _level(inside, number, bits, hashes, shards)
        levels.append(level)
        checked = _with_words(outside, Cascade((level,), shards), ["_words"], literal_bytes)
        passed = cut_lineage(checked.filter(_contains(F.col("_words"), F.col("key"), number, level)).select("key", "listed", "shard"))
        if passed.isEmpty():
            return Cascade(tuple(levels), shards)
        inside, outside = passed, inside


def is_listed(rows: DataFrame, key: str, cascade: Cascade, name: str = "listed", literal_bytes: int = LITERAL_BYTES) -> DataFrame:
    """Adds the boolean ``name``: whether the row's ``key`` is a listed one. Exact for keys of the universe."""
    names = [f"_words{i}" for i in range(len(cascade.levels))]
    given = _with_words(rows.withColumn("shard", _shard(F.col(key), cascade.shards)), cascade, names, literal_bytes)
    answer = F.lit(len(cascade.levels) % 2 == 1)
    for i in reversed(range(len(cascade.levels))):
        answer = F.when(~_contains(F.col(names[i]), F.col(key), i, cascade.levels[i]), F.lit(i % 2 == 1)).otherwise(answer)
    return given.withColumn(name, answer).drop("shard", *names)


def listed_hosts(ruled: DataFrame) -> DataFrame:
    """(key, listed) for every host: listed where block rules hit half of its pages or more."""
    blocked = F.sum(F.when(F.col("by_rule") == "block", 1).otherwise(0))
    return ruled.groupBy(F.col("host").alias("key")).agg((2 * blocked >= F.count(F.lit(1))).alias("listed"))


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, universe: DataFrame | None = None, shard_keys: int = SHARD_KEYS, literal_bytes: int = LITERAL_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    The verdict is the longest fitting rule's, else block for listed hosts and allow for others. ``universe`` (key, listed)
    says which hosts are listed, by default ``listed_hosts``. Null urls and urls without :// have empty host and path;
    they are judged like any other host. Repeated rows are judged alike, other columns are not read, an empty table
    gives no rows.
    """
    parts = pages.select(F.col(id_column).alias("page_id"), host(F.col(url_column)).alias("host"), path(F.col(url_column)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    cascade = build(listed_hosts(ruled) if universe is None else universe, shard_keys, literal_bytes)
    known = is_listed(ruled, "host", cascade, "listed", literal_bytes)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return known.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "listed")


ORACLE = """
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(action, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT DISTINCT host, path, first_value(rule_host || rule_path) OVER w AS rule, first_value(action) OVER w AS action
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  WINDOW w AS (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC)),
ruled AS (SELECT p.*, f.rule, f.action FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path),
hosts AS (SELECT host, 2 * count(*) FILTER (action = 'block') >= count(*) AS listed FROM ruled GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(action, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM ruled r JOIN hosts h ON r.host = h.host
"""
