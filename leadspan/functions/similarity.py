"""String, name, keyword and vector similarity as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspan.functions.normalize import fold_accents, text, wide_trim


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out one time, however often the expression names it."""
    return F.transform(F.array(value), use)[0]


def _pieces(s: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: s.substr(i, F.lit(2)))
    return F.when(F.length(s) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def bigram_set(c: Column) -> Column:
    return once(wide_trim(F.lower(text(c))), _pieces)


def dice_of_sets(x: Column, y: Column) -> Column:
    total = F.size(x) + F.size(y)
    shared = F.size(F.array_intersect(x, y))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(2.0 * shared, total.cast("double")))


def dice(a: Column, b: Column) -> Column:
    """Dice on sets of two-letter pieces; equal ignoring case is 1, one empty side is 0."""
    return (
        F.when(F.lower(text(a)) == F.lower(text(b)), F.lit(1.0))
        .when((text(a) == "") | (text(b) == ""), F.lit(0.0))
        .otherwise(dice_of_sets(bigram_set(a), bigram_set(b)))
    )


def field_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), "^_|_$", "")


def field_sim(a: Column, b: Column) -> Column:
    """Similarity of two field names: equal 1, one inside the other 0.85, else Dice (0 without pieces)."""

    def of_sets(s: Column) -> Column:
        return F.when((F.size(s["x"]) == 0) | (F.size(s["y"]) == 0), F.lit(0.0)).otherwise(dice_of_sets(s["x"], s["y"]))

    def of_names(n: Column) -> Column:
        x, y = n["x"], n["y"]
        sets = F.struct(bigram_set(x).alias("x"), bigram_set(y).alias("y"))
        return F.when(x == y, F.lit(1.0)).when(x.contains(y) | y.contains(x), F.lit(0.85)).otherwise(once(sets, of_sets))

    return once(F.struct(field_name(a).alias("x"), field_name(b).alias("y")), of_names)


def name_match(a: Column, b: Column) -> Column:
    """1 equal, 0.9 every part found, 0.85 first and last equal, else 0; accents ignored."""
    x, y = fold_accents(a), fold_accents(b)
    px, py = F.split(x, r"\s+"), F.split(y, r"\s+")
    covered = F.forall(px, lambda p: F.exists(py, lambda q: q.contains(p) | p.contains(q)))
    ends = (px[0] == py[0]) & (F.element_at(px, -1) == F.element_at(py, -1))
    two = F.size(px) >= 2
    return (
        F.when(x == y, F.lit(1.0)).when(two & covered, F.lit(0.9))
        .when(two & (F.size(py) >= 2) & ends, F.lit(0.85)).otherwise(F.lit(0.0))
    )


def title_has_name(title: Column, name: Column) -> Column:
    low, parts = fold_accents(title), F.split(fold_accents(name), r"\s+")
    found = lambda p: (F.length(p) > 1) & low.contains(p)
    return F.when(F.size(parts) >= 2, found(parts[0]) & found(F.element_at(parts, -1))).otherwise(F.forall(parts, found))


def keyword_score(query_tokens: Column, content_tokens: Column) -> Column:
    hits = F.size(F.array_intersect(query_tokens, content_tokens))
    scale = F.greatest(F.lit(1.0), F.log2(F.size(content_tokens) + 2.0))
    return F.when((F.size(query_tokens) == 0) | (F.size(content_tokens) == 0), F.lit(0.0)).otherwise(hits / scale)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, null when the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, F.try_divide(dot(a, b), norm)).otherwise(F.lit(0.0)))
