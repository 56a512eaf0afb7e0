"""Toxicity scores over deobfuscated text.

A written token is taken as the output of a noisy channel: letters may have been swapped for look-alikes, repeated, or
set apart by separators. A lattice holds the letters each character may stand for and Viterbi decoding finds the reading
that is likeliest under the channel and a character trigram model of the corpus (counts over all documents). Plain words
have one reading and are left as they are.

The score looks at restored words. A word's evidence is a cautious log odds ratio (one standard error below the estimate)
of toxic against clean training documents that have it, or its stem (the first 4 to 7 letters, where several frequent words
share them), whichever says most. The sum of a document's three strongest words goes through a logistic curve fitted on
training documents, each without its own counts.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add, eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.llm.texts import MAP_BITS, bit_map, given_id, identity, scratch

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}  # 0: anything else, a word's edge
K = len(LETTERS) + 1

# Fixed look-alikes: what a character may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
SEPARATORS = " .-_*~'`,"
# Channel costs, natural logarithms.
SWAP, REPEAT, SEPARATE, KEEP_SPACE, DROP_EDGE, DROP, AS_IS = -1.0, -1.0, -0.5, -3.0, -1.0, -14.0, -15.0

OUTER = ".,;:?\"'()[]{}«»“”‘’…–—"
TRAILING = frozenset("*%&$#!|<>~=-")  # a run of one of them at the end
LONG_RUN = re.compile(r"(.)\1+")
SPACED = re.compile(r"(?<!\S)\S(?:[ ._-]\S){2,}(?!\S)")
MAY_BE_SPACED = re.compile(r"\s\S[ ._-]\S[ ._-]\S")  # of which a text with a blank before it has one at least, and that is found faster
MEANT = set(CODES) | set(LOOKS)
REMEMBERED = 300_000  # tokens per worker
HELD_FEATURES = 500_000  # of most evidence, at most about, that tasks hold; the others are met in a join

LEAST = 2  # toxic documents that a feature must occur in, whatever the corpus
HELD_ROWS = 500_000  # that a task holds before it hands them on
STEMS = (4, 5, 6, 7)
STEM_WORDS = 3  # frequent words that have to share a stem
STRONGEST = 3  # words that the score adds up
FIT_ROWS = 20_000  # labelled training rows, at most about, that the logistic curve is fitted on


def count_trigrams(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams, words' edges included, as a K x K x K array laid flat."""
    chars = np.frombuffer("\n\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    table = np.zeros(0x180, dtype=np.int64)
    for c, code in CODES.items():
        table[ord(c)] = code
    codes = table[np.minimum(chars, 0x17F)] * (chars < 0x180)
    kept = np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])  # one edge between words is enough
    codes = np.concatenate([[0], codes[kept]])
    first = np.where(codes[1:-1] > 0, codes[:-2], 0)  # what stands before an edge does not matter to the next word
    return np.bincount((first * K + codes[1:-1]) * K + codes[2:], minlength=K**3)


def character_model(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Log probabilities [a, b, c] of c after a b, from counts over all texts; at most K ** 3 rows come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(K**3, dtype=np.int64)
        for batch in batches:
            total += count_trigrams([t for t in batch["text"] if t])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"trigram": some, "n": total[some]})

    found = docs.select(F.col(text_column).alias("text")).mapInPandas(count, "trigram bigint, n bigint").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(K**3)
    counts[found["trigram"].to_numpy(np.int64)] = found["n"]
    counts = counts.reshape(K, K, K)
    pairs = counts.sum(axis=0)
    single = (pairs.sum(axis=0) + 1) / (pairs.sum() + K)
    after_one = (pairs + 5 * single) / (pairs.sum(axis=1, keepdims=True) + 5)
    after_two = (counts + 5 * after_one[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return np.log(after_two).astype(np.float32)


def _settle(letters: list[str], path: tuple | None) -> None:
    found = []
    while path is not None:
        path, out = path
        found.append(out)
    letters += reversed(found)


class Restorer:
    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()

    def decode(self, token: str) -> str:
        """The likeliest reading of a lower-case token; a space in it marks where a separator was kept.

        Where all readings have come down to one state, its letters are settled and the next plain letters just follow.
        """
        model, last, i = self.model, len(token) - 1, 0
        letters: list[str] = []
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # readings as (rest, last letter)
        while i <= last:
            if len(states) == 1:
                (((a, b), (score, path)),) = states.items()
                _settle(letters, path)
                while i <= last and (code := CODES.get(token[i])):
                    if not i or token[i] != token[i - 1]:
                        score += model[a][b][code]
                        letters.append(token[i])
                        a, b, i = b, code, i + 1
                    elif i < last and a != b == code != (following_code := CODES.get(token[i + 1], code)):  # twice the same letter, then another
                        kept, once = score + model[a][b][b] + model[b][b][following_code], score + REPEAT + model[a][b][following_code]
                        letters += token[i + 1] if once > kept else token[i : i + 2]
                        score, a, b, i = max(kept, once), b, following_code, i + 2
                    else:
                        break
                states = {(a, b): (score, None)}
                if i > last:
                    break
            ch = token[i]
            if ch in CODES:
                options = [(ch, 0.0)]
            else:
                options = [(s, SWAP) for s in LOOKS.get(ch, "")] + [(" " if ch == " " else ch, AS_IS if ch != " " else KEEP_SPACE)]
                options.append(("", SEPARATE if ch in SEPARATORS else DROP_EDGE if i in (0, last) and not ch.isalnum() else DROP))
            if i and ch == token[i - 1]:
                options.append(("", REPEAT))
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                after = model[a][b]
                for out, cost in options:
                    if out:
                        code = CODES.get(out, 0)
                        state, value = (b if code else 0, code), score + cost + after[code]
                    else:
                        state, value = (a, b), score + cost
                    if state not in following or value > following[state][0]:
                        following[state] = (value, (path, out) if out else path)
            states, i = following, i + 1
        _settle(letters, max(((score + model[a][b][0], path) for (a, b), (score, path) in states.items()), key=lambda r: r[0])[1])
        return "".join(letters)

    def words(self, token: str) -> list[str]:
        """Restored words of one lower-case token."""
        core = token.strip(OUTER)
        plain = core.rstrip(core[-1]) if core and core[-1] in TRAILING else core
        if plain.isalpha() and True not in map(eq, plain, plain[1:]):  # no run of a letter
            return [plain] if plain == core or plain + "!" != core else [plain, *self.decode(core).split()]
        if len(core) < 2 or MEANT.isdisjoint(core):
            return [plain] if plain else []
        return [w for w in dict.fromkeys([plain, *self.decode(core).split()]) if w]

    def spaced(self, text: str) -> list[str]:
        """Words spelt with a separator after each character."""
        return [w for m in SPACED.finditer(text) for w in self.decode(m[0]).split()] if MAY_BE_SPACED.search(" " + text) else []


def features(word: str) -> list[str]:
    """A word and its first letters; the latter end in a star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


class Counts:
    """feature, a, b: toxic and clean training documents that have a feature, as a Spark table; equal if its rows are."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Counts) and self.table.exceptAll(other.table).isEmpty() and other.table.exceptAll(self.table).isEmpty()


class Model(NamedTuple):
    """Counts by feature (None without both kinds of label), toxic and clean training documents, and the logistic curve."""

    trigrams: np.ndarray
    counts: Counts | None
    toxic: int
    clean: int
    slope: float
    offset: float


def evidence(toxic: int, clean: int, without: Column | None = None) -> Column:
    """Of a feature with the counts ``a`` and ``b``. ``without``: the label of a document whose own counts are left out."""
    one, zero = (F.coalesce(without == v, F.lit(False)).cast("int") if without is not None else F.lit(0) for v in (1, 0))
    a, b = F.col("a") - one + 0.5, F.col("b") - zero + 0.5
    return F.log(a / (toxic - one + 1)) - F.log(b / (clean - zero + 1)) - F.sqrt(1 / a + 1 / b)


class Reader:
    """Documents as restored words, with what is known of a token kept for the next time."""

    def __init__(self, model: np.ndarray) -> None:
        self.restorer, self.known = Restorer(model), {}

    def words(self, text: str | None) -> set[str]:
        lower, out = (text or "").lower(), set()
        for token in set(lower.split()):
            found = self.known.get(token)
            if found is None:
                found = self.restorer.words(token)
                if len(self.known) < REMEMBERED:
                    self.known[token] = found
            out.update(found)
        out.update(self.restorer.spaced(lower))
        return out


def _hash(feature: str) -> int:
    """As Spark's xxhash64."""
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"), 42)


class Bits:
    """Features that may be in a bit map."""

    def __init__(self, words: np.ndarray) -> None:
        self.bits = words.astype("<u8").tobytes()

    def may(self, place: int) -> int:
        return self.bits[place >> 3] >> (place & 7) & 1


class Chooser(Reader):
    """Documents as features, with a bit map only those whose hash may be in it."""

    def __init__(self, model: np.ndarray, bits: np.ndarray | None = None) -> None:
        super().__init__(model)
        self.bits, self.chosen = bits if bits is None else Bits(bits), {}

    def _choose(self, words: list[str]) -> list[str]:
        return [f for w in words for f in features(w) if self.bits is None or self.bits.may(_hash(f) >> (64 - MAP_BITS))]

    def features(self, text: str | None) -> set[str]:
        lower, out = (text or "").lower(), set()
        for token in set(lower.split()):
            some = self.chosen.get(token)
            if some is None:
                some = tuple(self._choose(self.restorer.words(token)))  # the garbage collector leaves tuples of texts alone
                if len(self.chosen) < REMEMBERED:
                    self.chosen[token] = some
            if some:
                out.update(some)
        out.update(self._choose(self.restorer.spaced(lower)))
        return out


class Valuer(Reader):
    """Documents as their words with evidence: that of held features, and a bit map of those that are not held."""

    def __init__(self, model: np.ndarray, held: dict[str, float], rest: np.ndarray | None) -> None:
        super().__init__(model)
        self.held, self.rest, self.valued = held, rest if rest is None else Bits(rest), {}

    def _value(self, words: list[str]) -> list[tuple[str, float, tuple[str, ...]]]:
        """(word, its most evidence from held features or 0, features that may be among the others)."""
        out, get = [], self.held.get
        for w in words:
            best, others, size = get(w, 0.0), (), len(w)
            for n in STEMS:
                if size > n and (e := get(w[:n] + "*", 0.0)) > best:
                    best = e
            if self.rest:
                others = tuple(f for f in features(w) if f not in self.held and self.rest.may(_hash(f) >> (64 - MAP_BITS)))
            if best or others:
                out.append((w, best, others))
        return out

    def told(self, text: str | None) -> dict[str, tuple[float, tuple[str, ...]]]:
        lower, out = (text or "").lower(), {}
        for token in set(lower.split()):
            some = self.valued.get(token)
            if some is None:
                some = tuple(self._value(self.restorer.words(token)))
                if len(self.valued) < REMEMBERED:
                    self.valued[token] = some
            for w, best, others in some:
                out[w] = best, others
        for w, best, others in self._value(self.restorer.spaced(lower)):
            out[w] = best, others
        return out


_LAST: dict[str, tuple[str, Reader]] = {}  # of this worker, so that the next task knows what the last one has restored


def _reader(kind: type[Reader], key: str, *parts) -> Reader:
    if _LAST.get(kind.__name__, ("",))[0] != key:
        _LAST[kind.__name__] = key, kind(*parts)
    return _LAST[kind.__name__][1]


def _tally(rows: DataFrame, trigrams, bits=None) -> DataFrame:
    """(feature, a, b): toxic and clean documents that have each feature; with ``bits`` only of features that may be in it."""
    key = uuid.uuid4().hex

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, total = _reader(Chooser, key, trigrams.value, bits and bits.value), {}

        def table() -> pd.DataFrame:
            return pd.DataFrame([(f, n * y, n * (1 - y)) for y, counted in total.items() for f, n in counted.items()], columns=["feature", "a", "b"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                total.setdefault(int(toxic), Counter()).update(reader.features(text))
                if sum(map(len, total.values())) > HELD_ROWS:
                    yield table()
                    total.clear()
        if total:
            yield table()

    return rows.mapInPandas(count, "feature string, a bigint, b bigint").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _frequent(tally: DataFrame) -> DataFrame:
    """Features of ``LEAST`` toxic documents or more; stems are those shared by ``STEM_WORDS`` such words."""
    often = tally.filter(F.col("a") >= LEAST).select("feature")
    words = often.filter(~F.col("feature").endswith("*"))
    stems = F.explode(F.array_compact(F.array(*[F.when(F.length("feature") > n, F.concat(F.substring("feature", 1, n), F.lit("*"))) for n in STEMS])))
    shared = words.select(stems.alias("feature")).groupBy("feature").count().filter(F.col("count") >= STEM_WORDS)
    return words.union(often.filter(F.col("feature").endswith("*")).join(shared, "feature", "left_semi"))


def _stored(table: DataFrame, name: str) -> DataFrame:
    folder = scratch(table.sparkSession, name)
    table.write.parquet(folder)
    return table.sparkSession.read.parquet(folder)


def strengths(rows: DataFrame, model: Model, *kept: str, own: int | None = None) -> DataFrame:
    """``kept`` and x, the summed evidence of each row's strongest words; rows have _id, _content, text.

    ``own``: the label of documents whose own counts are left out. Tasks hold the ``HELD_FEATURES`` of most evidence. That settles
    documents with enough words of as much evidence as any other feature; for the rest, the features that may be among
    the others (a bit map tells) meet the counts in a join.
    """
    if model.counts is None:
        return rows.select(*kept, F.lit(0.0).alias("x"))
    spark = rows.sparkSession
    valued = model.counts.table.select("feature", evidence(model.toxic, model.clean, None if own is None else F.lit(own)).alias("e")).filter("e > 0")
    known, cut, rest = valued.count(), 0.0, None
    if known > HELD_FEATURES:
        cut = valued.approxQuantile("e", [1 - HELD_FEATURES / known], 0.001)[0]
        rest = bit_map(valued.filter(F.col("e") <= cut).select(F.xxhash64("feature").alias("hash")), "hash")
    held = valued.filter(F.col("e") > cut).toPandas()
    shared = spark.sparkContext.broadcast((model.trigrams, dict(zip(held["feature"], held["e"].tolist())), rest))
    key, keys = uuid.uuid4().hex, list(dict.fromkeys((*kept, "_id", "_content")))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(Valuer, key, *shared.value)
        for batch in batches:
            sums, strong, unsure = [], [], []
            for text in batch["text"]:
                told = reader.told(text)
                best = sorted(((e, n) for n, (e, _) in enumerate(told.values()) if e), reverse=True)[:STRONGEST]
                found = [] if len(best) == STRONGEST else [(n, f) for n, (_, some) in enumerate(told.values()) for f in some]
                sums.append(reduce(add, [e for e, _ in best], 0.0))  # as Spark adds up
                strong.append([{"word": n, "e": e} for e, n in best] if found else None)
                unsure.append([{"word": n, "feature": f} for n, f in found] if found else None)
            yield batch.drop(columns="text").assign(x=sums, strong=strong, unsure=unsure)

    texts = rows.select(*keys, "text")
    parts = ", ".join(f"`{n}` {t}" for n, t in texts.drop("text").dtypes)
    looked = texts.mapInPandas(look, f"{parts}, x double, strong array<struct<word: int, e: double>>, unsure array<struct<word: int, feature: string>>")
    if rest is None:
        return looked.select(*kept, "x")
    looked = _stored(looked, "toxicity-looked")
    more = looked.filter("unsure IS NOT NULL")
    others = more.select("_id", "_content", F.inline("unsure")).join(valued.filter(F.col("e") <= cut), "feature").select("_id", "_content", "word", "e")
    told = others.union(more.select("_id", "_content", F.inline("strong"))).repartition("_id", "_content")
    best = told.groupBy("_id", "_content", "word").agg(F.max("e").alias("e")).groupBy("_id", "_content").agg(F.slice(F.sort_array(F.collect_list("e"), False), 1, STRONGEST).alias("e"))
    total = best.select("_id", "_content", F.aggregate("e", F.lit(0.0), lambda x, y: x + y).alias("_x"))
    late = more.join(total, ["_id", "_content"], "left").select(*kept, F.coalesce("_x", F.lit(0.0)).alias("x"))
    return looked.filter("unsure IS NULL").select(*kept, "x").union(late)


def held_out(id_column: str = "doc_id"):
    """Documents that nothing is learned from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """The model from all texts (characters) and the labelled documents that are not held out (words).

    A document with several labels is toxic if one says so; labels without a document or value do not count. Without
    both kinds of label the score is the same for all documents.
    """
    spark = docs.sparkSession
    trigrams = character_model(docs, text_column)
    shared = spark.sparkContext.broadcast(trigrams)
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
    texts = docs.filter(~held_out(id_column)).select(*identity(id_column, text_column), F.col(text_column).alias("text"))
    folder = scratch(spark, "toxicity-training")
    # both sides grow with the corpus, so the plan is the same at every size
    texts.join(known.hint("merge"), "_id").select("_id", "_content", "text", "toxic").write.parquet(folder)
    rows = spark.read.parquet(folder)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        prior = (toxic + 0.5) / (toxic + clean + 1) if toxic + clean else 0.05
        return Model(trigrams, None, toxic, clean, 0.0, math.log(prior / (1 - prior)))
    frequent = _stored(_frequent(_stored(_tally(rows.filter("toxic = 1"), shared), "toxicity-tally")), "toxicity-features")
    bits = spark.sparkContext.broadcast(bit_map(frequent.select(F.xxhash64("feature").alias("hash")), "hash"))
    counts = _tally(rows, shared, bits).join(frequent, "feature", "left_semi").filter(evidence(toxic, clean) > 0)
    model = Model(trigrams, Counts(_stored(counts, "toxicity-counts")), toxic, clean, 0.0, 0.0)
    slope, offset = _fit(rows, model, sorted(sizes))
    return model._replace(slope=slope, offset=offset)


def _fit(rows: DataFrame, model: Model, labels: list[int]) -> tuple[float, float]:
    every = max(1, (model.toxic + model.clean) // FIT_ROWS)
    some = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(every)) == 0)
    sample = reduce(DataFrame.union, [strengths(some.filter(F.col("toxic") == y), model, "toxic", own=y) for y in labels]).withColumnRenamed("toxic", "y")
    binned = sample.groupBy(F.round("x", 2).alias("x"), "y").count().toPandas()  # a few thousand rows at most
    x, y, n = binned["x"].to_numpy(float), binned["y"].to_numpy(float), binned["count"].to_numpy(float)
    design, beta = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        gradient = design.T @ (n * (y - p)) - 0.1 * beta
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no evidence and get the curve's lowest score; repeated rows score alike; other columns are
    not read; an empty table gives no rows.
    """
    rows = docs.select(*identity(id_column, text_column), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    power = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(model.offset) + F.lit(model.slope) * F.col("x")))
    scored = strengths(rows, model, "_id", "held_out").withColumn("score", 1 / (1 + F.exp(-power)))
    return scored.select(given_id("_id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    return score(docs, train(docs, labels, **columns), **{k: v for k, v in columns.items() if k != "label_column"})
