"""Quality rules as a short-circuit cascade.

Every rule rejects a text by itself and a text is kept if none rejects it, so any order gives the same verdict. The order
decides the cost: on a sample each rule's time per text and the set of rules that reject each text are measured, then
rules are taken greedily by the share of the still unrejected sample that they reject, per second.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspan.llm.texts import SPACES, given_id, known_id, words_of

SYMBOLS = "#*$%&|<>"
LETTERS_UPPER = 0.4  # share of upper-case letters above which a text is shouted
SAMPLE_ROWS = 2000


class Text:
    """A text with what rules need of it, worked out when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        covered = bytearray(len(w))
        for i, window in enumerate(windows):
            if times[window] > 1:
                covered[i : i + 3] = b"\x01\x01\x01"
        return sum(covered)


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


def _shouted(t: Text) -> bool:
    upper = sum(map(str.isupper, t.text))
    return upper > LETTERS_UPPER * max(1, sum(map(str.isalpha, t.text)))


def _wordless(t: Text) -> bool:
    lettered = sum(1 for w in t.words if any(map(str.isalpha, w.decode("utf-8", "surrogatepass"))))
    return 10 * lettered < 7 * t.n_words


BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("exclamations", lambda t: 5 * t.text.count("!") > t.n_words),
    Rule("shouted", _shouted),
    Rule("repeated_lines", lambda t: len(t.lines) >= 4 and 2 * t.n_dup_lines > len(t.lines)),
    Rule("one_word", lambda t: t.n_words > 0 and 10 * Counter(t.words).most_common(1)[0][1] > 3 * t.n_words),
    Rule("wordless", _wordless),
    Rule("word_length", lambda t: not 3 * t.n_words <= t.word_chars <= 12 * t.n_words),
)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows picked by hash, the same ones in every run; all rows of a small table."""
    every = max(1, docs.count() // rows)
    return docs.filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if kind in ("bigint", "int", "string")]), F.lit(every)) == 0)


def estimate(docs: DataFrame, text_column: str = "text", rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> tuple[list[float], dict[int, int]]:
    """Seconds that each rule took over the sample, and how many sampled texts each set of rules (a bit mask) rejects."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                mask, spent = 0, []
                for i, rule in enumerate(rules):
                    t = Text(text)
                    _ = t.words  # words are needed by nearly all rules and count for none
                    start = time.perf_counter()
                    mask |= rule.rejects(t) << i
                    spent.append(time.perf_counter() - start)
                out.append((mask, *spent))
            yield pd.DataFrame(out, columns=["mask", *[f"c{i}" for i in range(len(rules))]])

    costs = ", ".join(f"c{i} double" for i in range(len(rules)))
    measured = sample(docs, rows).select(F.col(text_column).alias("text")).mapInPandas(measure, f"mask bigint, {costs}")
    found = measured.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))]).collect()
    return [sum(r[f"c{i}"] for r in found) for i in range(len(rules))], {r["mask"]: r["n"] for r in found}


def order(costs: Sequence[float], masks: dict[int, int]) -> list[int]:
    """Rules by rejection per cost among the texts that the rules before them leave; cheap ones first among those that reject none."""
    left, todo, chosen = dict(masks), set(range(len(costs))), []
    while todo:
        best = max(todo, key=lambda i: (sum(n for m, n in left.items() if m >> i & 1) / max(costs[i], 1e-9), -costs[i], -i))
        chosen.append(best)
        todo.remove(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return chosen


def cascade(docs: DataFrame, text_column: str = "text", rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in the order estimated on ``docs``; the given order for an empty table."""
    costs, masks = estimate(docs, text_column, rules, rows)
    return tuple(rules[i] for i in order(costs, masks)) if masks else tuple(rules)


def rejected_by(ordered: Sequence[Rule], text: str | None) -> str | None:
    """Name of the first rule that rejects the text; later rules are not run. None: kept."""
    t = Text(text)
    return next((r.name for r in ordered if r.rejects(t)), None)


def keep(ordered: Sequence[Rule], text: Column) -> Column:
    """Whether the cascade keeps the text."""

    @F.pandas_udf(T.BooleanType())
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([rejected_by(ordered, t) is None for t in texts], dtype=bool)

    return kept(text)


def filter_quality(docs: DataFrame, text_column: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns.

    Null and empty texts have no words and are rejected; repeated rows get the same verdict; other columns do not matter.
    """
    return docs.filter(keep(cascade(docs, text_column, rules), F.col(text_column)))


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept.

    A text that fails a base rule skips the cascade. Null: no words, all counts 0, base_failed.
    """
    rest = tuple(r for r in cascade(docs, text_column, rules) if r not in BASE_RULES)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                t = Text(text)
                failed = any(r.rejects(t) for r in BASE_RULES)
                kept = not failed and not any(r.rejects(t) for r in rest)
                out.append((key, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
            yield pd.DataFrame(out, columns=columns)

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    kinds = ["bigint"] * 6 + ["boolean"] * 2
    source = docs.select(known_id(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInPandas(count, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds))).withColumn("doc_id", given_id("doc_id"))
