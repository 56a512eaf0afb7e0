"""Term lists as tables against the literal form."""

import random

from pyspark.sql import functions as F

from leadspan.operators import filters as FL
from leadspan.operators.terms import texts_with_terms

WORDS = ["stark", "inc", "école", "a", "bb", "Sta", "nd co", "x.y", "%", "_", "ABC", "long term of words"]


def rows(spark, rng, n):
    text = lambda: rng.choice([None, "", "".join(rng.choice("abcinstrk éÉ.%_") for _ in range(rng.randrange(25))), "Stark Inc and co"])
    return spark.createDataFrame([(i, text(), text(), text()) for i in range(n)], "id long, company string, industry string, headline string")


def test_equal_to_the_literal_form(spark):
    rng = random.Random(4)
    df = rows(spark, rng, 400).cache()
    for terms in (WORDS, ["inc"], ["zzz"], ["é"], ["a", ""], [], [t for t in WORDS if len(t) > 2]):
        table = spark.createDataFrame([(t,) for t in [*terms, *terms, None]], "term string")
        for gate in (FL.gate_exclusion, FL.gate_company):
            assert {r.id for r in gate(df, table).collect()} == {r.id for r in gate(df, terms).collect()}, (gate, terms)


def test_a_long_list(spark):
    """A hundred thousand terms; texts hold a few of them, one text most rows."""
    terms = spark.range(100_000).select(F.concat(F.lit("term "), F.col("id"), F.lit(" end")).alias("term"))
    texts = ["nothing here", "Term 77 end.", "xterm 99999 end", "term 100000 end", "term 5 en", "TERM 5 END term 6 end"] + ["common text"] * 50
    found = texts_with_terms(spark.createDataFrame([(t,) for t in texts], "text string"), terms)
    assert {r.text for r in found.collect()} == {"Term 77 end.", "xterm 99999 end", "TERM 5 END term 6 end"}
