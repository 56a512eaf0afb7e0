import zlib

import numpy as np
import pytest

from leadspan.llm import toxicity as t
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF
from tests.llm.conftest import ODD

SF01 = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def model(spark):
    return t.train(spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet"))


def test_held_out_accuracy(spark):
    rows = QUERIES["op4_toxicity"](spark, SF01).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.8
    assert np.mean([s < 0.5 for s in good]) > 0.97


def test_labels_of_held_out_documents_do_not_matter(spark, model):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    turned = labels.withColumn("toxic", t.F.when(t.held_out(), 1 - t.F.col("toxic")).otherwise(t.F.col("toxic")))
    other = t.train(spark.read.parquet(f"{SF01}/documents.parquet"), turned)
    assert other.counts == model.counts and (other.slope, other.offset) == pytest.approx((model.slope, model.offset))


@pytest.mark.parametrize("written", ["stup1d", "s7up!d", "$tupid", "stuuupid", "s-t-u-p-i-d", "st*pid", "stupid!!!", "STUP1D".lower()])
def test_restored_words(model, written):
    assert "stupid" in t.Reader(model.trigrams).words(f"and {written}, was")


def test_spelt_words(model):
    assert {"stupid"} <= t.Reader(model.trigrams).words("so s t u p i d of it")
    assert t.Reader(model.trigrams).words("plain words, here.") == {"plain", "words", "here"}


def test_decode_is_the_best_reading(model):
    """Viterbi against all readings of short tokens."""
    restorer = t.Restorer(model.trigrams)

    def readings(token):
        out = [("", 0.0)]
        for i, ch in enumerate(token):
            if ch in t.CODES:
                options = [(ch, 0.0)]
            else:
                options = [(s, t.SWAP) for s in t.LOOKS.get(ch, "")] + [(ch, t.AS_IS if ch != " " else t.KEEP_SPACE)]
                options.append(("", t.SEPARATE if ch in t.SEPARATORS else t.DROP_EDGE if i in (0, len(token) - 1) and not ch.isalnum() else t.DROP))
            if any(m.start() < i < m.end() for m in t.LONG_RUN.finditer(token)):
                options.append(("", t.REPEAT))
            out = [(a + o, c + k) for a, c in out for o, k in options]
        return out

    def likelihood(word):
        total, a, b = 0.0, 0, 0
        for ch in word:
            code = t.CODES.get(ch, 0)
            total += restorer.model[a][b][code]
            a, b = (b if code else 0), code
        return total + restorer.model[a][b][0]

    for token in ("1d1ot", "tr@$h", "s.t.o", "l000ser", "a!", "|1k3", "x"):
        assert restorer.decode(token) == max(readings(token), key=lambda r: r[1] + likelihood(r[0]))[0]


def test_character_counts():
    flat = t.count_trigrams(["Ab, a", "", "ba"]).reshape(t.K, t.K, t.K)
    a, b = t.CODES["a"], t.CODES["b"]
    want = {(0, 0, a): 2, (0, a, b): 1, (a, b, 0): 1, (0, a, 0): 1, (0, 0, b): 1, (0, b, a): 1, (b, a, 0): 1}
    assert {tuple(map(int, i)): int(flat[tuple(i)]) for i in np.argwhere(flat)} == want


def test_odd_rows(spark, odd, empty, model):
    rows = t.score(odd, model).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _ in ODD), key=repr)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert t.score(empty, model).collect() == []
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (99, 1), (2, None)], "doc_id bigint, toxic int")
    assert {r.predicted for r in t.toxicity(odd, labels).collect()} <= {0, 1}
    assert {r.predicted for r in t.toxicity(odd, labels.limit(0)).collect()} == {0}
    assert t.toxicity(empty, labels).collect() == []


def test_a_rare_toxic_word_counts_in_a_large_corpus(spark):
    """Two toxic documents are evidence, whether there are 10 or 1,000 toxic ones."""
    for size in (10, 1000):
        docs = [(i, f"common text number with vile{'x' if i % 2 else 'y'}") for i in range(size)] + [(i, "common text number with nothing") for i in range(size, 3 * size)]
        rare = [i for i in range(size) if zlib.crc32(str(i).encode()) % 5][:2]
        docs = [(i, "common text number with grobian" if i in rare else text) for i, text in docs] + [(10**6, "text with grobian")]
        table = spark.createDataFrame(docs, "doc_id bigint, text string")
        labels = spark.createDataFrame([(i, int(i < size)) for i, _ in docs[:-1]], "doc_id bigint, toxic int")
        scores = {r.doc_id: r.score for r in t.toxicity(table, labels).filter(f"doc_id = 1000000 OR doc_id = {size}").collect()}
        assert scores[10**6] > scores[size]


@pytest.mark.parametrize("written, word", [("y o u " + "a " * 120 + "s t u p i d", "stupid"), ("s" + "t" * 60 + "upid", "stupid"), ("s" + "-" * 60 + "tupid", "stupid"), ("ssttuuppiidd", "stupid"), ("@$$", "as")])
def test_whole_runs_and_tokens_are_decoded(model, written, word):
    found = t.Reader(model.trigrams).words(f"and {written} was")
    assert any(w.endswith(word) for w in found - {written})


def test_no_words_move_where_tasks_hold_all_features(spark, model):
    """Rows of (document, word, feature) were many times the texts on disk."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert "Exchange" not in t.score(docs, model)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [0, 50, 100_000])
def test_features_that_are_not_held_meet_the_counts_in_a_join(spark, model, odd, monkeypatch, held):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(300).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted(map(tuple, t.score(docs, model).collect()), key=repr)
    known = {r.feature: r.e for r in model.counts.table.select("feature", t.evidence(model.toxic, model.clean).alias("e")).collect() if r.e > 0}
    reader, strongest = t.Chooser(model.trigrams), {}
    for r in docs.collect():
        words = reader.words(r.text)
        strongest[r.doc_id, r.text] = sum(sorted((max(known.get(f, 0) for f in t.features(w)) for w in words), reverse=True)[: t.STRONGEST])
    rows = docs.select(*t.identity(), "text")
    monkeypatch.setattr(t, "HELD_FEATURES", held)
    assert sorted(map(tuple, t.score(docs, model).collect()), key=repr) == want
    got = sorted(r.x for r in t.strengths(rows, model).collect())
    assert got == pytest.approx(sorted(strongest[r.doc_id, r.text] for r in docs.collect()))
