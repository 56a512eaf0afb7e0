import re

import numpy as np
import pytest

from leadspan.llm import mixing
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF
from tests.llm.conftest import COLUMNS, ODD, rows_of


def plain_targets(sizes):
    """Targets by source: shared by weight, excess above three times the size shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_mix_sources"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = {}
    for d in docs.values():
        sizes[d.source] = sizes.get(d.source, 0) + words(d.text)
    targets, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == words(d.text) and r.source_size == sizes[d.source] and abs(r.target - targets[d.source]) < 1e-6
        assert r.taken == r.size * r.copies and r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
        taken[d.source] += r.taken
    largest = {s: max(words(d.text) for d in docs.values() if d.source == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)
    assert sum(abs(taken[s] - targets[s]) for s in sizes) < 0.05 * sum(sizes.values())
    again = QUERIES["op9_mix_sources"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_many_rounds_keep_the_totals(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = mixing.copies(docs, block_units=8).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) < 0.1 * own[0].target


def test_odd_rows(spark, odd, empty):
    rows = mixing.taken_words(odd).collect()
    assert sorted(((r.doc_id, r.size) for r in rows), key=repr) == sorted(((i, words(t)) for i, t in ODD), key=repr)
    assert mixing.taken_words(empty).collect() == [] and mixing.mix(empty).columns == empty.columns
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in rows)
    nothing = spark.createDataFrame(rows_of([(1, None), (2, "")]) + rows_of([(3, " ")], None), COLUMNS)
    assert all(r.target == 0 and r.taken == 0 for r in mixing.taken_words(nothing).collect())


def test_sources_and_caps(spark):
    rows = rows_of([(1, "a b c d e f g h i j")], "B") + rows_of([(2, "a")], "a") + rows_of([(3, "a b")], None) + rows_of([(4, "a b c")], "é")
    got = {r.doc_id: r.target for r in mixing.taken_words(spark.createDataFrame(rows, COLUMNS)).collect()}
    want = plain_targets({"B": 10, "a": 1, None: 2, "é": 3})
    assert got == pytest.approx({1: want["B"], 2: want["a"], 3: want[None], 4: want["é"]})


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.lognormal(5, 1.3, 400).astype(int))[::-1]
    chances = rng.uniform(0.05, 0.95, 400)
    p = mixing.flight(sizes, chances, lambda i: mixing.unit_draw(7, i))
    open_ = (p > 0) & (p < 1)
    assert open_.sum() <= 2 and abs((p - chances).sum()) < 1e-6 and abs(((p - chances) * sizes).sum()) < 1e-3
    few = np.mean([mixing.flight(sizes[:12], chances[:12], lambda i: mixing.unit_draw(k, i)) for k in range(600)], axis=0)
    assert np.abs(few - chances[:12]).max() < 0.08
    for case in ([5] * 9, [0] * 9):
        p = mixing.flight(case, [0.5] * 9, lambda i: 0.3)
        assert abs(p.sum() - 4.5) < 1e-6 and ((p > 0) & (p < 1)).sum() <= 2
    assert len(mixing.flight([], [], None)) == 0


def test_landing_takes_the_nearest_outcome():
    p = mixing.landing([10, 100, 7], [0.5, 0.9, 1.0], [1, 1, 1])
    assert p.tolist() == [0.0, 1.0, 1.0]
