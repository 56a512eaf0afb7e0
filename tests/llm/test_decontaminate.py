import random
from itertools import combinations

import numpy as np
import pytest

from leadspan.llm import decontaminate as d
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF
from tests.llm.conftest import COLUMNS, ODD, rows_of


def plain(docs, items):
    """(doc, item) pairs with a window of 13 tokens (or the whole of a shorter item) whose aligned tokens are equal but for one
    in five (none where it has fewer than 8): all alignments of whole texts."""
    items = [(i, own) for i, t in items if i is not None and len(own := d.token_hashes(t))]
    found = set()
    for key, text in docs:
        tokens = d.token_hashes(text)
        for item, own in items:
            size = min(13, len(own))
            if len(tokens) >= size and np.isin(own, tokens).any():
                equal = tokens[:, None] == own[None, :]
                windows = sum(equal[k : len(tokens) - size + 1 + k, k : len(own) - size + 1 + k].astype(int) for k in range(size))
                if windows.max() >= (size if size < 8 else 0.8 * size - 1e-9):
                    found.add((key, item))
    return found


@pytest.mark.parametrize("length", range(1, 15))
def test_masks_catch_every_allowed_substitution(length):
    size = min(length, 13)
    span, masks = d.masks_for(length)
    for lost in combinations(range(size), size - d.least_equal(size)):
        assert any(not {at + m for m in mask} & set(lost) for mask in masks for at in range(size - span + 1))
    assert all(len(m) <= len(d.MULTIPLIERS) for m in masks)


def test_query_against_every_alignment(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op6_benchmark_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain(docs, items) and got
    by_id, item_text = dict(docs), dict(items)
    for r in got:
        a, b = d.token_hashes(by_id[r.doc_id])[r.doc_start :][: r.length], d.token_hashes(item_text[r.item_id])[r.item_start :][: r.length]
        assert int((a == b).sum()) == r.equal >= 0.8 * min(d.WINDOW, r.length)


def test_short_items_with_substitutions(spark):
    """Items of 1 to 14 tokens, every document one of them with up to three tokens changed, at a random place."""
    rng = random.Random(6)
    items = [(n, " ".join(f"i{n}t{k}" for k in range(n))) for n in range(1, 15)]
    docs = []
    for n, text in items:
        for lost in [c for k in range(4) for c in combinations(range(n), k)][:: max(1, n // 2)]:
            own = [f"x{rng.getrandbits(30)}" if i in lost else w for i, w in enumerate(text.split())]
            docs.append((len(docs), " ".join([*(f"a{rng.getrandbits(30)}" for _ in range(rng.randrange(20))), *own, *(f"b{rng.getrandbits(30)}" for _ in range(rng.randrange(20)))])))
    got = d.contaminated(spark.createDataFrame(rows_of(docs), COLUMNS), spark.createDataFrame(items, "item_id bigint, text string"))
    want = plain(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and {i for _, i in want} == set(range(1, 15))


ITEM = [f"token{i}" for i in range(40)]


def changed(every, length=40, start=0):
    return " ".join("other" if i % every == every - 1 else w for i, w in enumerate(ITEM[start : start + length]))


CASES = [
    (1, "before it " + " ".join(ITEM) + " after it"),
    (2, "x y z " + changed(7) + " q"),
    (3, changed(3)),
    (4, " ".join(ITEM[5:18])),
    (5, " ".join(ITEM[5:16])),
    (6, "Token0, TOKEN1! (token2) " + " ".join(ITEM[3:20])),
    (7, " ".join(reversed(ITEM))),
    (8, " ".join(ITEM[:12]) + " mid " + " ".join(ITEM[12:])),
    (8, " ".join(ITEM[:12]) + " mid " + " ".join(ITEM[12:])),
    (9, "one two three four five six seven eight nine ten"),
    *ODD,
]


def test_substitutions_and_odd_rows(spark, empty):
    docs = spark.createDataFrame(rows_of(CASES), COLUMNS)
    items = [(10, " ".join(ITEM)), (11, " ".join(ITEM)), (12, "quite short"), (13, None), (None, " ".join(ITEM)), (14, "one two three four five six seven eight nine ten"), (15, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}
    assert got == plain(CASES, [i for i in items if i[0] != 11])
    assert {i for i, _ in got} == {1, 2, 4, 6, 8, 9}
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in CASES if i not in {1, 2, 4, 6, 8, 9} or (i, _) in ODD), key=repr)
    assert d.contaminated(docs, bench.limit(0)).collect() == [] and d.contaminated(empty, bench).collect() == []
    assert d.drop_contaminated(docs, bench.limit(0)).count() == len(CASES)
