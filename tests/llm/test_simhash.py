import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from leadspan.llm import simhash
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF
from tests.llm.conftest import ODD


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def plain_components(prints, bits=2):
    """(smallest id reachable) for each (id, fingerprint), by trying all pairs."""
    group = list(range(len(prints)))
    values = np.array([p for _, p in prints], dtype=np.uint64)

    def head(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in np.nonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits)[0]:
            a, b = sorted((head(i), head(int(i + 1 + j))))
            group[b] = a
    members = {}
    for i, (key, _) in enumerate(prints):
        members.setdefault(head(i), []).append(key)
    first = {h: min((k for k in keys if k is not None), default=None) for h, keys in members.items()}
    return [first[head(i)] for i in range(len(prints))]


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    want = sorted((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints)))
    assert sorted(map(tuple, QUERIES["op10_simhash_near_dedup"](spark, SF).collect())) == want


def test_odd_rows(spark, odd, empty):
    prints = [(i, plain_fingerprint(t)) for i, t in ODD]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=repr) == want
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).columns == empty.columns


def test_keep_one_leaves_one_of_each_group(odd):
    kept = simhash.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 7]
    assert [r.text for r in kept if r.doc_id is None] == ["no id here"]
    assert kept[0].asDict().keys() == set(odd.columns)


@pytest.mark.parametrize("n", [40, 500])
def test_links_in_dense_groups(spark, n):
    rng = np.random.default_rng(n)
    centre = int(rng.integers(0, 2**63))
    values = {centre}
    while len(values) < n:  # many within few bits of each other, and strangers
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) if rng.random() < 0.8 else int(rng.integers(0, 2**64, dtype=np.uint64)))
    prints = [(i, v) for i, v in enumerate(sorted(values))]
    df = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in prints], "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in simhash.grouped(df).collect()}
    assert [got[i] for i, _ in prints] == plain_components(prints)


def test_forest_by_flips_equals_pairs():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 1 << 16, 3000).astype(np.uint64))
    rep = {}
    for member, head in simhash.forest(values, (0, 1), 2):
        rep[member] = head
    want = plain_components([(int(v), int(v)) for v in values])
    assert [rep.get(int(v), int(v)) for v in values] == want
