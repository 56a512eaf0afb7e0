import re
from collections import Counter

from leadspan.llm import rules
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF
from tests.llm.conftest import ODD


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def check(rows, docs):
    want = sorted(((i, *plain(t), not plain(t)[-1] and rules.rejected_by(rules.RULES, t) is None) for i, t in docs), key=repr)
    assert sorted(map(tuple, rows), key=repr) == want


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(QUERIES["op2_quality_rules"](spark, SF).collect(), docs)


def test_odd_rows(odd, empty):
    check(rules.measures(odd).collect(), ODD)
    assert rules.measures(empty).collect() == []
    assert rules.filter_quality(empty).collect() == []
    kept = rules.filter_quality(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4}


def test_labelled_junk_goes_and_good_text_stays(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op2_quality_rules"](spark, sf).collect() if r.doc_id in labels]
    assert all(r.kept or r.base_failed for r in rows if labels[r.doc_id] == 1)
    junk = [r for r in rows if labels[r.doc_id] == 0]
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)


def test_order_takes_rejections_per_cost_among_the_rest():
    # rule 0 rejects most but is dear; rule 1 is cheap; rule 2 rejects only what rule 1 rejects
    assert rules.order([10.0, 1.0, 1.0], {0b001: 50, 0b110: 30, 0: 20}) == [1, 0, 2]
    assert rules.order([], {}) == []


def test_short_circuit():
    calls = []
    chain = [rules.Rule("first", lambda t: True), rules.Rule("second", lambda t: calls.append(1))]
    assert rules.rejected_by(chain, "text") == "first" and not calls


def test_any_order_gives_the_same_verdict(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    back = tuple(reversed(rules.RULES))
    assert [rules.rejected_by(rules.RULES, t) is None for t in texts] == [rules.rejected_by(back, t) is None for t in texts]
