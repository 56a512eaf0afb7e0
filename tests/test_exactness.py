"""Distributed forms against one-by-one Python, on random data and with one hot group."""

import math
import random
import time
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspan.operators.admission import DAILY_LIMITS, DEFAULT_LIMIT, admit
from leadspan.operators.graph import canonical_head, connected_components
from leadspan.operators.ledger import filter_new, first_come
from leadspan.operators.linkage import DedupConfig, dedup_leads
from leadspan.operators.ranking import ordinals, top_k
from leadspan.operators import simjoin
from leadspan.operators import vectors as vectors_module
from leadspan.operators.simjoin import candidate_pairs, dice_join
from leadspan.operators.vectors import similar_clusters
from leadspan.session import cut_lineage


def grams(s):
    return {s[i:i + 2] for i in range(len(s) - 1)}


def dice(a, b):
    if a == b:
        return 1.0
    x, y = grams(a), grams(b)
    if not x and not y:
        return 1.0
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def words(rng, n):
    stems = ["anna", "bob", "carla", "dan", "eve", "acme corp", "globex", "initech llc", "x", "yz"]
    out = set()
    while len(out) < n:
        s = " ".join(rng.choice(stems) for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.5 and len(s) > 1:
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice("abcxyz") + s[i + 1:]
        out.add(s.strip())
    return sorted(out)


def test_dice_join_loses_no_pair(spark):
    rng = random.Random(3)
    left, right = words(rng, 150), words(rng, 150)
    for t in (0.5, 0.65, 0.8, 1.0):
        got = {(r.left_text, r.right_text): r.score for r in dice_join(spark.createDataFrame([(x,) for x in left], "text string"), spark.createDataFrame([(x,) for x in right], "text string"), t).collect()}
        want = {(a, b): dice(a, b) for a in left for b in right if dice(a, b) >= t}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_best_matches_by_falling_thresholds(spark, monkeypatch):
    random.seed(8)
    words = ["acme", "globex", "ada", "grace", "hopper", "turing", "labs", "x", "99", "corp"]
    names = [" ".join(random.choices(words, k=random.randint(1, 4))) + random.choice(["", "s", " 1", " 2", " 12"]) for _ in range(160)]
    left, right = names[:80], [(n, i) for i, n in enumerate(names[60:])]
    level = lambda s: math.floor(s * 20 + 0.5)  # noqa: E731 - coarse, so that matches below a step tie with those above
    want = {}
    for a in set(left):
        hits = [(-level(dice(a, b)), i) for b, i in right if dice(a, b) >= 0.5]
        if hits:
            want[a] = (-min(hits)[0], min(hits)[1])
    met = []

    def noted(*args):
        met.append(candidate_pairs(*args))
        return met[-1]

    monkeypatch.setattr(simjoin, "candidate_pairs", noted)
    lefts, rights = spark.createDataFrame([(x,) for x in left], "text string"), spark.createDataFrame(right, "text string, ord long")
    for few in (0, simjoin.FEW_PAIRS):
        monkeypatch.setattr(simjoin, "FEW_PAIRS", few)
        met.clear()
        got = simjoin.best_dice(lefts, rights, 0.5, lambda s: F.floor(s * 20 + 0.5))
        assert {r.text: (r.confidence, r.ord) for r in got.collect()} == want
        assert len(met) == (1 if few else len(simjoin.STEPS) + 1)
        pairs = [m.count() for m in met]
    # the last run makes all pairs at once, the steps make fewer
    monkeypatch.setattr(simjoin, "FEW_PAIRS", 0)
    met.clear()
    simjoin.best_dice(lefts, rights, 0.5, lambda s: F.floor(s * 100 + 0.5)).count()
    assert sum(m.count() for m in met) < pairs[0]


@pytest.mark.parametrize("threshold", [0.5, 0.65, 0.9])
def test_pairs_meet_once_without_a_shuffle_of_pairs(spark, threshold, capsys):
    random.seed(11)
    words = ["acme", "globex", "ada", "gr", "hopper", "x", "ab", "99", "aba"]
    texts = sorted({" ".join(random.choices(words, k=random.randint(1, 4))) + random.choice(["", "s", " 1"]) for _ in range(150)} | {"a", "b", "ab", "abab"})
    pieces = simjoin._pieces(spark.createDataFrame([(x,) for x in texts], "text string"))
    side = cut_lineage(simjoin._rarest_first(pieces, simjoin._frequency(pieces, pieces), []))
    pairs = candidate_pairs(side, side, threshold, [])
    met = [(r.left_text, r.right_text) for r in pairs.collect()]
    assert len(met) == len(set(met))
    assert {(a, b) for a in texts for b in texts if dice(a, b) >= threshold} <= set(met)
    pairs.explain()
    assert "Aggregate" not in capsys.readouterr().out


def test_dice_join_gives_each_pair_once(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("anna acme corp",), ("anne acme corp",)], "text string")
    rows = [(r.left_text, r.right_text) for r in dice_join(texts, texts, 0.5).collect()]
    assert len(rows) == len(set(rows))


def test_hot_value_meets_once(spark):
    """A third of all leads share one domain and title; the join stays on distinct values."""
    leads = spark.range(3000).select(F.col("id").alias("lead_id"), F.lit("t").alias("tenant_id"), F.concat(F.lit("u"), "id", F.lit("@hot.com")).alias("email"), F.lit(None).cast("string").alias("linkedin_url"), F.concat(F.lit("n"), "id").alias("first_name"), F.lit("z").alias("last_name"), F.lit("CEO").alias("headline"), F.lit("c").alias("company"))
    supp = spark.range(1000).select(F.col("id").alias("ord"), F.concat(F.lit("s"), "id").alias("entry_id"), F.lit("t").alias("tenant_id"), F.concat(F.lit("v"), "id", F.lit("@hot.com")).alias("email"), F.lit(None).cast("string").alias("linkedin_url"), F.lit("q").alias("first_name"), F.lit("w").alias("last_name"), F.lit("CEO").alias("headline"), F.lit("other").alias("company"), F.lit("crm").alias("source"))
    out = dedup_leads(leads, supp, config=DedupConfig(matchers=("email", "domain_title")))
    assert out.filter("verdict = 'duplicate' AND confidence = 95 AND matched_id = 's0'").count() == 3000


def test_first_come_is_the_sequential_answer(spark):
    rng = random.Random(5)
    for trial in range(4):
        rows = [(i, *(rng.choice([None, *range(rng.choice([6, 40]))]) for _ in range(3))) for i in range(120)]
        rows += [(200 + i, 7, None, 900 + i) for i in range(60)]  # one hot key
        seen_keys = {"a:3", "b:1"}
        learned, want = set(seen_keys), []
        for i, a, b, c in rows:
            keys = {f"{k}:{v}" for k, v in (("a", a), ("b", b), ("c", c)) if v is not None}
            if not keys & learned:
                want.append(i)
                learned |= keys
        df = spark.createDataFrame(rows, "n long, a int, b int, c int")
        got = first_come(df, "n", {k: F.col(k) for k in "abc"}, spark.createDataFrame([(k,) for k in seen_keys], "_key string"))
        assert sorted(r.n for r in got.collect()) == want


def test_filter_new_profiles(spark):
    cols = "ordinal long, rr_id long, name string, company_name string, linkedin_url string"
    ledger = spark.createDataFrame([(0, 1, "Old Name", "Acme", "https://linkedin.com/in/p2")], cols)
    batch = spark.createDataFrame([
        (1, 1, "A", "x", None), (2, 2, "B", "x", "https://www.linkedin.com/pub/P2/"), (3, None, "old name", "Acme Inc.", ""), (4, 4, "New", "Co", None),
        (5, 4, "Other", "Co", None), (6, None, "new", "CO.", None), (7, None, "", "", None), (8, None, "", "", None),
    ], cols)
    assert sorted(r.ordinal for r in filter_new(batch, ledger).collect()) == [4, 7, 8]


def test_admission_with_several_tokens(spark):
    rng = random.Random(11)
    rows = [(i, "t", rng.choice(["linkedin.connect", "x"]), 1 if rng.random() < 0.7 else 2, rng.choice([1, 2, 5, 40, 200])) for i in range(900)]
    df = spark.createDataFrame(rows, "request_id long, tenant_id string, provider string, account_id int, tokens int").withColumn("requested_at", F.lit("2024-01-01").cast("timestamp"))
    left, want = {}, []
    for i, _, provider, account, n in rows:
        have = left.setdefault((provider, account), DAILY_LIMITS.get(provider, DEFAULT_LIMIT))
        if n <= have:
            left[provider, account] = have - n
            want.append(i)
    assert sorted(r.request_id for r in admit(df, ["request_id"]).collect()) == want


def test_ordinals_of_a_hot_group(spark):
    df = spark.range(5000).select((F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99)).alias("g"), F.xxhash64("id").alias("o"))
    got = ordinals(df, ["g"], ["o"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.o, r.ordinal))
    assert len(got) == 5000
    for pairs in by.values():
        assert [n for _, n in sorted(pairs)] == list(range(len(pairs)))


def test_top_k_is_cut_before_the_exchange(spark):
    plan = top_k(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def vectors_by_force(vectors, t):
    m = {n: np.array(v) / np.linalg.norm(v) for n, v in vectors if np.linalg.norm(v) > 0}
    parent = {n: n for n in m}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(m)
    linked = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if m[a] @ m[b] >= t:
                linked |= {a, b}
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in linked}


def test_vector_clusters_are_exact(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    vectors = [(i, (centres[rng.integers(12)] + rng.normal(scale=0.35, size=6)).astype(np.float32).tolist()) for i in range(220)]
    hot = rng.normal(size=6)
    vectors += [(1000 + i, (hot + rng.normal(scale=0.01, size=6)).astype(np.float32).tolist()) for i in range(120)]  # a third are near-copies
    vectors += [(2000 + i, vectors[0][1]) for i in range(5)] + [(3000, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "node_id long, vector array<float>")
    got = {r.node_id: r.cluster_id for r in similar_clusters(df).collect()}
    assert got == vectors_by_force(vectors, 0.85)


def test_vectors_without_structure_are_not_copied_per_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(900)]
    rows += [(5000 + i, [x + 0.01 for x in rows[i][1]]) for i in range(40)]
    df, stored = spark.createDataFrame(rows, "node_id long, vector array<float>"), []

    def counted(d):
        out = cut_lineage(d)
        stored.append(out.count())
        return out

    monkeypatch.setattr(vectors_module, "cut_lineage", counted)
    links = vectors_module.similar_links(df, 0.85, tile=100)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == vectors_by_force(rows, 0.85)
    assert max(stored) <= len(rows)


def test_components_of_a_long_chain(spark):
    pairs = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(200, 100), (100, 300)], "a long, b long"))
    got = {r.node: r.component for r in connected_components(pairs).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_canonical_head_with_cycles_and_forks(spark):
    rng = random.Random(9)
    edges = [(n, "node", rng.randrange(60), "node", rng.randrange(60), "supersedes", f"2024-01-{rng.randint(1, 28):02d} 00:00:00") for n in range(55)]
    edges = [e for e in edges if e[2] != e[4]]
    newest = {}
    for e in edges:
        if e[4] not in newest or (e[6], e[0]) > newest[e[4]][:2]:
            newest[e[4]] = (e[6], e[0], e[2])

    def head(n):
        seen = set()
        while n not in seen:
            seen.add(n)
            if n not in newest:
                return n
            n = newest[n][2]
        return n

    df = spark.createDataFrame(edges, "edge_id long, from_type string, from_id long, to_type string, to_id long, relation string, created string").withColumn("created_at", F.col("created").cast("timestamp"))
    got = {r.node_id: r.head_id for r in canonical_head(df, spark.range(60).withColumnRenamed("id", "node_id")).collect()}
    assert got == {n: head(n) for n in range(60)}


def test_dense_rank_in_blocks_equals_all_pairs(spark):
    import numpy as np

    from leadspan.operators.memory import dense_rank

    rng = np.random.default_rng(1)
    nodes = [(i, rng.integers(-2, 3, 4 if i % 7 else 3).astype(float).tolist()) for i in range(120)]
    asked = [(q, rng.integers(-2, 3, 4).astype(float).tolist()) for q in range(8)]

    def cosine(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / size), 9) if size else 0.0

    want = []
    for q, a in asked:
        scored = sorted((-cosine(a, b), n) for n, b in nodes if len(b) == 4)[:5]
        want += [(q, n, rank + 1) for rank, (_, n) in enumerate(scored)]
    e = spark.createDataFrame(nodes, "node_id long, vector array<double>").repartition(4)
    qs = spark.createDataFrame(asked, "query_id long, vector array<double>")
    want.sort()
    for tiles in ((12, 40), (2**18, 2**21)):
        assert sorted((r.query_id, r.node_id, r["dense_rank"]) for r in dense_rank(qs, e, 5, *tiles).collect()) == want


def test_few_pairs_are_compared(spark):
    """What passes the bounds is little more than what is similar, at every size; nothing similar is lost."""
    from leadspan.operators import simjoin

    rng = random.Random(9)
    parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    for n in (100, 800):
        texts = sorted({" ".join(rng.choice(parts) for _ in range(3)) for _ in range(n)})
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        cut = simjoin._pieces(df)
        frequency = cut.selectExpr("explode(pieces) AS piece").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
        side = simjoin._rarest_first(cut, frequency, [])
        compared = simjoin.candidate_pairs(side, side, 0.8, []).count()
        similar = dice_join(df, df, 0.8).count()
        assert similar <= compared <= 1.5 * similar + n


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    """A run of many steps had the shuffle files of all of them on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in files.getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = shuffled()
    kept = cut_lineage(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    time.sleep(1)
    assert shuffled() <= before
    assert kept.count() == 7


def test_memory_of_a_comparison_is_bounded_where_all_rows_are_similar():
    rng = np.random.default_rng(3)
    m = np.eye(1, 16) + rng.normal(size=(9000, 16)) * 0.08
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    side = lambda rows, first: (np.arange(len(rows)) + first, np.ones(len(rows), dtype=int), rows, rows.astype(np.float32))
    left, right = side(m[:1000], 0), side(m[1000:], 1000)
    tracemalloc.start()
    found = sum(len(x) for x, _ in vectors_module._similar(left, right, False, 0.85, lambda a, b: np.ones((len(a), len(b)), dtype=bool)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == int((m[:1000] @ m[1000:].T >= 0.85).sum()) > 7_000_000
    assert peak < 120e6  # 512 rows at a time took more than 200 MB
