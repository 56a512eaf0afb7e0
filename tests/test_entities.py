"""Entity upsert against taking the mentions one by one."""

import random

from leadspan.operators.entities import upsert_entities

STORED = "entity_id long, tenant_id string, type string, name string, aliases array<string>, properties string"


def one_by_one(stored, mentions):
    entities, resolved = {}, []
    for e, tenant, kind, name, aliases, p in sorted(stored):
        entities.setdefault((tenant, kind), []).append([e, name, [a for a in aliases or [] if a is not None and a != name], p])
    for seq, e, tenant, kind, name, aliases, p in sorted(mentions):
        own = entities.setdefault((tenant, kind), [])
        aliases = [a for a in aliases or [] if a is not None and a != name]
        hit = next((x for x in own if x[1] == name or name in x[2] or set(aliases) & set(x[2])), None)
        if hit is None:
            own.append([e, name, aliases, p])
        else:
            hit[2] = hit[2] + [a for a in [*aliases, name] if a != hit[1]]
        resolved.append((seq, tenant, kind, hit[0] if hit else e, hit is None))
    return sorted((e, *g, n, tuple(sorted(set(al))), p) for g, own in entities.items() for e, n, al, p in own), resolved


def check(spark, stored, mentions):
    made, resolved = upsert_entities(spark.createDataFrame(stored, STORED), spark.createDataFrame(mentions, f"seq long, {STORED}").repartition(3))
    want_made, want_resolved = one_by_one(stored, mentions)
    assert sorted((r.entity_id, r.tenant_id, r.type, r.name, tuple(r.aliases), r.properties) for r in made.collect()) == want_made
    assert sorted((r.seq, r.tenant_id, r.type, r.entity_id, r.inserted) for r in resolved.collect()) == want_resolved


def test_alias_and_name(spark):
    mentions = [(1, 11, "a", "Company", "Acme Corp", ["Acme Corporation"], "p"), (2, 12, "a", "Company", "Acme Corporation", None, None), (3, 13, "b", "Company", "Acme Corp", None, None)]
    check(spark, [], mentions)
    # an alias equal to a stored name is no match, an alias in common is
    stored = [(1, "a", "Company", "Globex", ["G", None, "Globex"], "s"), (2, "a", "Company", "Initech", ["I", "G"], "s")]
    check(spark, stored, [(1, 21, "a", "Company", "new", ["Globex"], "p"), (2, 22, "a", "Company", "other", ["G", "H"], "p"), (3, 23, "a", "Company", "H", [], "p")])
    check(spark, stored, [])


def test_chain_in_the_wrong_order(spark):
    """Links of a chain come back to front, so early mentions become entities that a later one would have joined."""
    chain = [(i, 100 + i, "t", "Person", f"n{i}", [f"a{i}", f"a{i + 1}"], None) for i in range(12)]
    back = [(50 - i, 200 + i, "t", "Person", f"m{i}", [f"b{i}", f"b{i + 1}"], None) for i in range(12)]
    check(spark, [(1, "t", "Person", "first", ["a0"], "s"), (2, "t", "Person", "second", ["b0"], "s")], chain + back)


def test_hot_alias(spark):
    rng = random.Random(3)
    stored = [(i, "t", "Segment", f"s{i}", ["hot"] if i > 3 else [f"x{i}"], "s") for i in range(1, 30)]
    mentions = [(i, 1000 + i, "t", "Segment", f"m{rng.randrange(150)}", rng.choice([["hot"], [f"x{rng.randrange(60)}"], [f"x{rng.randrange(60)}", f"y{rng.randrange(90)}"], None]), f"p{i}") for i in range(400)]
    check(spark, stored, mentions)


def test_blocks(spark, monkeypatch):
    """Blocks of a few mentions: chains and hot names cross them, and rounds stay few."""
    import leadspan.operators.entities as E

    rng = random.Random(5)
    stored = [(i, "t", "Segment", f"s{i}", ["hot"] if i > 3 else [f"x{i}"], "s") for i in range(1, 30)]
    mentions = [(i, 1000 + i, "tu"[i % 2], "Segment", f"m{rng.randrange(150)}", rng.choice([["hot"], [f"x{rng.randrange(60)}"], [f"x{rng.randrange(60)}", f"y{rng.randrange(90)}"], None]), f"p{i}") for i in range(240)]
    rounds, step = [], E._round
    monkeypatch.setattr(E, "_round", lambda *a: rounds.append(1) or step(*a))
    got = E.resolve_mentions(spark.createDataFrame(stored, STORED), spark.createDataFrame(mentions, f"seq long, {STORED}").repartition(3), 20).collect()
    want = {seq: e for seq, _, _, e, _ in one_by_one(stored, mentions)[1]}
    assert {r.seq: 1000 + r.slot.no if r.slot.new else r.slot.no for r in got} == want
    assert 2 <= len(rounds) <= 7
