import hashlib
import itertools
import random
import re
import zlib

import pytest

from leadspan.llm import repair
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """(turn, role, text) by conversation, in order, of (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = WORD.findall(text)
        out.append("b" if not words else "d" if (role, text) in seen else "k" if words[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, audit, lines) over all edits, a plain search over positions of the pattern: start, s, u, a."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for symbol, role in (("u", "user"), ("a", "assistant")):
                    if (state, symbol) in follow:
                        way = (cost + 5, audit + "I", (*lines, (role, "")))
                        nxt = follow[state, symbol]
                        best[nxt] = min(best.get(nxt, way), way)
        return best

    for (_, role, text), mark in zip(rows, marks):
        after = {}
        for state, (cost, audit, lines) in inserted(best).items():
            ways = [(state, (cost + 2, audit + "D", lines))]
            if mark not in "bd":
                extra = 5 if mark == "t" else 0
                for symbol, price, letter, name in ((role[:1], 0, "K", role), ("u", 1, "R", "user"), ("a", 1, "R", "assistant")):
                    if (state, symbol) in follow:
                        ways.append((follow[state, symbol], (cost + price + extra, audit + letter, (*lines, (name, text)))))
            for nxt, way in ways:
                after[nxt] = min(after.get(nxt, way), way, key=lambda w: w[:2])
        best = after
    return min((w for s, w in inserted(best).items() if s in ("", "a")), key=lambda w: w[:2])


def plain(rows):
    out = []
    for conv, own in damaged(rows).items():
        marks = faults(own)
        turns = [r[0] for r in own if r[0] is not None]
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(own, marks) if own else (0, "", ())
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(marks.count(m) for m in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_conversation_repair"](spark, sf)) == plain(rows)


SCHEMA = "conv_id long, turn long, role string, text string, conv long, pos int, block int, edits string, _kind int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "K", 4) for r in rows], SCHEMA).repartition(3)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x."), (1, None, "user", "x."), (1, 3, "assistant", " \t\n\x0b"), (1, 3, "assistant", "y?"), (1, 3, "assistant", "y?")]
    rows += [(None, 1, "user", "no id."), (None, 2, "assistant", "é 😀 ! "), (2, None, None, None), (3, 5, "tool", "t."), (3, 9, "", "u."), (3, -4, "system", "word " * 50000 + "end.")]
    rows += [(4, t, "assistant", f"{t}.") for t in range(7)] + [(5, t, ("system", "user")[t % 2], f"{t}") for t in range(9)] + [(6, None, "agent", "A."), (6, 2**60, "sure", "B.")]
    drops = next(c for c in range(100, 10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(drops, 0, "user", "gone.")]
    got = found(repair.repair_damaged(frame(spark, rows)))
    assert got == plain(rows)
    assert (drops, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def noisy(rng, conv, n):
    roles = ["system"] + ["user", "assistant"] * n
    texts = [rng.choice(["a.", "b!", "c", "", "same?", f"line {i}.", f"cut {i}"]) for i in range(n)]
    return [(conv, i, roles[i] if rng.random() < 0.8 else rng.choice(["user", "assistant", "system", "tool"]), t) for i, t in enumerate(texts)]


def test_random_and_long_conversations(spark, monkeypatch):
    """Blocks of 7 rows: most conversations take several, one holds a third of all rows."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    rows = list(itertools.chain.from_iterable(noisy(rng, c, rng.randrange(1, 40)) for c in range(60))) + noisy(rng, 1000, 600)
    assert found(repair.repair_damaged(frame(spark, rows))) == plain(rows)


def test_lines_are_the_repaired_conversation(spark):
    rng = random.Random(8)
    rows = list(itertools.chain.from_iterable(noisy(rng, c, 12) for c in range(20)))
    made = repair.Repair(repair.damage(frame(spark, rows)))
    lines = {}
    for r in sorted(made.lines().collect(), key=lambda r: (r.conv_id, r.at)):
        lines.setdefault(r.conv_id, []).append(r)
    want = {c: cheapest(own, faults(own))[2] for c, own in damaged(rows).items()}
    assert {c: tuple((r.role, r.text) for r in own) for c, own in lines.items()} == {c: w for c, w in want.items() if w}
    assert all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in own)) for own in lines.values())


def test_every_edit_of_short_conversations():
    """All edits of up to three rows, written out: the parser's answer is the least of them."""
    for rows in itertools.chain.from_iterable(itertools.product(("sk", "uk", "ut", "ak", "ob", "od", "ok"), repeat=n) for n in (1, 2, 3)):
        best = None
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            for edits in itertools.product("DKua", repeat=len(rows)):
                cost, audit, roles = 5 * len(gaps[0]), "I" * len(gaps[0]), gaps[0]
                for row, edit, gap in zip(rows, edits, gaps[1:]):
                    if edit != "D" and row[1] in "bd":
                        break
                    cost += {"D": 2, "K": 0}.get(edit, 1) + (5 if edit != "D" and row[1] == "t" else 0) + 5 * len(gap)
                    audit += ("D" if edit == "D" else "K" if edit == "K" else "R") + "I" * len(gap)
                    roles += ("" if edit == "D" else row[0] if edit == "K" else edit) + gap
                else:
                    if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
        ends = [(cost + repair.endings(s)[0], edits + repair.endings(s)[1]) for s, (cost, edits) in repair.parse("".join(rows)).items()]
        assert (min(ends)[0], min((c, e.translate(repair.AUDIT)) for c, e in ends)[1]) == best, rows
