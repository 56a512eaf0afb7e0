import itertools

import numpy as np
import pytest

from leadspan.llm import chat
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF

SF01 = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def raw(spark):
    return chat.written(spark.read.parquet(f"{SF01}/conversations.parquet")).cache()


@pytest.fixture(scope="module")
def model(raw):
    return chat.learn(raw, "conv_id", "piece", "role", "text")


def test_roles_of_unseen_transcripts(raw):
    seen, unseen = raw.filter("conv_id % 5 > 0"), raw.filter("conv_id % 5 = 0")
    found = chat.parse(unseen, chat.learn(seen, "conv_id", "piece", "role", "text")).collect()
    truth, got = {}, {}
    for r in sorted(unseen.collect(), key=lambda r: (r.conv_id, r.piece)):
        truth.setdefault(str(r.conv_id), []).append(r.role)
    for r in sorted(found, key=lambda r: (r.conv, r.turn)):
        got.setdefault(r.conv, []).append(r.role)
    assert np.mean([truth[c] == got[c] for c in truth]) > 0.75


def test_blocks_give_the_result_of_one_pass(raw, model, monkeypatch):
    one = sorted(map(tuple, chat.parse(raw, model, block_pieces=10**6).collect()))
    monkeypatch.setattr(chat, "FAN", 2)
    assert sorted(map(tuple, chat.parse(raw, model, block_pieces=1).collect())) == one


def test_decode_is_the_best_path(model):
    lines = ["User: hello there", "more of it?", "", "AI: yes"]
    scores = model.scores(lines)

    def value(path):
        total, before = 0.0, chat.START
        for i, s in enumerate(path):
            total += model.transitions[before, s] + scores[i, s]
            before = s
        return total

    best = max(itertools.product(range(chat.STATES), repeat=len(lines)), key=value)
    assert chat.decode(model, lines) == list(best)
    assert np.isclose(chat.summary(model, lines)[chat.START].max(), value(best))


@pytest.mark.parametrize("line, kind", [("User: hi", 1 + 1), ("**Assistant:** hi", 2 + 1), ("[10:05] bot> hi", 2 + 1), ("### System:", 1), ("anna> hi", 4), ("plain text", 0), ("", 0), ("see http://x", 0)])
def test_marker(line, kind):
    assert chat.marker(line)[0] == kind


def test_query_gives_all_text_back(spark):
    rows = QUERIES["op5_chat_turns"](spark, SF).collect()
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert all(r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("\n<|end|>\n") for r in rows)
    text = lambda parts: "".join("".join(parts).split())
    for conv in {r.conv_id for r in turns}:
        want = text(r.text for r in sorted(turns, key=lambda r: r.turn) if r.conv_id == conv)
        got = text(r.rendered.split("\n", 1)[1].removesuffix("\n<|end|>\n") for r in sorted(rows, key=lambda r: r.turn) if r.conv_id == conv)
        for _, *names in [(0, *n[:3]) for n in chat.STYLES]:  # a marker inside a turn stays as text
            for n in names:
                got, want = got.replace(f"{n}:", "").replace(f"{n}>", ""), want.replace(f"{n}:", "").replace(f"{n}>", "")
        assert got == want


def test_odd_rows(spark, model):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, "user", "User: a"), (None, None, "user", "b"), (2, 0, None, "User: x"), (2, 0, None, "User: x"), (3, 0, "judge", "A: " + "long " * 20000)]
    turns = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, block int")
    found = chat.canonical(turns).collect()
    assert {r.conv_id for r in found} == {None, 2, 3} and all(r.role in chat.ROLES for r in found)
    assert chat.canonical(turns.limit(0)).collect() == []
