"""Chat transcripts: roles recovered by a hidden Markov model, turns rendered in one form.

A transcript is lines of text. The hidden state of a line is a role (system, user, assistant) and whether the line begins
a turn or continues one. What is seen of a line: the kind of speaker marker it begins with, its length, whether it follows a
blank line and whether it asks. Emissions and transitions are counted on transcripts with known roles; Viterbi decoding
finds the likeliest states of all lines together, so markers may be missing, unknown or misleading.

A long transcript comes in many pieces. Viterbi runs on blocks of pieces: each block is summed up as the best score from
every state before it to every state at its end, the summaries are multiplied in a tree with ``FAN`` children, and each
block is decoded between its two end states. The result is that of one pass (but that a block's first line counts as not
following a blank one), and no task holds a whole transcript.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspan.session import cut_lineage

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2, + 1 where the line continues a turn
START = STATES  # before the first line
BLOCK_PIECES = 64
FAN = 256

# Fixed speaker names by role.
NAMES = {
    "system": ("system", "instruction", "instructions", "context", "prompt"),
    "user": ("user", "human", "you", "customer", "client", "visitor", "q", "question", "me", "student"),
    "assistant": ("assistant", "ai", "bot", "chatbot", "agent", "model", "support", "a", "answer", "teacher"),
}
ROLE_OF = {name: i + 1 for i, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(r"[ \t]*(?:\[[\d:. ]{4,20}\][ \t]*)?[#*_<|\[(]{0,4}[ ]?([A-Za-z][\w.-]{0,20})[ ]?(?:#?\d{1,3})?[*_|\])]{0,4}[ ]?(?::|>|\]:)[*_]{0,2}(?:[ \t]+|$)")
LENGTHS = (1, 60, 120, 240, 480, 960)
KINDS = (5, len(LENGTHS) + 1, 2, 2)  # values of marker, length, after a blank line, asks


def marker(line: str) -> tuple[int, int]:
    """(kind, characters of the marker): 0 none, 1 to 3 a role's name, 4 another name."""
    found = MARKER.match(line)
    if not found:
        return 0, 0
    return ROLE_OF.get(found[1].lower(), 4), found.end()


def look(lines: Sequence[str]) -> np.ndarray:
    """What is seen of each line, one column for each of KINDS."""
    out = np.zeros((len(lines), len(KINDS)), dtype=np.int64)
    blank = False
    for i, line in enumerate(lines):
        bare = line.strip()
        out[i] = marker(line)[0], np.searchsorted(LENGTHS, len(bare), side="right"), blank, bare.endswith("?")
        blank = not bare
    return out


class Model(NamedTuple):
    """Log probabilities: emissions[kind][state][value], transitions[state or START][state]."""

    emissions: list[np.ndarray]
    transitions: np.ndarray

    def scores(self, lines: Sequence[str]) -> np.ndarray:
        seen = look(lines)
        return sum(table[:, seen[:, k]].T for k, table in enumerate(self.emissions))


def summary(model: Model, lines: Sequence[str]) -> np.ndarray:
    """Best score from each state before the lines (START last) to each state at their last line."""
    best = None
    for score in model.scores(lines):
        best = model.transitions + score if best is None else (best[:, :, None] + model.transitions[None, :STATES]).max(axis=1) + score
    return best


def through(matrices: Sequence[np.ndarray], entry: int, exit_: int | None) -> list[int]:
    """States at the end of each matrix on the best path from ``entry`` to ``exit_`` (any, if None)."""
    score, back = matrices[0][entry], []
    for m in matrices[1:]:
        step = score[:, None] + m[:STATES]
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    path = [int(score.argmax()) if exit_ is None else exit_]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def decode(model: Model, lines: Sequence[str], entry: int = START, exit_: int | None = None) -> list[int]:
    """The likeliest state of each line."""
    return through([model.transitions + s for s in model.scores(lines)], entry, exit_) if len(lines) else []


def learn(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts over turns with known roles; ``text`` is the turn as it stands in the transcript. Other roles do not count.

    Two values of each table are counted as seen once more than they are, so an empty table gives an even model.
    """

    def seen(batches):
        for batch in batches:
            rows = [(r, int(i > 0), *look_row) for r, t in zip(batch["role"], batch["text"]) for i, look_row in enumerate(look((t or "").split("\n")).tolist())]
            yield pd.DataFrame(rows, columns=["role", "inside", "k0", "k1", "k2", "k3"])

    known = turns.filter(F.col(role).isin(*ROLES)).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    lines = known.select("role", "text").mapInPandas(seen, "role string, inside int, k0 int, k1 int, k2 int, k3 int")
    emitted = lines.groupBy("role", "inside", "k0", "k1", "k2", "k3").count().toPandas()  # at most a value for each combination
    emissions = []
    counts = np.zeros(STATES)
    states = [2 * ROLES.index(r) + i for r, i in zip(emitted["role"], emitted["inside"])]
    np.add.at(counts, states, emitted["count"].to_numpy(float))
    for k, size in enumerate(KINDS):
        table = np.full((STATES, size), 0.5)
        np.add.at(table, (states, emitted[f"k{k}"].to_numpy(int)), emitted["count"].to_numpy(float))
        emissions.append(np.log(table / table.sum(axis=1, keepdims=True)))
    places = known.select("conv", "turn", "role").distinct()
    after = places.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("following"))
    pairs = places.join(after, ["conv", "turn"]).groupBy("role", "following").count().collect()
    firsts = places.groupBy("conv").agg(F.min_by("role", "turn").alias("role")).groupBy("role").count().collect()
    change, first = np.full((len(ROLES), len(ROLES)), 0.5), np.full(len(ROLES), 0.5)
    for r in pairs:
        change[ROLES.index(r["role"]), ROLES.index(r["following"])] += r["count"]
    for r in firsts:
        first[ROLES.index(r["role"])] += r["count"]
    transitions = np.full((STATES + 1, STATES), 1e-12)
    for a in range(STATES):
        own, turns_, inside = a // 2, counts[a // 2 * 2], counts[a // 2 * 2 + 1]
        stay = (inside + 0.5) / (turns_ + inside + 1)
        transitions[a, 2 * own + 1] = stay
        transitions[a, ::2] = (1 - stay) * change[own] / change[own].sum()
    transitions[START, ::2] = first / first.sum()
    return Model(emissions, np.log(transitions))


def _lines(rows: pd.DataFrame) -> list[str]:
    ordered = rows.sort_values(["piece", "text"], na_position="first", kind="stable")
    return [line for text in ordered["text"] for line in ("" if text is None else text).split("\n")]


MATRIX = "conv string, block bigint, matrix array<double>"
ENDS = "conv string, block bigint, entry int, exit int"


def _matrices(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(m, dtype=float).reshape(STATES + 1, STATES) for m in rows["matrix"]]


def _ends(summaries: DataFrame) -> DataFrame:
    """(conv, block, entry, exit): the state before and at the end of each block on the best path of its transcript."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        entry, exit_ = int(rows["_entry"].iloc[0]), int(rows["_exit"].iloc[0])
        path = through(_matrices(rows), entry, None if exit_ < 0 else exit_)
        return pd.DataFrame({"conv": rows["conv"], "block": rows["block"], "entry": [entry, *path[:-1]], "exit": path})

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        product = None
        for m in _matrices(rows.sort_values("block")):
            product = m if product is None else (product[:, :, None] + m[None, :STATES]).max(axis=1)
        return pd.DataFrame({"conv": rows["conv"].iloc[:1], "block": rows["parent"].iloc[:1], "matrix": [product.ravel().tolist()]})

    children = summaries.withColumn("parent", F.floor(F.col("block") / FAN))
    if summaries.filter(F.col("block") >= FAN).isEmpty():
        ready = children.withColumn("_entry", F.lit(START)).withColumn("_exit", F.lit(-1))
    else:
        parents = cut_lineage(children.groupBy("conv", "parent").applyInPandas(multiply, MATRIX))
        known = _ends(parents).select(F.col("conv").alias("_conv"), F.col("block").alias("_parent"), F.col("entry").alias("_entry"), F.col("exit").alias("_exit"))
        ready = children.join(known, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("parent") == F.col("_parent")))
    return ready.select("conv", "block", "parent", "matrix", "_entry", "_exit").groupBy("conv", "parent").applyInPandas(settle, ENDS)


FRAGMENT = "conv string, block bigint, fragment int, begins boolean, role string, n_lines int, text string"


def parse(pieces: DataFrame, model: Model, conv: str = "conv_id", piece: str = "piece", text: str = "text", block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(conv, turn, role, n_lines, text): recovered turns with their markers removed.

    ``pieces`` are transcripts cut at line ends, in order of ``piece``; equal places are ordered by text. Null texts are a
    blank line, null transcripts are one transcript. Turns without any text are left out. An empty table gives no rows.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(model)
    rows = pieces.select(F.col(conv).cast("string").alias("conv"), F.coalesce(F.col(piece).cast("bigint"), F.lit(-1)).alias("piece"), F.col(text).alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("piece") / block_pieces))
    # blocks are numbered from the transcript's first one
    firsts = rows.groupBy("conv").agg(F.min("block").alias("_first")).withColumnRenamed("conv", "_conv")
    rows = rows.join(firsts, F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", "piece", "text", (F.col("block") - F.col("_first")).alias("block"))

    def sum_up(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv": block["conv"].iloc[:1], "block": block["block"].iloc[:1], "matrix": [summary(shared.value, _lines(block)).ravel().tolist()]})

    ends = _ends(cut_lineage(rows.groupBy("conv", "block").applyInPandas(sum_up, MATRIX)))

    def cut(block: pd.DataFrame) -> pd.DataFrame:
        lines = _lines(block)
        states = decode(shared.value, lines, int(block["entry"].iloc[0]), int(block["exit"].iloc[0]))
        name, number, out = block["conv"].iloc[0], int(block["block"].iloc[0]), []
        for i, (line, state) in enumerate(zip(lines, states)):
            if not i or state % 2 == 0:
                out.append([name, number, len(out), state % 2 == 0, ROLES[state // 2], 0, []])
            out[-1][5] += 1
            out[-1][6].append(line[marker(line)[1] :] if state % 2 == 0 else line)
        return pd.DataFrame([[*f[:6], "\n".join(f[6])] for f in out], columns=[c.split()[0] for c in FRAGMENT.split(", ")])

    placed = ends.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "entry", "exit")
    ready = rows.join(placed, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).select("conv", "block", "piece", "text", "entry", "exit")
    fragments = cut_lineage(ready.groupBy("conv", "block").applyInPandas(cut, FRAGMENT))
    begun = fragments.groupBy("conv", "block").agg(F.sum(F.col("begins").cast("int")).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = begun.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    local = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("conv", "block").orderBy("fragment"))
    numbered = fragments.withColumn("_local", local).join(offsets, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    parts = F.sort_array(F.collect_list(F.struct("block", "fragment", "text")))  # a turn spans blocks only where it is longer than one
    turns = numbered.groupBy("conv", (F.col("_before") + F.col("_local") - 1).alias("turn")).agg(
        F.min_by("role", F.struct("block", "fragment")).alias("role"), F.sum("n_lines").alias("n_lines"), F.array_join(parts["text"], "\n").alias("text")
    )
    return turns.withColumn("text", F.btrim("text", F.lit(" \t\r\n"))).filter("text <> ''")


def render(role: Column, text: Column) -> Column:
    """One turn in canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


# Fixed marker styles of written transcripts: the names of system, user and assistant, and what follows a name.
STYLES = (("System", "User", "Assistant", ": "), ("Instructions", "Human", "AI", ": "), ("Context", "Q", "A", ": "), ("moderator", "anna", "helper", "> "))


def written(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", unmarked: int = 7) -> DataFrame:
    """Turns as they would stand in raw transcripts: (conv_id, piece, role, text).

    The marker style goes by the conversation, one style has no markers but a blank line before each turn, and one turn in
    ``unmarked`` has lost its marker.
    """
    style = F.pmod(F.xxhash64(conv), F.lit(len(STYLES) + 1))
    lost = F.pmod(F.xxhash64(conv, turn), F.lit(unmarked)) == 0
    named = F.lit("")
    for i, names in enumerate(STYLES):
        marks = F.when(F.col(role) == "system", names[0]).when(F.col(role) == "user", names[1]).otherwise(names[2])
        named = F.when(style == i, F.concat(marks, F.lit(names[3]))).otherwise(named)
    before = F.when(style == len(STYLES), F.lit("\n")).when(lost, F.lit("")).otherwise(named)
    return turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("piece"), F.col(role).alias("role"), F.concat(before, F.coalesce(F.col(text), F.lit(""))).alias("text"))


def canonical(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per recovered turn of the written transcripts: conv_id, turn, role, n_lines, rendered. Roles serve learning only."""
    raw = written(turns, conv, turn, role, text)
    model = learn(raw, "conv_id", "piece", "role", "text")
    kind = dict(raw.dtypes)["conv_id"]
    found = parse(raw, model)
    return found.select(F.col("conv").cast(kind).alias("conv_id"), "turn", "role", "n_lines", render(F.col("role"), F.col("text")).alias("rendered"))
