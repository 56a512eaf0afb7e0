"""Repair of conversation structure by generalised LR parsing with weighted edits.

The roles of a repaired conversation follow the grammar ``C -> nothing | B``, ``B -> u a | s u a | B u a`` (initials of system,
user, assistant). A parser holds all stacks of the grammar's LR automaton that some edits of the rows read so far lead to; a
stack is its top state and the stack below, so equal beginnings are shared. Every row is kept, reroled or deleted, and lines
may be inserted before it; of the edits that lead to equal stack tops only the least (cost, audit) goes on.

Blank rows and rows whose role and text came before in the conversation must go; a row that ends amid a sentence costs more if
it stays. Edits are written D (delete), I and J (insert user, assistant), K (keep), R and S (rerole to user, assistant): byte
order of these strings is that of audits, where J reads I and S reads R, since what a prefix allows is one role only.

A conversation of any length is parsed in blocks of ``BLOCK_ROWS`` rows. Each block is summed up by the least cost and the
order of the audits between any two stacks; at a block's end no audit is the beginning of another one, so these sums can be
chained without the audits. Then each block is parsed again from the stack it is entered with, and yields its edits. Only the
digest of a whole conversation, one SHA-256 over all its lines, is read row after row, in bounded memory.

Rows: a null role or text is one space. Null turns come first; rows of one turn are ordered by role and text. Null conversation
ids form one conversation. Roles of other initials than s, u and a are never kept. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspan.llm.texts import SPACES, given_id, known_id, scratch
from leadspan.operators.ranking import ordinals
from leadspan.session import cut_lineage

BLOCK_ROWS = 1024
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5

# LR automaton of the grammar: states after a symbol, rules (symbol, length) that are complete in a state, states that may end.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 4, (2, "a"): 5, (4, "a"): 6, (3, "u"): 7, (7, "a"): 8}
COMPLETE = {5: ("B", 2), 6: ("B", 3), 8: ("B", 3)}
GOTO = {(0, "B"): 3}
ENDS = {0, 3}
START = (0, None)

ROLES = {"u": "user", "a": "assistant"}
INSERTS, REROLES = {"u": "I", "a": "J"}, {"u": "R", "a": "S"}
NAMED = {"I": "user", "J": "assistant", "R": "user", "S": "assistant"}
AUDIT = str.maketrans("JS", "IR")

Tops = dict[tuple, tuple[int, str]]  # least (cost, edits) by stack


@lru_cache(maxsize=None)
def shifted(stack: tuple, symbol: str) -> tuple | None:
    """The stack after a symbol, all complete rules reduced."""
    state = SHIFT.get((stack[0], symbol))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in COMPLETE:
        left, length = COMPLETE[stack[0]]
        for _ in range(length):
            stack = stack[1]
        stack = (GOTO[stack[0], left], stack)
    return stack


def _stacks() -> list[tuple]:
    found = [START]
    for stack in found:
        found += [n for n in (shifted(stack, s) for s in "sua") if n is not None and n not in found]
    return found


STACKS = _stacks()
NUMBER = {stack: i for i, stack in enumerate(STACKS)}


def merge(tops: Tops, stack: tuple, cost: int, edits: str) -> bool:
    if stack in tops and tops[stack] <= (cost, edits):
        return False
    tops[stack] = (cost, edits)
    return True


def with_inserts(tops: Tops) -> Tops:
    """Stacks that inserted lines lead to."""
    found, fresh = dict(tops), list(tops)
    while fresh:
        stack = fresh.pop()
        cost, edits = found[stack]
        for symbol, code in INSERTS.items():
            nxt = shifted(stack, symbol)
            if nxt is not None and merge(found, nxt, cost + INSERT, edits + code):
                fresh.append(nxt)
    return found


@lru_cache(maxsize=None)
def steps(initial: str, fault: str) -> dict[tuple, list[tuple[tuple, int, str]]]:
    """By stack: (next stack, cost, edits) of the best ways over one row, inserted lines before it included."""
    out = {}
    for start in STACKS:
        tops: Tops = {}
        for stack, (cost, edits) in with_inserts({start: (0, "")}).items():
            merge(tops, stack, cost + DELETE, edits + "D")
            if fault in "bd":
                continue
            stays = cost + (CUT_OFF if fault == "t" else 0)
            for symbol, price, code in ((initial, 0, "K"), *((s, REROLE, c) for s, c in REROLES.items() if s != initial)):
                nxt = shifted(stack, symbol)
                if nxt is not None:
                    merge(tops, nxt, stays + price, edits + code)
        out[start] = [(stack, cost, edits) for stack, (cost, edits) in tops.items()]
    return out


def parse(rows: str, start: tuple = START) -> Tops:
    """Least (cost, edits) by stack after the rows, each given as its initial and fault."""
    tops: Tops = {start: (0, "")}
    for i in range(0, len(rows), 2):
        ways = steps(rows[i], rows[i + 1])
        after: Tops = {}
        for stack, (cost, edits) in tops.items():
            for nxt, price, more in ways[stack]:
                merge(after, nxt, cost + price, edits + more)
        tops = after
    return tops


@lru_cache(maxsize=None)
def endings(stack: tuple) -> tuple[int, str]:
    """Least (cost, edits) of the lines that complete a conversation."""
    return min(way for s, way in with_inserts({stack: (0, "")}).items() if s[0] in ENDS)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with one in twenty each dropped, emptied, stripped of sentence ends, doubled, made the user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    changed = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), changed.alias("text"), kind.alias("_kind"))
    times = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv, pos, turn, role, text, written once: the place of every row in its conversation."""
    space = F.lit(" ")
    rows = conversations.select(known_id("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    folder = scratch(conversations.sparkSession, "turns")
    ordinals(rows, ["conv"], ["turn", "role", "text"], "pos").write.parquet(folder)
    return conversations.sparkSession.read.parquet(folder)


def _blocks(numbered: DataFrame) -> DataFrame:
    """conv, block, rows: two characters a row, initial (o: other) and fault (b blank, d duplicate, t truncated, k none)."""
    first = numbered.groupBy("conv", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("_same")).agg(F.min("pos").alias("pos"))
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(ended == "", "b").when(F.right(ended, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")
    initial = F.substring("role", 1, 1)
    marks = numbered.select("conv", "pos", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"))
    seen = marks.join(first.select("conv", "pos", F.lit(True).alias("_first")), ["conv", "pos"], "left")
    known = F.when(F.col("_first").isNull() & (F.col("fault") != "b"), "d").otherwise(F.col("fault"))
    each = seen.select("conv", F.floor(F.col("pos") / BLOCK_ROWS).alias("block"), F.struct("pos", F.concat("initial", known).alias("row")).alias("_row"))
    return cut_lineage(each.groupBy("conv", "block").agg(F.array_join(F.array_sort(F.collect_list("_row")).getField("row"), "").alias("rows")))


SUMMARY = "conv long, block long, ways array<struct<entry:int,exit:int,cost:long,rank:int>>, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for conv, block, rows in zip(batch["conv"], batch["block"], batch["rows"]):
            ways = []
            for start in STACKS if block else STACKS[:1]:
                tops = parse(rows, start)
                ways += [(NUMBER[start], NUMBER[s], tops[s][0], rank) for rank, s in enumerate(sorted(tops, key=lambda s: tops[s][1]))]
            initials, faults = rows[::2], rows[1::2]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            out.append((conv, block, [dict(zip(("entry", "exit", "cost", "rank"), w)) for w in ways], *(faults.count(c) for c in "bdt"), illegal, initials[0], initials[-1]))
        yield pd.DataFrame(out, columns=["conv", "block", "ways", "blank", "duplicate", "truncated", "illegal", "first", "last"])


class _Chain:
    """Blocks of one conversation, joined from left to right."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, int]] = {0: (0, 0)}  # by stack: cost, rank of the audit among these
        self.came: list[dict[int, int]] = []
        self.counts, self.last = [0, 0, 0, 0], None

    def add(self, ways, counts: tuple, first: str, last: str) -> None:
        found: dict[int, tuple] = {}
        for w in ways:
            if w["entry"] in self.best:
                cost, rank = self.best[w["entry"]]
                found[w["exit"]] = min(found.get(w["exit"], (float("inf"),)), (cost + w["cost"], rank, w["rank"], w["entry"]))
        order = sorted(found, key=lambda e: found[e][1:3])
        self.best = {e: (found[e][0], order.index(e)) for e in found}
        self.came.append({e: found[e][3] for e in found})
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.counts[3] += self.last is not None and self.last + first not in ("su", "ua", "au")
        self.last = last

    def rows(self, conv: int) -> Iterator[tuple]:
        """One row per block, the last one first: entry and exit; the last block has the lines at the end, counts and the cost."""
        cost, _, closing, at = min((cost + endings(STACKS[e])[0], rank, endings(STACKS[e])[1], e) for e, (cost, rank) in self.best.items())
        totals = (*self.counts, cost)
        for block in range(len(self.came) - 1, -1, -1):
            entry = self.came[block][at]
            yield (conv, block, entry, at, closing, *totals)
            at, closing, totals = entry, "", (None,) * 5


CHOSEN = "conv long, block long, entry int, exit int, closing string, blank long, duplicate long, truncated long, illegal long, cost long"


def _chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best way through each conversation; its blocks come in order."""
    columns = [c.split()[0] for c in CHOSEN.split(", ")]

    def frame(out: list) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=columns)
        return made.astype({c: "Int64" for c in columns[5:]})

    now, chain, out = None, _Chain(), []
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.conv != now:
                out += chain.rows(now) if chain.came else ()
                now, chain = r.conv, _Chain()
            chain.add(r.ways, (r.blank, r.duplicate, r.truncated, r.illegal), r.first, r.last)
        yield frame(out)
        out = []
    yield frame(list(chain.rows(now)) if chain.came else [])


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        edits = [parse(rows, STACKS[a])[STACKS[b]][1] + closing for rows, a, b, closing in zip(batch["rows"], batch["entry"], batch["exit"], batch["closing"])]
        yield pd.DataFrame({"conv": batch["conv"], "block": batch["block"], "edits": edits})


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv, edit, role, text, turn) of all edits in order, deleted rows included; each block's edits come before its rows."""
    conv, edits, at = None, "", 0
    for batch in batches:
        for c, pos, role, text, turn, more in zip(*(batch[n].tolist() for n in ("conv", "pos", "role", "text", "turn", "edits"))):
            if more is not None:
                conv, edits, at = c, more, 0
                continue
            while edits[at] in "IJ":
                yield conv, edits[at], NAMED[edits[at]], "", None
                at += 1
            yield conv, edits[at], NAMED.get(edits[at], role), text, turn
            at += 1
            if edits[at:].strip("IJ") == "" and at < len(edits):  # lines behind the last row
                yield from ((conv, e, NAMED[e], "", None) for e in edits[at:])
                at = len(edits)


class Repair:
    """The cheapest repair of all conversations: costs and counts, repaired lines, digests."""

    def __init__(self, conversations: DataFrame) -> None:
        self.turns = _numbered(conversations)
        blocks = _blocks(self.turns)
        chain = blocks.mapInPandas(_summaries, SUMMARY).repartition("conv").sortWithinPartitions("conv", "block")
        self.chosen = cut_lineage(chain.mapInPandas(_chosen, CHOSEN))
        ways = blocks.join(self.chosen.select("conv", "block", "entry", "exit", "closing"), ["conv", "block"])
        edits = ways.select("conv", "block", "rows", "entry", "exit", "closing").mapInPandas(_edits, "conv long, block long, edits string")
        texts = self.turns.select("conv", "pos", F.lit(1).alias("kind"), "role", "text", "turn", F.lit(None).cast("string").alias("edits"))
        none = [F.lit(None).cast(t).alias(n) for n, t in (("role", "string"), ("text", "string"), ("turn", "bigint"))]
        both = texts.union(edits.select("conv", (F.col("block") * BLOCK_ROWS).alias("pos"), F.lit(0).alias("kind"), *none, "edits"))
        self._stream = both.repartition("conv").sortWithinPartitions("conv", "pos", "kind")

    def costs(self) -> DataFrame:
        """conv, blank, duplicate, truncated, illegal, cost."""
        return self.chosen.filter("cost IS NOT NULL").select("conv", "blank", "duplicate", "truncated", "illegal", "cost")

    def lines(self) -> DataFrame:
        """conv_id, at, turn (null for inserted lines), role, text, edit: the repaired conversations."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, now, at = [], None, 0
            for conv, edit, role, text, turn in _lines(batches):
                now, at = conv, at if conv == now else 0
                if edit != "D":
                    out.append((conv, at, turn, role, text, edit.translate(AUDIT)))
                    at += 1
                if len(out) == 512:
                    yield frame(out)
                    out = []
            yield frame(out)

        def frame(out: list) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["conv", "at", "turn", "role", "text", "edit"]).astype({"turn": "Int64"})

        found = self._stream.mapInPandas(run, "conv long, at long, turn long, role string, text string, edit string")
        return found.select(given_id("conv").alias("conv_id"), "at", "turn", "role", "text", "edit")

    def digests(self) -> DataFrame:
        """conv, audit, repaired_sha256."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, audit, digest, out = None, [], None, []
            first = True
            for conv, edit, role, text, _ in _lines(batches):
                if conv != now:
                    if now is not None:
                        out.append((now, "".join(audit).translate(AUDIT), digest.hexdigest()))
                    now, audit, digest, first = conv, [], hashlib.sha256(), True
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False
                if len(out) == 512:
                    yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])
                    out = []
            if now is not None:
                out.append((now, "".join(audit).translate(AUDIT), digest.hexdigest()))
            yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])

        return self._stream.mapInPandas(run, "conv long, audit string, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the given rows: faults found after ``damage`` and the cheapest repair."""
    made = Repair(damage(conversations))
    ids = conversations.select(known_id("conv_id").alias("conv")).distinct()
    spans = made.turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    whole = ids.join(spans, "conv", "left").join(made.costs(), "conv", "left").join(made.digests(), "conv", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return whole.select(given_id("conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
