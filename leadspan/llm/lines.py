"""Removal of repeated passages of lines.

A passage is a run of whole lines: several of them with ``CHUNK_WORDS`` or more words in total, or one line of
``PASSAGE_WORDS`` or more. A line is removed where it lies in a passage equal in all bytes to one at an earlier place, in
order of doc_id and position. Passages of any length are found from the shortest ones alone: from each line on, and up to
each line, the fewest lines that make a passage. A repeated passage is exactly made up of those of its shortest ones,
which are repeated with it, whatever stands around it; so the words are counted over the passage, not over a piece of it.

Hashes of the shortest passages are counted over all documents, those with a repeated hash are compared byte by byte.

``chunks`` cuts a text for ``n_chunks`` only: a rolling hash over the hashes of the last two lines ends a chunk of two or
more lines wherever its value is divisible by ``PERIOD``; a line of ``PASSAGE_WORDS`` or more words is a chunk by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspan.llm.texts import bit_map, given_id, identity, in_bit_map
from leadspan.session import cut_lineage

PERIOD = 2
CHUNK_WORDS = 20
PASSAGE_WORDS = 50
HELD_BYTES = 8 << 20  # of passages that a task holds before it hands them on
FACTOR = 0x9E3779B97F4A7C15
WHOLE = 2**64 - 1


def chunks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of each chunk in code points; ends include the line break, so that chunks make up the text."""
    out, start, at, before, words, held = [], 0, 0, 0, 0, 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        size = len(line) + (i < len(lines) - 1)
        body = line.encode("utf-8", "surrogatepass")
        count, own = len(body.split()), xxhash.xxh64_intdigest(body)
        rolled = (before * FACTOR + own) & WHOLE
        passage = count >= PASSAGE_WORDS
        if passage and at > start:
            out.append((start, at, words))
            start, words, held = at, 0, 0
        at += size
        words += count
        held += 1
        if at > start and (passage or held > 1 and (rolled ^ rolled >> 32) % PERIOD == 0):
            out.append((start, at, words))
            start, words, held = at, 0, 0
        before = own
    if at > start:
        out.append((start, at, words))
    return out


def body(text: str, start: int, end: int) -> bytes:
    """What is compared: the chunk without its last line break."""
    return text[start:end].removesuffix("\n").encode("utf-8", "surrogatepass")


def passages(counts: list[int]) -> list[tuple[int, int]]:
    """(first, end) in lines of the shortest passages, from the words of each line."""
    found = {(i, i + 1) for i, n in enumerate(counts) if n >= PASSAGE_WORDS}
    first = words = 0
    for end, n in enumerate(counts, 1):  # up to each line: as few lines as there can be
        words += n
        while end - first > 2 and words - counts[first] >= CHUNK_WORDS:
            words -= counts[first]
            first += 1
        if end - first >= 2 and words >= CHUNK_WORDS:
            found.add((first, end))
    last, words = len(counts), 0
    for start in range(len(counts) - 1, -1, -1):  # from each line on
        words += counts[start]
        while last - start > 2 and words - counts[last - 1] >= CHUNK_WORDS:
            last -= 1
            words -= counts[last]
        if last - start >= 2 and words >= CHUNK_WORDS:
            found.add((start, last))
    return sorted(found)


def candidates(text: str | None) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of the shortest passages; start and end in code points, the last line break included."""
    lines = (text or "").split("\n")
    bodies = [line.encode("utf-8", "surrogatepass") for line in lines]
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    starts[-1] -= 1
    for first, end in passages([len(b.split()) for b in bodies]):
        yield starts[first], starts[end], b"\n".join(bodies[first:end])


def _places(rows: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(_id, _content, start, end, hash) of candidates; with ``bits`` those whose hash may be in it, with their bytes."""
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def table(found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["_id", "_content", "start", "end", "bytes", "hash"])
        out["hash"] = np.array(out["hash"], dtype=np.uint64).view(np.int64)
        return out.drop(columns="bytes") if shared is None else out

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for batch in batches:
            for key, content, text in zip(batch["_id"], batch["_content"], batch["text"]):
                for start, end, data in candidates(text):
                    value = xxhash.xxh3_64_intdigest(data)
                    if shared is None:
                        data = b""
                    elif not in_bit_map(shared.value, np.uint64(value)):
                        continue
                    found.append((key, content, start, end, data, value))
                    held += len(data) + 64
                    if held > HELD_BYTES:
                        yield table(found)
                        found, held = [], 0
        if found:
            yield table(found)

    schema = "_id bigint, _content bigint, start bigint, end bigint, " + ("hash bigint" if bits is None else "bytes binary, hash bigint")
    return rows.mapInPandas(find, schema)


def repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(_id, _content, start, end): shortest passages equal in all bytes to an earlier one.

    Null and empty texts have none. Rows equal in id and text are one document.
    """
    rows = docs.select(*identity(id_column, text_column), F.col(text_column).alias("text"))
    key = ("_id", "_content", "start")
    places = _places(rows).groupBy("hash").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in key for f in (F.min, F.max)])
    often = cut_lineage(places.filter(" OR ".join(f"min_{c} <> max_{c}" for c in key)).select("hash"))
    place = F.struct(*key)
    found = _places(rows, bit_map(often, "hash")).join(often, "hash", "left_semi")
    first = found.groupBy("hash", "bytes").agg(F.min(place).alias("first"))
    return found.join(first, ["hash", "bytes"]).filter(place != F.col("first")).select("_id", "_content", "start", "end")


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chunks, removed_chunks, removed_words, removed (spans in code points), text without them.

    ``removed_chunks`` is the number of spans. Texts without repeated passages are unchanged, null stays null. Long texts are cut whole; repeated rows have equal
    results; other columns are not read; an empty table gives no rows.
    """
    gone = repeated(docs, id_column, text_column).distinct().groupBy("_id", "_content").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.col(text_column).alias("text"), *identity(id_column, text_column))

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"]):
                gone = [] if spans is None else merged((int(s["start"]), int(s["end"])) for s in spans)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                words = sum(len(body(text, a, b).split()) for a, b in gone)
                out.append((len(chunks(text or "")), len(gone), words, ",".join(f"{a}:{b}" for a, b in gone), "".join([*kept, text[at:]]) if gone else text))
            table = pd.DataFrame(out, columns=["n_chunks", "removed_chunks", "removed_words", "removed", "text"])
            table.insert(0, "doc_id", batch["_id"].to_numpy())
            yield table

    joined = rows.join(gone, ["_id", "_content"], "left").select("_id", "text", "spans")
    rebuilt = joined.mapInPandas(rebuild, "doc_id bigint, n_chunks bigint, removed_chunks bigint, removed_words bigint, removed string, text string")
    return rebuilt.withColumn("doc_id", given_id("doc_id"))
