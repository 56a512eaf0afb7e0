import random

from leadspan.llm import lines
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF
from tests.llm.conftest import COLUMNS, ODD, rows_of


def words(lines_of_text):
    return sum(len(line.split()) for line in lines_of_text)


def whole(docs):
    """Texts by (id, text) without every line that lies in a run of lines equal to an earlier one.

    All runs are compared but those made up of two shorter ones that are long enough: these repeat if the longer one does.
    """
    out, before = {}, set()
    for i, t in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        parts, gone = (t or "").split("\n"), set()
        enough = lambda a, b: words(parts[a:b]) >= (lines.CHUNK_WORDS if b - a > 1 else lines.PASSAGE_WORDS)
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if b - a > 2 and enough(a, b - 1) and enough(a + 1, b):
                    break
                if enough(a, b):
                    run = tuple(parts[a:b])
                    if run in before:
                        gone.update(range(a, b))
                    before.add(run)
        out[i, t] = None if t is None else "".join(p + "\n" * (k < len(parts) - 1) for k, p in enumerate(parts) if k not in gone)
    return out


def check(rows, docs):
    want = whole(docs)
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((i, want[i, t]) for i, t in docs), key=repr)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op3_line_dedup"](spark, SF).collect()
    check(rows, docs)
    texts = dict(docs)
    for r in rows:
        gone = [tuple(map(int, s.split(":"))) for s in r.removed.split(",") if s]
        assert len(gone) == r.removed_chunks and sum(b - a for a, b in gone) == len(texts[r.doc_id]) - len(r.text)


def test_odd_rows(odd, empty):
    check(lines.remove_repeated(odd).collect(), ODD)
    assert lines.remove_repeated(empty).collect() == []


def test_passages_move_with_the_text_around_them(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    several = "\n".join(f"line {i} of a block with some words in it and more of them still" for i in range(12))
    docs = [(1, f"start\n{passage}\nend one"), (2, f"another start\nand more\n{passage}\nend two"), (3, f"x\n{several}\ny"), (4, f"q\nr\ns\n{several}\nz z"), (5, passage), (6, "start\nend one")]
    rows = {r.doc_id: r for r in lines.remove_repeated(spark.createDataFrame(rows_of(docs), COLUMNS)).collect()}
    assert rows[1].removed == rows[3].removed == rows[6].removed == ""
    assert rows[2].text == "another start\nand more\nend two" and rows[5].text == ""
    assert rows[4].removed_words >= 0.6 * len(several.split()) and rows[4].text.startswith("q\n") and rows[4].text.endswith("z z")


def test_chunks_make_up_the_text():
    for text in ("", "\n", "a\n\nb", "x " * 70 + "\n" + "y\n" * 50, "no break"):
        parts = lines.chunks(text)
        assert "".join(text[a:b] for a, b, _ in parts) == text and sum(n for *_, n in parts) == len(text.split())


def test_every_repeated_run_of_lines_goes(spark):
    rng = random.Random(1)
    some = [" ".join(f"w{rng.randrange(4)}" for _ in range(n)) for n in (0, 1, 3, 5, 9, 12, 19, 20, 30, 50)]
    docs = [(i, "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    check(lines.remove_repeated(spark.createDataFrame(rows_of(docs), COLUMNS)).collect(), docs)


def test_planted_passages_are_found_whole(spark):
    """Lines x words a line, two documents, unequal surroundings of unequal length."""
    rng, docs, want = random.Random(2), [], {}
    fresh = lambda n: " ".join(f"u{rng.getrandbits(40)}" for _ in range(n))
    for count, words in ((2, 10), (2, 30), (3, 20), (5, 12), (200, 5), (100, 4)):
        for _ in range(20):
            passage = "\n".join(fresh(words) for _ in range(count))
            for copy in range(2):
                before, after = ("".join(fresh(8) + "\n" for _ in range(rng.randrange(1, 6))) for _ in range(2))
                docs.append((len(docs), f"{before}{passage}\n{after}"))
                want[len(docs) - 1] = before + after if copy else docs[-1][1]
    rows = lines.remove_repeated(spark.createDataFrame(rows_of(docs), COLUMNS)).collect()
    assert {r.doc_id: r.text for r in rows} == want
