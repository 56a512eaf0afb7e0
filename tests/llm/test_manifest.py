import hashlib
import zlib

import pytest

from leadspan.llm import manifest
from leadspan.llm.catalog import QUERIES
from tests.conftest import SF
from tests.llm.conftest import COLUMNS, ODD, rows_of


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    values = [None if v is None else str(v) for v in row]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def lower(text):
    return text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """Root of a list of digests and, per node, the siblings on its way: one pass per level."""
    ways, spots, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, spot in enumerate(spots):
            first = spot // 16 * 16
            ways[i].append((spot % 16, [level[j] for j in range(first, min(first + 16, len(level))) if j != spot]))
        spots = [s // 16 for s in spots]
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return (level[0] if level else None), ways


def fold(digest, way):
    for place, others in way:
        digest = h(*others[:place], digest, *others[place:])
    return digest


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *climb([leaf(r) for r in own]))
    root, tops = climb([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, way in zip(trees[s][0], trees[s][2]):
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = fold(leaf((*r[:4], lower(r[4])) if forged else r), way + top)
            out.append((r[0], leaf(r), trees[s][1], root, h(*[d for _, others in way + top for d in others]), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*manifest.FIELDS)
    got = found(QUERIES["op13_merkle_manifest"](spark, SF))
    assert got == plain([tuple(r) for r in docs.collect()])
    forged = [r for r in got if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(forged) > 20 and not any(r[-1] for r in forged) and all(r[-1] for r in got if r not in forged)


def test_odd_rows(spark, odd, empty):
    assert found(manifest.tampered_audit(odd)) == plain([(i, "s", "en", len(t or ""), t) for i, t in ODD])
    assert found(manifest.tampered_audit(empty)) == []


def test_one_document(spark):
    rows = rows_of([(7, "Alone")])
    got = found(manifest.tampered_audit(spark.createDataFrame(rows, COLUMNS)))
    assert got == plain([(7, "s", "en", 5, "Alone")]) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h()


@pytest.mark.parametrize("part_leaves", [256, manifest.PART_LEAVES])
def test_trees_of_many_shapes(spark, part_leaves):
    """Sizes around the powers of 16, one hot source, several hundred sources, nulls among them."""
    sizes = {None: 17, "": 1, "a": 16, "B": 256, "é": 257, "hot": 4500, "z": 4096, "😀": 273} | {f"s{i:03}": 1 + i % 3 for i in range(300)}
    rows, n = [], 0
    for s, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7919 % 100003, s, None if n % 11 == 0 else "en", None if n % 13 == 0 else n, None if n % 17 == 0 else f"Text {n}"))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(manifest.tampered_audit(df, part_leaves)) == plain(rows)


def test_proofs_lead_to_the_root(spark):
    rows = [(i, f"s{i % 3}" if i % 2 else "hot", "en", i, f"text {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = manifest.build(df.selectExpr("doc_id AS _id", "source").withColumn("leaf", manifest.F.sha2(manifest.F.col("_id").cast("string"), 256)).withColumn("claim", manifest.F.lit(None).cast("string")))
    got = manifest.proofs(made).collect()
    assert len(got) == 700 and all(manifest.fold(r.leaf, r.places, r.siblings) == made.root for r in got)
    assert all(manifest.fold(h("x"), r.places, r.siblings) != made.root for r in got)


def test_minimal_union():
    """Nothing fetched follows from leaves held or from other fetched nodes, and every proof is complete."""
    held = {0: manifest.np.array([3, 40, 41, 299])}
    asked = list(manifest.missing(held, 300))
    assert len(asked) == len(set(asked))
    for level, at in asked:
        below = {i // 16**level for i in held[0]}
        assert at not in below  # an ancestor of a held leaf is derived
    on_way = {(level, int(i) // 16**level) for i in held[0] for level in range(len(manifest.widths(300)) - 1)}
    needed = {(level, j) for level, at in on_way for j in range(at // 16 * 16, min(at // 16 * 16 + 16, manifest.widths(300)[level]))}
    assert set(asked) == needed - on_way
