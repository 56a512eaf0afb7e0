import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leadspan.llm import wavelet
from leadspan.llm.catalog import QUERIES
from leadspan.llm.encoding import encoder
from tests.conftest import SF
from tests.llm.conftest import ODD

PATH = wavelet.default_tokenizer()
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True


def plain(docs):
    out, start = [], 0
    for key, text in docs:
        ids = WHOLE.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op8_token_shards"](spark, SF).collect())) == plain(docs)


def test_odd_rows(spark, odd, empty, tmp_path):
    rows = wavelet.encode_documents(odd, folder=str(tmp_path / "shards"), shard_tokens=100).orderBy("start").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=repr) == sorted(((k, n, c) for k, _, n, c in plain(ODD)), key=repr)
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert wavelet.encode_documents(empty, folder=str(tmp_path / "none")).collect() == []
    shards = wavelet.read_shards(spark, str(tmp_path / "shards"))
    assert shards.count() == len(shards.select("_metadata.file_path").distinct().collect()) > 1


@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aeSt'ſİÉß .,\n\t#1́ ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_word_encoder_equals_tokenizer(text):
    assert np.frombuffer(encoder(PATH).encode(text), dtype="<u2").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n, width", [(0, 3), (1, 1), (700, 2), (3000, 9), (1500, 17)])
def test_matrix(n, width):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << width, n).astype(np.uint32) // rng.integers(1, 4, n).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(ids, width)
    assert m.decode().tolist() == ids.tolist()
    for i in rng.integers(0, max(n, 1), 30 if n else 0):
        value = int(ids[i])
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        places = np.flatnonzero(ids == value)
        assert m.access(int(i)) == value and m.count(value) == len(places) and m.count(value, lo, hi) == int((ids[lo:hi] == value).sum())
        assert [m.locate(value, k) for k in range(min(5, len(places)))] == places[:5].tolist() and m.locate(value, len(places) - 1) == places[-1]
    assert m.count(1 << width) == 0
    with pytest.raises(IndexError):
        m.locate((1 << width) - 1, m.count((1 << width) - 1))


@pytest.mark.parametrize("text", ["a b<|endoftext|>c d", "<|startoftext|>", "x  <|endoftext|>  Y", "<|ENDOFTEXT|> é 😀", "plain words\n<|startoftext|> and\nmore"])
def test_added_tokens_are_read_as_the_tokenizer_does(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(PATH).encode(text), dtype="<u2").tolist() == want
