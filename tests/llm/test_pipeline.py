import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from leadspan.llm import decontaminate, mixing, rules, wavelet
from tests.conftest import SF
from tests.llm.conftest import COLUMNS, ODD, rows_of
from tests.llm.test_decontaminate import plain as overlapping
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = [i for i in sorted(docs) if rules.rejected_by(rules.RULES, docs[i].text) is None]
    heads = plain_components([(i, plain_fingerprint(docs[i].text)) for i in kept])
    kept = [i for i, h in zip(kept, heads) if i == h]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame([docs[i] for i in kept]), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    short = [i for i in kept if len(docs[i].text) < 2000]
    assert {i for i, _ in overlapping([(i, docs[i].text) for i in short], items)} == bad & set(short)
    kept = [i for i in kept if i not in bad]
    taken = {r.doc_id: r.copies for r in mixing.taken_words(spark.createDataFrame([docs[i] for i in kept])).collect()}
    whole, want, start = Tokenizer.from_file(wavelet.default_tokenizer()), [], 0
    for i in kept:
        ids = whole.encode(docs[i].text, add_special_tokens=False).ids + [2]
        for _ in range(taken[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty), ("text", spark.createDataFrame(rows_of([(i, t or "") for i, t in ODD]), COLUMNS))):
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
            assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
    assert spark.read.parquet(str(tmp_path / "odd0")).count() == 1
